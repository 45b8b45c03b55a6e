"""Rolling request metrics on a stream: the last requests of each service are kept as state.

State lies in RocksDB (``with_rocksdb``), one list and one number per service, and forgets a service that has been
silent for a given time. A restarted stream goes on with the state of its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowtally.operators.monitor import PERCENTILES, ROLLING_ROWS
from flowtally.streaming.jobs import run_to_table

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_rocksdb(spark: SparkSession) -> None:
    """List state needs the RocksDB store; a session that names another provider keeps it only until here."""
    spark.conf.set(PROVIDER, ROCKSDB)


class LastRequests(StatefulProcessor):
    """Per service: the latencies and failures of its last ``rows`` - 1 requests in order, and how many there were."""

    def __init__(self, names: list[str], rows: int, idle_ms: int | None):
        self.names, self.rows, self.idle_ms = names, rows, idle_ms  # names: service, order, tie, latency, failed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "latency double, failed double")
        self.total = handle.getValueState("total", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        service, order, tie, latency, failed = self.names
        fresh = pd.concat(list(rows)).sort_values([order, tie], kind="stable")
        before = pd.DataFrame(list(self.last.get()) if self.last.exists() else [], columns=["latency", "failed"], dtype="float64")
        n = int(self.total.get()[0]) if self.total.exists() else 0
        both = pd.concat([before, pd.DataFrame({"latency": fresh[latency].astype("float64"), "failed": fresh[failed].astype("float64")})], ignore_index=True)
        window = both["latency"].rolling(self.rows, min_periods=1)
        out = {service: [key[0]] * len(fresh), tie: fresh[tie].to_numpy()}
        for name, p in PERCENTILES.items():
            out[name] = window.quantile(p).to_numpy()[len(before):]
        out["error_rate"] = both["failed"].rolling(self.rows, min_periods=1).mean().to_numpy()[len(before):]
        out["total_requests"] = n + 1 + pd.RangeIndex(len(fresh)).to_numpy()
        kept = both.tail(self.rows - 1)
        if len(kept):
            self.last.put([(float(a), float(b)) for a, b in kept.itertuples(index=False)])
        self.total.update((n + len(fresh),))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A silent service is forgotten; it starts anew with its next request."""
        self.last.clear()
        self.total.clear()
        return iter([])

    def close(self) -> None:
        pass


def rolling_stream(events: DataFrame, service: str, order: str, tie: str, latency: str, path: str, error=None, rows: int = ROLLING_ROWS,
                   idle_ms: int | None = None, trigger: dict | None = None) -> DataFrame:
    """Percentiles, error rate and running total over the last ``rows`` requests of the service, at every request: the
    answer of ``rolling_latency`` with ``error``, kept up by a stream. Requests of later batches count as later ones.

    A batch's requests of one service are sorted in its task, so a batch should be bounded by the source's options
    (``maxFilesPerTrigger``); the state of a service is ``rows`` - 1 pairs. ``idle_ms`` forgets silent services; such a
    stream needs a trigger of its own, since with timers set it has never caught up.
    """
    spark = events.sparkSession
    with_rocksdb(spark)
    failed = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
    name = "failed_request"  # names with a leading underscore do not reach the processor
    given = events.select(service, order, tie, latency, failed.cast("double").alias(name))
    types = dict(given.dtypes)
    ddl = f"{service} {types[service]}, {tie} {types[tie]}, " + ", ".join(f"{n} double" for n in PERCENTILES) + ", error_rate double, total_requests bigint"
    told = given.groupBy(service).transformWithStateInPandas(
        LastRequests([service, order, tie, latency, name], rows, idle_ms), ddl, "Append", "None" if idle_ms is None else "ProcessingTime")
    run_to_table(told, path, trigger=trigger)
    return spark.read.schema(ddl).parquet(f"{path}/rows")
