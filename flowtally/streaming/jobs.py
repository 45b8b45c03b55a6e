"""Structured Streaming forms of scoring, request metrics, drift and last-N per key.

The streams read a growing folder of Parquet files and stop when they have caught up
(``availableNow``), or run on a trigger. Results are Parquet tables below a given folder;
checkpoints lie beside them, so a restarted stream goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from flowtally.operators.monitor import PERCENTILES, DriftBaseline, histograms, score_bin
from flowtally.operators.ordered import counted_quantiles, top_n
from flowtally.sources.versions import VersionedTable


def event_stream(spark: SparkSession, folder: str, glob: str, ts: str = "ts") -> DataFrame:
    """A file stream with a proper event-time column."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return rows.withColumn(ts, F.col(ts).cast("timestamp"))


#: Run until the input is read; ``{"processingTime": "1 minute"}`` keeps a stream going.
CAUGHT_UP = {"availableNow": True}


def run_to_table(df: DataFrame, path: str, mode: str = "append", trigger: dict | None = None) -> None:
    query = (df.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/rows")
             .option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or CAUGHT_UP)).start())
    query.awaitTermination()


def run_counts(counts: DataFrame, keys: Sequence[str], path: str, trigger: dict | None = None) -> DataFrame:
    """The newest counts per key of a windowed aggregation, windows that are still open included.

    Every batch writes the counts it changed to a folder of its own (a replayed batch replaces it);
    the latest batch of a key holds its full counts.
    """
    spark, rows = counts.sparkSession, f"{path}/rows"
    spark.createDataFrame([], counts.schema).write.mode("overwrite").parquet(f"{rows}/batch=-1")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={batch_id}")

    query = (counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
             .trigger(**(trigger or CAUGHT_UP)).start())
    query.awaitTermination()
    found = spark.read.schema(StructType([*counts.schema.fields, StructField("batch", IntegerType())])).parquet(rows)
    values = [c for c in counts.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def _is_closed(counts: DataFrame, start: Column, every: str, late: str) -> Column:
    """Whether a window's end lies behind the newest event by more than the allowed lateness."""
    newest = counts.agg(F.max("latest")).first()[0]
    return start + F.expr(f"INTERVAL {every}") <= F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {late}")


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/rows")


def score_stream(events: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, trigger: dict | None = None) -> DataFrame:
    """Score arriving rows with a fitted transform; each row is scored once."""
    scored = transform(events)
    run_to_table(scored, path, trigger=trigger)
    return _table(events.sparkSession, path, scored.schema)


def request_metrics_stream(events: DataFrame, keys: Sequence[str], latency: str, error: Column, path: str,
                           ts: str = "ts", every: str = "60 seconds", late: str = "10 minutes", trigger: dict | None = None) -> DataFrame:
    """Percentiles, error rate and total per window, and whether it is closed.

    The stream keeps counts per (window, key, latency), which spread over all tasks even when
    one key has most of the traffic; the percentiles are taken from the counts by running sums.
    """
    counts = (
        events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), *keys, F.col(latency).alias("latency"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"), F.max(ts).alias("latest"))
        .select(F.col("w.start").alias("window_start"), *keys, "latency", "n", "errors", "latest"))
    closed = run_counts(counts, ["window_start", *keys, "latency"], path, trigger)
    totals = closed.groupBy("window_start", *keys).agg(F.sum("n").alias("total_requests"), F.sum("errors").alias("errors"))
    named = [*keys, "window_start"]
    latencies = counted_quantiles(closed, named, "latency", "n", PERCENTILES)
    out = totals.join(latencies, named, "left")
    return out.select(
        "window_start", *keys, *PERCENTILES,
        (F.col("errors") / F.greatest("total_requests", F.lit(1))).alias("error_rate"), "total_requests",
        _is_closed(closed, F.col("window_start"), every, late).alias("is_closed"))


def drift_stream(events: DataFrame, score: Column, baseline: DriftBaseline, path: str, ts: str = "ts",
                 every: str = "1 day", late: str = "1 hour", trigger: dict | None = None) -> DataFrame:
    """Drift of every event-time window against a stored baseline, and whether the window is
    closed; the state is one count per (window, bin)."""
    counts = (
        events.where(score.isNotNull()).withWatermark(ts, late)
        .groupBy(F.window(ts, every).alias("w"), F.coalesce(score_bin(score, baseline.n_bins), F.lit(0)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("latest")).select(F.col("w.start").alias("window_start"), "bin", "n", "latest"))
    found = run_counts(counts, ["window_start", "bin"], path, trigger)
    checked = baseline.check(histograms(found.drop("latest"), ["window_start"], baseline.n_bins), "window_start")
    return checked.withColumn("is_closed", _is_closed(found, F.col("window_label").cast("timestamp"), every, late))


def last_n_stream(events: DataFrame, key: str, order: Sequence[str], n: int, path: str,
                  compact_every: int = 20, trigger: dict | None = None) -> DataFrame:
    """The last ``n`` rows of every key, kept up to date batch by batch.

    A batch is thinned to its own last ``n`` per key, in salted parts, so a key with most of the
    traffic is never in one task as a whole. The thinned rows go to a folder of their batch (a
    replayed batch replaces its own); every so often all of them are merged into a base table.
    """
    spark = events.sparkSession
    newest = [F.desc(c) for c in order]

    def thin(rows: DataFrame) -> DataFrame:
        return top_n(rows, [key], newest, n, F.struct(*order), out="_rank").drop("_rank")

    def merge(batch: DataFrame, batch_id: int) -> None:
        thin(batch).write.mode("overwrite").parquet(f"{path}/batches/batch={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            VersionedTable(spark, f"{path}/base").write(
                thin(_kept_rows(spark, path, events.columns)).withColumn("_through", F.lit(batch_id)))

    query = (events.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint")
             .trigger(**(trigger or CAUGHT_UP)).start())
    query.awaitTermination()
    return thin(_kept_rows(spark, path, events.columns))


def _kept_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Base rows and the thinned rows of the batches after it."""
    later = spark.read.parquet(f"{path}/batches")
    base = VersionedTable(spark, f"{path}/base")
    if not base.version():
        return later.select(*columns)
    merged = base.read()
    through = merged.agg(F.max("_through")).first()[0]
    return merged.select(*columns).unionByName(later.where(F.col("batch") > through).select(*columns))
