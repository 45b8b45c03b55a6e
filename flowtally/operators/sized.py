"""Sizes that are looked at before a plan is chosen: broadcasts and small scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

ROW_LIMIT = 20_000


def small_side(df: DataFrame, limit: int = ROW_LIMIT) -> tuple[DataFrame, list[Row] | None]:
    """The join side to use for ``df``, and its rows if they were all fetched.

    At most ``limit`` narrow rows are fetched. If that is all of them they become a broadcast
    local table; if there are more, ``df`` comes back as it is (rows None) and the join is left
    to a shuffle. The fetched rows also pin the values: a re-run task sees the same ones.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df, None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


def spread(scan: DataFrame) -> DataFrame:
    """Rebalance a table scan that has fewer parts than the cluster has cores, ahead of heavy
    work per row. A scan of many parts is left alone, so this never moves large data."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
