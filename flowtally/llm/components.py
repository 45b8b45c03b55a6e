"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtally.session import settled


def _state(edges: DataFrame):
    """Changes when the links do."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """node, label for every node of ``links`` (a, b): label is the smallest node of its component.

    Alternates two steps until nothing changes: every node links its larger neighbours, then its smaller ones,
    to the smallest of its neighbourhood. Rounds grow with the logarithm of the nodes; a round is two
    aggregations and two joins on the nodes, and a much linked node is one row of the aggregation's result.
    """
    edges = links.select("a", "b") if old is None else links.select("a", "b").unionByName(old.select(F.col("node").alias("a"), F.col("label").alias("b")))
    edges = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
        large = both.join(low, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = settled(small.where("a <> b").distinct(), "links")
        now = _state(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)
