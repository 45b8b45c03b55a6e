"""Boosted trees from binned rows against Spark ML's own fit."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from flowtally.operators import boosting
from flowtally.operators.attribution import export_trees
from flowtally.operators.ensemble import preparation

NAMES = ["a", "b", "c", "d"]


def nodes(spark, model):
    return [(weight, {i: (n["feature"], n["threshold"], n["left"], n["right"], n["count"], round(n["prediction"], 9)) for i, n in tree.items()}) for weight, tree in export_trees(spark, model)]


def test_trees_are_those_of_the_library(spark, folder, monkeypatch):
    i = F.col("id")
    made = spark.range(0, 12_000, 1, 3).select(
        F.when(i % 7 != 0, i * 31 % 100).cast("double").alias("a"), (i * 17 % 5).cast("double").alias("b"), F.sin("id").alias("c"), F.lit(3.0).alias("d"),
        ((F.sin("id") > 0.3).cast("int") + (i * 31 % 100 > 60).cast("int")).alias("y"))
    made.write.parquet(folder + "/rows")
    rows = spark.read.parquet(folder + "/rows")
    prep = preparation(NAMES).fit(rows)
    monkeypatch.setattr(boosting, "KEPT_TREES", 2)  # margins are written once
    monkeypatch.setattr(boosting, "BLOCK", 1000)
    new = boosting.fit_boosted(rows, NAMES, prep, F.col("y"), 2, 3, 3, 0.1, 0.8, 0.6, 7)
    for c, model in enumerate(new):
        one = prep.transform(rows).select("features", (F.col("y") == c).cast("double").alias("is"))
        old = GBTClassifier(featuresCol="features", labelCol="is", maxIter=3, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=7, featureSubsetStrategy="0.6").fit(one)
        assert nodes(spark, model) == nodes(spark, old)


def test_limits_and_places_of_rows():
    assert boosting.limits_of(np.array([1.0, 2.0, 2.0, 4.0]), 4).tolist() == [1.5, 3.0]
    assert boosting.limits_of(np.array([0.0, 2.0, 0.0]), 3).tolist() == [1.0]  # zeros follow from what falls short
    assert boosting.limits_of(np.zeros(5), 5).tolist() == []
    assert len(boosting.limits_of(np.arange(1.0, 1001.0), 1000)) == boosting.BINS - 1
    tree = boosting.Tree()
    tree.split(0, 1, 4, 1.0, np.array([2, 2.0, 2]), np.array([3, 6.0, 12]))
    tree.levels.append([0])
    bins = np.array([[9, 9, 9], [4, 5, 0]], np.uint8)
    assert boosting._reached(tree.flat(), bins).tolist() == [1, 2, 1]
    with pytest.raises(ValueError):
        scaling = object.__new__(boosting.Scaling)
        scaling.medians, scaling.mean, scaling.scale = np.zeros(1), np.zeros(1), np.ones(1)
        scaling(np.array([[np.inf]]))
