import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtally.operators import ranged
from flowtally.operators.ordered import (cumulative_counts, exact_quantiles, mid_ranks, positions, quantile_columns, top_n)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=1500) * 100, np.zeros(400), rng.integers(-4, 5, 900).astype(float), np.full(1200, 0.9999)])
    pdf = pd.DataFrame({"g": np.where(rng.random(len(v)) < 0.7, "a", "b"), "v": v, "id": np.arange(len(v))})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("max_bracket", [1, 40, None])
def test_quantiles_equal_numpy(sample, max_bracket):
    pdf, df = sample
    got = exact_quantiles(df, ["g"], "v", [0, 0.25, 0.5, 0.953, 1.0], max_bracket).toPandas()
    assert len(got) == 10
    for _, r in got.iterrows():
        assert r["quantile"] == pytest.approx(np.quantile(pdf[pdf.g == r.g].v, r.prob), abs=1e-9)


@pytest.mark.parametrize("parts", [1, 23, None])
def test_counts_positions_and_ranks(sample, parts):
    pdf, df = sample
    counts = cumulative_counts(df, ["g"], "v", {"n": F.count(F.lit(1))}, parts).toPandas()
    place = positions(df, ["g"], "v", "id", "pos", parts).toPandas()
    ranks = mid_ranks(df.withColumn("all", F.lit(1)), ["all"], "v", "g", parts).toPandas()
    for g in "ab":
        want = pdf[pdf.g == g].groupby("v").size()
        got = counts[counts.g == g].sort_values("v")
        assert (got.n.values == want.values).all()
        assert (got.n_below.values == np.r_[0, want.values.cumsum()[:-1]]).all()
        assert (got.n_total == want.sum()).all()
        assert (place[place.g == g].sort_values(["v", "id"]).pos.values == np.arange(want.sum())).all()
    want = dict(zip(pdf.v, pdf.v.rank()))
    assert all(abs(want[v] - r) < 1e-9 for v, r in zip(ranks.v, ranks.mid_rank))
    assert ranks.m.sum() == len(pdf)


def test_quantiles_skip_gaps(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,), (float("nan"),), (float("inf"),)], "v double")
    row = quantile_columns(df, [], "v", {"a": 0.25, "b": 0.75, "c": 0.95}).first()
    assert (row.a, row.b, pytest.approx(row.c)) == (1.75, 4.75, 8.95)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(df, ["g"], "v", [0.5]).count() == 0
    assert cumulative_counts(df, ["g"], "v", {"n": F.count(F.lit(1))}).count() == 0


def test_top_n_is_a_total_order(sample):
    pdf, df = sample
    got = top_n(df, ["g"], [F.desc("v"), F.asc("id")], 7, F.col("id")).toPandas()
    for g in "ab":
        want = pdf[pdf.g == g].sort_values(["v", "id"], ascending=[False, True]).head(7).id.tolist()
        assert got[got.g == g].sort_values("rank").id.tolist() == want


def test_positions_with_a_hot_value_among_others(spark):
    v = np.concatenate([np.full(600, 1000.0), 1000 + np.arange(60) / 1e4, [999.99, 1001.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": v, "id": np.arange(len(v))[::-1]}))
    got = positions(df, [], "v", "id", "pos", 20).toPandas().sort_values(["v", "id"])
    assert got.pos.tolist() == list(range(len(v)))


@pytest.mark.parametrize("limit", [1, None])
def test_one_group_of_equal_values_and_one_of_distinct_ones(spark, limit):
    """Nothing depends on how values are spread: most rows in one value, or each row with its own."""
    df = spark.range(6000).select(F.when(F.col("id") < 4000, "same").otherwise("own").alias("g"), F.when(F.col("id") < 4000, F.lit(7.5)).otherwise(F.col("id") * 1.0).alias("v"), "id")
    got = {(r.g, r.prob): (r["quantile"], r.n) for r in exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.999], limit).collect()}
    for p in (0.1, 0.5, 0.999):
        assert got["same", p] == (7.5, 4000) and got["own", p] == (pytest.approx(4000 + 1999 * p), 2000)
    parts = 64 if limit else None
    counts = {(r.g, r.v): (r.n, r.n_below, r.n_total) for r in cumulative_counts(df, ["g"], "v", {"n": F.count(F.lit(1))}, parts).collect()}
    assert counts["same", 7.5] == (4000, 0, 4000) and all(counts["own", 4000.0 + i] == (1, i, 2000) for i in range(2000))
    ranks = {(r.g, r.v): r.mid_rank for r in mid_ranks(df.withColumn("d", F.col("id") % 3), ["g"], "v", "d", parts).collect()}
    assert ranks["same", 7.5] == 2000.5 and all(ranks["own", 4000.0 + i] == i + 1 for i in range(2000))
    place = positions(df, ["g"], "v", "id", "pos", parts).collect()
    assert all(r.pos == (r.id if r.g == "same" else r.id - 4000) for r in place)


def test_a_sketch_that_misses_is_noticed(spark, monkeypatch):
    monkeypatch.setattr("flowtally.operators.ordered.MARGIN", -0.05)
    df = spark.range(1000).select((F.col("id") * 1.0).alias("v"))
    for limit in (10, None):
        got = exact_quantiles(df, [], "v", [0.25, 0.5, 0.9], limit).orderBy("prob").collect()
        assert [r["quantile"] for r in got] == pytest.approx([249.75, 499.5, 899.1])


def test_no_join_and_no_order_over_a_group(sample):
    """Ranks are windows inside range parts only; quantiles shuffle counted values of brackets, not rows."""
    _, df = sample
    plan = cumulative_counts(df, ["g"], "v", {"n": F.count(F.lit(1))})._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "_part" in plan


def test_more_rows_make_more_parts(spark, monkeypatch):
    monkeypatch.setattr(ranged, "PART_ROWS", 50)
    rows = [("a" if k % 3 else "b", float(k // 2), "x" if k % 2 else "y") for k in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double, d string")
    got = mid_ranks(df, ["g"], "v", "d")
    assert got.rdd.getNumPartitions() > 30  # the session has 4 shuffle partitions
    for g, part in pd.DataFrame(rows, columns=["g", "v", "d"]).groupby("g"):
        want = dict(zip(part.v, part.v.rank()))
        found = got.where(F.col("g") == g).collect()
        assert sum(r["m"] for r in found) == len(part) and {r["v"]: r["mid_rank"] for r in found} == want
