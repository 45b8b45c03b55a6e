"""Radix cuts under other parts and on repeated rows; flow files of mixed encodings in one scan; quantiles of counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtally.operators import split
from flowtally.operators.ordered import counted_quantiles
from flowtally.plans import jobs
from flowtally.schema import RAW_HEADERS
from flowtally.sources import flows


@pytest.mark.parametrize("digits", [(16, 16), (8, 8, 8, 8), (4, 12, 16)])
def test_radix_cut_is_the_order_by_hash(spark, monkeypatch, digits):
    monkeypatch.setattr(split, "DIGITS", digits)
    df = spark.range(3000).select((F.col("id") * 7919 + F.col("id") * (1 << 33)).alias("k"), (F.col("id") % 3).alias("s"))
    rows = [(r.k, r.s, r.h) for r in df.withColumn("h", split.mixed_hash(F.col("k"), 5)).collect()]
    for fraction in (0.0, 0.123, 0.8, 1.0):
        want = {k for k, _, _ in sorted(rows, key=lambda r: (r[2], r[0]))[:int(3000 * fraction)]}
        for parts in (1, 7):
            got = {r.k for r in split.exact_split(df.repartition(parts), "k", fraction, 5).where("is_train").collect()}
            assert got == want
    strat = split.stratified_split(df, "s", "k", 0.7, 5).where("is_train").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in strat} == {0: 700, 1: 700, 2: 700}


def test_content_split_is_exact_and_follows_from_the_rows(spark):
    """Most rows are copies of one; the split does not depend on parts or on the order of rows."""
    pdf = pd.DataFrame({"a": [1.0] * 700 + list(np.arange(300.0)) + [None] * 50, "b": ["x"] * 700 + ["y"] * 350})
    df = spark.createDataFrame(pdf)
    tallies = []
    for rows in (df, df.repartition(9), df.orderBy(F.rand(4)).coalesce(1)):
        for seed in (1, 2):
            done = split.content_split(rows, 0.8, seed)
            assert done.columns == ["a", "b", "is_train"] and done.where("is_train").count() == int(1050 * 0.8) and done.count() == 1050
            tallies.append((seed, sorted(map(str, done.groupBy("a", "b", "is_train").count().collect()))))
    for seed in (1, 2):
        assert len({str(t) for s, t in tallies if s == seed}) == 1
    assert split.content_split(df, 0.0).where("is_train").count() == 0 and split.content_split(df, 1.0).where("is_train").count() == 1050


DASHES = {"utf.csv": ("utf-8", " Web Attack – XSS"), "one.csv": ("latin-1", " Web Attack \x96 XSS"), "plain.csv": ("ascii", "BENIGN"), "odd.csv": ("latin-1", "caf\xe9")}


@pytest.fixture
def mixed(tmp_path):
    header = ",".join(h.removesuffix(".1") for h, _ in RAW_HEADERS)
    for k, (name, (encoding, label)) in enumerate(DASHES.items()):
        lines = [header, *[",".join([*(str(i + j) for j in range(78)), label]) for i in range(k, 40)]]
        (tmp_path / name).write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(tmp_path)


def test_encodings_in_one_scan(spark, mixed, tmp_path):
    rows = flows.read_flow_csvs(spark, mixed)
    label = rows.columns[-1]
    tally = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    assert tally == {v[1]: 40 - k for k, v in enumerate(DASHES.values())}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "Union" not in plan
    more = tmp_path / "deep"
    more.mkdir()
    (more / "more.csv").write_bytes((tmp_path / "utf.csv").read_bytes())
    assert flows.read_flow_csvs(spark, mixed).count() == rows.count() and flows.read_flow_csvs(spark, mixed, recursive=True).count() == rows.count() + 40


def test_both_dashes_are_one_label_after_ingest(spark, mixed, tmp_path):
    jobs.ingest(spark, mixed, str(tmp_path / "out"))
    both = spark.read.parquet(str(tmp_path / "out"))
    assert {r.label_str: r["count"] for r in both.groupBy("label_str").count().collect()} == {"Web Attack - XSS": 40 + 39, "BENIGN": 38}


def test_quantiles_of_counts(spark):
    rng = np.random.default_rng(2)
    v = np.r_[rng.integers(0, 30, 4000), np.full(3000, 11), rng.normal(size=500)]
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], len(v), p=[0.9, 0.1]), "v": v.astype(float)})
    counts = spark.createDataFrame(pdf).groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    named = {"low": 0.0, "half": 0.5, "most": 0.95, "all": 1.0}
    for r in counted_quantiles(counts, ["g"], "v", "n", named, 13).collect():
        assert [r[n] for n in named] == pytest.approx(np.quantile(pdf[pdf.g == r.g].v, list(named.values())), abs=1e-9)


def test_caps_rank_keys_only_and_count_copies(spark):
    rows = [("a", i // 3, "x" * 50) for i in range(30)] + [("b", 7, "same")] * 9 + [(None, None, None)] * 4 + [("c", 1, "one")]
    df = spark.createDataFrame(rows, "g string, k int, text string").repartition(5)
    got = split.cap_per_group(df, "g", "k", 5).collect()
    assert sorted((r.g, r.k, r["rank"]) for r in got if r.g) == [("a", 0, 1), ("a", 0, 2), ("a", 0, 3), ("a", 1, 4), ("a", 1, 5), *[("b", 7, i) for i in range(1, 6)], ("c", 1, 1)]
    assert sorted(r["rank"] for r in got if r.g is None) == [1, 2, 3, 4]
