import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtally.operators import monitor, requests


def hist(df, score="s"):
    return monitor.DriftBaseline.from_scores(df, F.col(score))


def test_bins_equal_numpy(spark):
    s = np.concatenate([np.arange(0, 51) / 50.0, np.arange(0, 51) * 0.02, np.random.default_rng(0).random(500), [1.0, 0.0, 0.58, 0.29]])
    df = spark.createDataFrame(pd.DataFrame({"s": np.concatenate([s, [-0.1, 1.2]])}))
    row = monitor.histograms(monitor.bin_counts(df, F.col("s"))).first()
    assert np.round(row.hist).astype(int).tolist() == np.histogram(s, bins=50, range=(0.0, 1.0))[0].tolist()
    assert row.out_of_range == 2 and row.window_size == len(s) + 2


def test_drift(spark, folder):
    base = hist(spark.createDataFrame([(0.2,)] * 500, "s double"))
    win = spark.createDataFrame([(1.0, "new")] * 100 + [(0.2, "same")] * 50 + [(1.0, "few")] * 9, "s double, w string")
    base.save(spark, folder + "/base")
    again = monitor.DriftBaseline.load(spark, folder + "/base")
    assert again.hist == base.hist and again.n_bins == 50 and again.kl_threshold == 0.1
    got = {r.window_label: r for r in again.check_scores(win, F.col("s"), "w").collect()}
    assert got["new"].kl_divergence == pytest.approx(28.43574, abs=1e-4) and got["new"].is_drifting and got["new"].window_size == 100
    assert not got["same"].is_drifting and got["same"].kl_divergence == pytest.approx(0, abs=1e-6)
    assert (got["few"].kl_divergence, got["few"].is_drifting, got["few"].reason) == (0.0, False, "insufficient data")
    monitor.append_history(again.check_scores(win, F.col("s"), "w"), folder + "/history")
    monitor.append_history(again.check_scores(win, F.col("s"), "w"), folder + "/history")
    assert spark.read.parquet(folder + "/history").count() == 6


def test_max_of_class_vector(spark):
    df = spark.createDataFrame([([0.2, 0.7, 0.1],)] * 12, "p array<double>")
    h = monitor.score_histogram(df, F.array_max("p")).where("weight > 1").collect()
    want = int(np.histogram([0.7], bins=50, range=(0.0, 1.0))[0].argmax()) + 1
    assert [(r.bin, round(r.weight)) for r in h] == [(want, 12)]


@pytest.mark.parametrize("block", [60, 10_000])
def test_rolling_blocks(spark, block):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"svc": rng.choice(["a", "a", "a", "b"], 700), "at": rng.integers(0, 300, 700), "id": np.arange(700),
                        "ms": rng.random(700) * 100})
    got = monitor.rolling_latency(spark.createDataFrame(pdf), "svc", "at", "id", "ms", rows=50, block=block).toPandas().set_index("id")
    assert len(got) == 700
    for _, g in pdf.sort_values(["at", "id"]).groupby("svc"):
        for i in (0, 10, 49, 50, 130, len(g) - 1):
            window = g.ms.values[max(0, i - 49):i + 1]
            row = got.loc[g.id.values[i]]
            assert [row.p50_ms, row.p95_ms, row.p99_ms] == pytest.approx(np.percentile(window, [50, 95, 99]).tolist())


def test_request_metrics(spark):
    df = spark.createDataFrame([("p", 1.0, False), ("p", 3.0, True), ("q", 2.0, False)], "route string, ms double, err boolean")
    r = monitor.request_summary(df, "route", "ms", F.col("err"), ["p"]).first()
    assert tuple(r) == (3, 2, 2.0, 0.3333)
    empty = monitor.request_summary(df.where("ms < 0"), "route", "ms", F.col("err"), ["p"]).first()
    assert tuple(empty) == (0, 0, 0.0, 0.0)
    p = {r.route: r for r in monitor.latency_percentiles(df, ["route"], "ms", F.col("err")).collect()}
    assert (p["p"].p50_ms, p["p"].error_rate, p["p"].total_requests) == (2.0, 0.5, 2)


def test_validation(spark):
    ok, refused = requests.split_by_reason(spark.createDataFrame([("ab",), ("What is Log4Shell?",), ("x" * 2001,), (None,)], "q string"),
                                           requests.validate_query(F.col("q")))
    assert [r.q for r in ok.collect()] == ["What is Log4Shell?"]
    assert sorted(r.reason for r in refused.collect()) == ["query missing", "query too long", "query too short"]
    f = spark.createDataFrame([({},), (None,)], "f map<string,double>").select(requests.validate_features(F.col("f")).alias("r")).collect()
    assert [r.r for r in f] == [None, "features missing"]


def test_vectors(spark):
    df = spark.createDataFrame([({"b": 2.0, "a": 1.0},)], "f map<string,double>")
    row = df.select(requests.feature_vector(F.col("f"), ["a", "b", "c"]), requests.feature_vector(F.col("f"), None)).first()
    assert row[0] == [1.0, 2.0, 0.0] and sorted(row[1]) == [1.0, 2.0]


def test_payloads(spark):
    rows = [(b'{"features": {"a": 1, "b": 2}}', None), (b"[3, 4]", None), (None, b'{"features": [5]}'), (b"", b'{"x": 6}')]
    df = spark.createDataFrame(rows, "body binary, data binary")
    got = [r.v for r in df.select(requests.payload_vector(F.col("body"), F.col("data")).alias("v")).collect()]
    assert got == [[1.0, 2.0], [3.0, 4.0], [5.0], [6.0]]
