import math

import numpy as np
import pandas as pd
import pytest

from flowtally.functions.tails import _beta_lower, _gamma_upper, log_phi
from flowtally.operators import profile, stats_tests


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 6, n).astype(float), "k": 7.0, "g": rng.choice(list("xyz"), n)})
    pdf["a2"] = pdf["a"]
    pdf["c"] = pdf["a"] * 2 + rng.normal(size=n) * 0.1
    pdf.loc[5:20, "b"] = None
    rows = pdf.astype(object).where(pdf.notna(), None).values.tolist()
    return pdf, spark.createDataFrame(rows, "a double, b double, k double, g string, a2 double, c double")


def test_missing_constant_identical(spark, frame):
    pdf, df = frame
    assert [tuple(r) for r in profile.missing_profile(df).collect()] == [("b", 16, 4.0)]
    assert profile.high_missing(df).count() == 0
    assert [r.feature for r in profile.constant_columns(df).collect()] == ["k"]
    assert [tuple(r) for r in profile.identical_columns(df).collect()] == [("a", "a2")]
    empty = spark.createDataFrame([(None, 1), (None, 1), (None, None)], "n int, m int")
    assert [r.feature for r in profile.constant_columns(empty).collect()] == ["n"]


def test_describe_and_row_gaps(frame):
    pdf, df = frame
    got = profile.describe(df, ["a", "b"]).toPandas().set_index("feature")
    want = pdf[["a", "b"]].describe()
    for f in ("a", "b"):
        assert got.loc[f].values == pytest.approx(want[f].values, abs=1e-9)
    row = profile.row_missing_profile(df).first()
    share = pdf.isna().sum(axis=1) / 6 * 100
    assert row.rows_with_missing == 16 and row["std"] == pytest.approx(share.std()) and row["mean"] == pytest.approx(share.mean())


def test_outliers_use_all_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(9)] + [(1000.0,), (None,)], "v double")
    assert profile.outlier_pct(df, ["v"]).first().outlier_pct == pytest.approx(100 / 11)


def test_correlations(frame):
    pdf, df = frame
    names = ["a", "b", "c", "k"]
    got = {(r.feature_a, r.feature_b): r.r for r in profile.correlations(df, names).collect()}
    want = pdf[names].corr()
    assert len(got) == 6
    for (x, y), r in got.items():
        assert (r is None) if "k" in (x, y) else r == pytest.approx(want.loc[x, y], abs=1e-9)
    high = profile.multicollinear(profile.correlations(df, names)).collect()
    assert [(r.feature_a, r.feature_b) for r in high] == [("a", "c")]


def test_null_loss(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), ("y", 1), ("z", None)], "label string, v int")
    got = {r.label: (r.n_before, r.n_after, r.abs_difference, r.pct_difference) for r in profile.null_loss(df, "label").collect()}
    assert got == {"x": (2, 1, 1, 50.0), "y": (1, 1, 0, 0.0), "z": (1, None, None, None)}


def ranks_h(pdf, f):
    d = pdf[[f, "g"]].dropna()
    n, r = len(d), d[f].rank()
    h = 12 / (n * (n + 1)) * sum(x.sum() ** 2 / len(x) for _, x in r.groupby(d.g)) - 3 * (n + 1)
    c = d[f].value_counts()
    return h / (1 - (c**3 - c).sum() / (n**3 - n))


def test_kruskal(frame):
    pdf, df = frame
    for r in stats_tests.kruskal_wallis(df, ["a", "b"], "g").collect():
        h = ranks_h(pdf, r.feature)
        assert r.h == pytest.approx(h) and r.p_value == pytest.approx(np.exp(-h / 2))


def test_levene(spark, frame):
    pdf, df = frame
    got = {r.feature: r for r in stats_tests.levene(df, ["a", "b", "k"], "g").collect()}
    assert set(got) == {"a", "b"}
    for f, r in got.items():
        z = [np.abs(x - x.median()) for _, x in pdf[[f, "g"]].dropna().groupby("g")[f]]
        n, k = sum(map(len, z)), len(z)
        zall = np.concatenate(z).mean()
        w = (n - k) / (k - 1) * sum(len(x) * (x.mean() - zall) ** 2 for x in z) / sum(((x - x.mean()) ** 2).sum() for x in z)
        assert r.w == pytest.approx(w) and r.p_value == pytest.approx((1 + 2 * w / (n - k)) ** (-(n - k) / 2))


def test_anderson(frame):
    pdf, df = frame
    got = {r.feature: r for r in stats_tests.anderson_darling(df, ["a", "b", "k"]).collect()}
    assert set(got) == {"a", "b"}
    for f, r in got.items():
        x = np.sort(pdf[f].dropna().values)
        w, n, i = (x - x.mean()) / x.std(ddof=1), len(x), np.arange(1, len(x) + 1)
        lo, hi = log_phi(w), log_phi(-w)
        assert r.a2 == pytest.approx(-n - ((2 * i - 1) * lo + (2 * (n - i) + 1) * hi).sum() / n)
    assert got["a"].is_normal and not got["b"].is_normal


def test_tails():
    assert _gamma_upper(0.5, 3.841458820694124 / 2) == pytest.approx(0.05)
    assert _gamma_upper(5.0, 18.307038053275146 / 2) == pytest.approx(0.05)
    assert _beta_lower(5.0, 1.0, 10 / (10 + 2 * 4.102821015)) == pytest.approx(0.05, rel=1e-6)
    assert log_phi(np.array([-40.0]))[0] == pytest.approx(-804.608442, rel=1e-6)
    w = np.linspace(-37, 8, 2000)
    plain = [math.log(0.5 * math.erfc(-x / math.sqrt(2))) if x < 5 else math.log1p(-0.5 * math.erfc(x / math.sqrt(2))) for x in w]
    assert log_phi(w) == pytest.approx(plain, rel=1e-11)
    assert np.isfinite(log_phi(np.array([-1e150, 1e150, 0.0]))[1:]).all()
