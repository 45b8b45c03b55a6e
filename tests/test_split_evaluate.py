import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtally.operators import evaluate, split


def test_exact_split(spark):
    df = spark.range(1003).withColumn("g", F.when(F.col("id") % 10 == 0, "few").otherwise("many"))
    a = split.exact_split(df, "id").collect()
    assert sum(r.is_train for r in a) == 802 and len(a) == 1003
    assert {r.id for r in a if r.is_train} == {r.id for r in split.exact_split(df.repartition(7), "id").collect() if r.is_train}
    assert {r.id for r in a if r.is_train} != {r.id for r in split.exact_split(df, "id", seed=7).collect() if r.is_train}
    s = split.stratified_split(df, "g", "id").groupBy("g").agg(F.count_if("is_train").alias("t")).collect()
    assert {r.g: r.t for r in s} == {"few": 71, "many": 631}
    assert split.exact_split(df.where("id < 0"), "id").count() == 0
    assert split.exact_split(df, "id", 0.0).where("is_train").count() == 0


def test_split_keeps_copies_together(spark):
    df = spark.range(300).withColumn("k", F.when(F.col("id") < 100, 7).otherwise(F.col("id")))
    got = split.exact_split(df, "k", 0.5).collect()
    assert len({r.is_train for r in got if r.k == 7}) == 1 and 150 <= sum(r.is_train for r in got) < 250


def test_split_narrow(spark):
    plan = split.exact_split(spark.range(1000), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Exchange" not in plan


def test_samples_folds_caps(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert [r.id for r in split.seeded_sample(df, "id", 5).collect()] == [r.id for r in split.seeded_sample(df.repartition(5), "id", 5).collect()]
    folds = split.with_fold(df, "id").groupBy("fold").count().collect()
    assert len(folds) == 5 and all(150 < r["count"] < 250 for r in folds)
    capped = split.cap_per_group(df, "g", "id", 4).collect()
    assert sorted(r.id for r in capped) == list(range(12))


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"positive": rng.integers(0, 2, 300), "score": rng.integers(0, 40, 300) / 40.0})
    return pdf, spark.createDataFrame(pdf)


def test_area_and_precision(scored):
    pdf, df = scored
    pos, neg = pdf[pdf.positive == 1].score.values, pdf[pdf.positive == 0].score.values
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert evaluate.roc_auc(df).first().roc_auc == pytest.approx(auc)
    ap, last = 0.0, 0.0
    points = []
    for t in sorted(pdf.score.unique(), reverse=True):
        flagged = pdf[pdf.score >= t]
        p, r = flagged.positive.mean(), flagged.positive.sum() / pdf.positive.sum()
        ap += (r - last) * p
        last = r
        points.append((2 * p * r / (p + r + 1e-8), -t))
    assert evaluate.average_precision(df).first().avg_precision == pytest.approx(ap)
    row = evaluate.evaluate_detector(df).first()
    assert (row.roc_auc, row.best_f1, -row.best_threshold) == pytest.approx((auc, *max(points)))


def test_one_outcome_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "positive int, score double")
    assert evaluate.roc_auc(df).count() == 0
    df = spark.createDataFrame([(0, 0.2), (0, 0.4)], "positive int, score double")
    assert evaluate.average_precision(df).count() == 0 and evaluate.best_f1(df).first().best_threshold == 0.5


def test_report(spark):
    rows = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)]
    df = spark.createDataFrame(rows, "label int, prediction int")
    got = {r["name"]: r for r in evaluate.classification_report(df, classes=range(4), names={0: "BENIGN"}).collect()}
    assert list(got) != [] and got["BENIGN"].precision == pytest.approx(6 / 7) and got["BENIGN"].recall == pytest.approx(6 / 8)
    assert (got["Class_2"].precision, got["Class_2"].recall, got["Class_2"].f1, got["Class_2"].support) == (0, 0, 0, 1)
    assert got["Class_3"].support == 0 and got["micro avg"].f1 == pytest.approx(9 / 12)
    f = [2 * 6 / 15, 2 * 3 / 8, 0, 0]
    assert got["macro avg"].f1 == pytest.approx(sum(f) / 4)
    assert got["weighted avg"].f1 == pytest.approx((f[0] * 8 + f[1] * 3) / 12)
    assert evaluate.macro_f1(df).first().f1_macro == pytest.approx(sum(f[:3]) / 3)


def test_macro_ovr_skips_absent_classes(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1, 0.0]), (1, [0.2, 0.8, 0.0]), (0, [0.4, 0.6, 0.0])], "label int, probabilities array<double>")
    row = evaluate.macro_ovr(df).first()
    assert row.roc_auc_macro == pytest.approx(1.0) and row.auc_pr_macro == pytest.approx(1.0)
