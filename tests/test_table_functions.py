"""Table functions next to the DataFrame forms they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.operators.anomaly import AnomalyDetector
from flowtally.operators.ensemble import TreeSettings, fit_soft_vote
from flowtally.operators.knn import knn_exact
from flowtally.plans import jobs
from flowtally.plans import table_functions as tf

NAMES = ["f0", "f1", "f2", "f3"]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] + x[:, 1] > 0.4, 4, np.where(x[:, 2] > 0, 9, 0))
    rows = [[*map(float, v), int(c), int(k)] for v, c, k in zip(x, y, range(300))]
    rows[0][0], rows[1][2], rows[2][1] = None, float("nan"), float("inf")
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES) + ", label int, key bigint").repartition(3).persist()
    sound = df.where("abs(f1) < 100")
    detector = AnomalyDetector(NAMES, 2)
    detector.fit(sound)
    return df, fit_soft_vote(sound, NAMES, "label", TreeSettings(trees=3, depth=3)), detector


def test_scores_equal_the_job(spark, fitted):
    df, model, detector = fitted
    want = {r.key: r for r in jobs.score(df, model, detector, top_n=0).collect()}
    for query in ("SELECT * FROM score_flows(TABLE(flows))", "SELECT * FROM score_flows(TABLE(flows) PARTITION BY label)"):
        df.createOrReplaceTempView("flows")
        tf.register_scoring(spark, model, detector)
        got = spark.sql(query)
        assert got.columns == [*df.columns, "prediction", "label_id", "confidence", "anomaly_score", "is_anomaly"]
        rows = got.collect()
        assert len(rows) == 300
        for r in rows:
            w = want[r.key]
            assert (r.prediction, r.label_id, r.is_anomaly) == (w.prediction, w.label_id, w.is_anomaly)
            assert (r.confidence, r.anomaly_score) == (pytest.approx(w.confidence, abs=2e-4), pytest.approx(w.anomaly_score, abs=2e-4))


def test_absent_features_no_detector_and_no_rows(spark, fitted):
    df, model, _ = fitted
    got = tf.score_table(spark, df.select("key", "f0"), model).collect()
    want = {r.key: r for r in jobs.score(df.select("key", "f0"), model, top_n=0).collect()}
    assert len(got) == 300 and all(r.label_id == want[r.key].label_id and r.anomaly_score == 0 and not r.is_anomaly for r in got)
    assert tf.score_table(spark, df.where("key < 0"), model).count() == 0
    with pytest.raises(Exception, match="already"):
        tf.score_table(spark, df.withColumn("prediction", F.lit(1)), model).collect()


def test_search(spark):
    spark.createDataFrame([(1, "An Overflow in x"), (2, None), (3, "nothing"), (4, "OVERFLOW")], "id int, text string").createOrReplaceTempView("records")
    tf.register_table_search(spark)
    assert sorted(r.id for r in spark.sql("SELECT * FROM rows_with(TABLE(records), 'overflow')").collect()) == [1, 4]
    assert spark.sql("SELECT * FROM rows_with(TABLE(records), NULL)").count() == 0


def test_retrieval(spark, monkeypatch):
    monkeypatch.setattr(tf, "BATCH", 7)
    x = np.random.default_rng(2).normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist() if i != 9 else None) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(4)
    df.createOrReplaceTempView("chunks")
    tf.register_table_retrieval(spark)
    asked = "array(" + ", ".join("array(" + ", ".join(f"{v}D" for v in x[i]) + ")" for i in (3, 20)) + ")"
    got = spark.sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY distance, id) AS rank FROM nearest_rows(TABLE(chunks), {asked}, 4)) WHERE rank <= 4").collect()
    want = knn_exact(df.where("id in (3, 20)"), df, 4).collect()
    assert {((3, 20)[r.query_no], r["rank"], r.id) for r in got} == {(r.query_id, r["rank"], r.chunk_id) for r in want}


def test_rows_are_scored_column_by_column(spark, fitted, monkeypatch):
    """A row's fields are not looked up by name one by one; whole numbers, gaps and flags come through."""
    from pyspark.sql.types import Row
    df, model, detector = fitted
    made, plain = {}, F.udtf
    monkeypatch.setattr(tf.F, "udtf", lambda cls: made.update({"run": cls}) or plain(cls))
    tf.register_scoring(spark, model, detector)
    monkeypatch.setattr(Row, "__getitem__", lambda *_: pytest.fail("looked up by name"))
    run = made["run"]()
    rows = [Row(f0=None, f1=1, f2=True, f3=0.5, key="a"), Row(f0=2.0, f1=None, f2=False, f3=float("nan"), key="b")]
    assert [list(run.eval(r)) for r in rows] == [[], []]
    out = list(run.terminate())
    assert [r[4] for r in out] == ["a", "b"] and all(len(r) == 10 and isinstance(r[6], int) and isinstance(r[9], bool) for r in out)


def test_batches_are_scored_as_single_rows_are(spark, fitted):
    df, model, detector = fitted
    tf.register_scoring(spark, model, detector)
    single = spark.sql("SELECT * FROM score_flows(TABLE(SELECT * FROM {flows}))", flows=df)
    batches = tf.score_table(spark, df, model, detector)
    assert batches.schema == single.schema
    assert sorted(map(str, batches.collect())) == sorted(map(str, single.collect()))
    plan = batches._jdf.queryExecution().toString()
    assert "ArrowEvalPythonUDTF" in plan and "BatchEvalPythonUDTF" not in plan


def test_rounding_goes_by_the_number():
    values = np.array([0.12345, 0.00005, 0.99995, 0.5, 0.33335000000000004, -0.00015])
    assert tf.rounded(values).tolist() == [round(v, 4) for v in values.tolist()]
