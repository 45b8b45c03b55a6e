import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtally.operators.ensemble import TreeSettings
from flowtally.operators.monitor import DriftBaseline, latency_percentiles
from flowtally.plans import jobs
from flowtally.schema import RAW_HEADERS
from flowtally.sources import flows, runs
from flowtally.streaming import jobs as streams


def write_csv(path, rows, encoding):
    header = ",".join(h.removesuffix(".1") for h, _ in RAW_HEADERS)
    lines = [",".join([*(str(v) for v in values), label]) for values, label in rows]
    path.write_bytes(("\n".join([header, *lines]) + "\n").encode(encoding))


@pytest.fixture
def raw_folder(tmp_path):
    rng = np.random.default_rng(0)
    folder = tmp_path / "raw"
    folder.mkdir()
    day = [(rng.integers(0, 100, 78).tolist(), "BENIGN" if i % 3 else "DDoS") for i in range(120)]
    day[0][0][14] = "Infinity"
    day[1][0][2] = "abc"
    write_csv(folder / "a.csv", day, "utf-8")
    write_csv(folder / "b.csv", [(rng.integers(0, 100, 78).tolist(), " Web Attack \x96 XSS") for _ in range(30)] * 2, "latin-1")
    (folder / "notes.txt").write_text("not a table")
    return str(folder)


def test_ingest_train_score(spark, raw_folder, tmp_path):
    enc = {r.file.rsplit("/", 1)[-1]: r.encoding for r in flows.csv_encodings(spark, raw_folder).collect()}
    assert enc == {"a.csv": "UTF-8", "b.csv": "ISO-8859-1"}
    out, models = str(tmp_path / "out"), str(tmp_path / "models")
    stats = jobs.ingest(spark, raw_folder, out).collect()
    train, val = flows.read_splits(spark, out)
    assert train.count() == int(178 * 0.8) and val.count() == 178 - int(178 * 0.8)
    assert {r.label_str for r in stats} == {"BENIGN", "DDoS", "Web Attack - XSS"} and sum(r.n for r in stats) == train.count()
    assert len(train.columns) == 78 + 2 + 11
    quality = jobs.train(spark, out, models, TreeSettings(trees=2, depth=3), latent=8)
    assert set(quality) >= {"roc_auc_macro", "auc_pr_macro", "f1_macro", "anomaly_roc_auc", "anomaly_best_f1"}
    logged = spark.read.parquet(models + "/runs")
    assert {r.kind for r in logged.collect()} == {"param", "metric", "step"}
    assert spark.read.text(models + "/report").count() == 3 + 3


def test_no_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        flows.read_flow_csvs(spark, str(tmp_path))


def test_tables(spark, folder):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, label_str string")
    flows.write_csv(df, folder + "/csv")
    assert spark.read.option("header", True).csv(folder + "/csv").count() == 2
    df.write.parquet(folder + "/p")
    assert flows.assert_output(spark, folder + "/p") == 2 and flows.assert_artifacts(spark, folder + "/p") > 0
    with pytest.raises(FileNotFoundError):
        flows.assert_artifacts(spark, folder + "/p", "*.joblib")
    with pytest.raises(ValueError):
        flows.assert_output(spark, folder + "/p", 3)
    both = flows.union_all([df, df.select("x")])
    assert both.count() == 4 and both.where("label_str IS NULL").count() == 2


def test_metrics_and_test_sets(spark, folder):
    df = spark.createDataFrame([("a", 1.5, 2)], "svc string, p50 double, total int")
    rows = runs.metric_rows(df, {"Latency_p50": (F.col("p50"), "Milliseconds"), "TotalRequests": (F.col("total"), "Count")}, {"service": F.col("svc")})
    runs.put_metrics(rows, folder + "/m")
    runs.put_metrics(rows, folder + "/m")
    got = spark.read.parquet(folder + "/m").collect()
    assert len(got) == 4 and got[0].dimensions == {"service": "a"} and {r.unit for r in got} == {"Milliseconds", "Count"}
    open(folder + "/t.json", "w").write(json.dumps([{"question": "q1", "ground_truth": "g"}, {"question": "q2"}]))
    assert [r.ground_truth for r in runs.read_test_set(spark, folder + "/t.json").collect()] == ["g", ""]
    open(folder + "/l.json", "w").write(json.dumps([{"text": "t", "label": 3}]))
    assert runs.read_labelled_texts(spark, folder + "/l.json").first().label == 3
    runs.write_scores(df, folder + "/s")
    assert spark.read.json(folder + "/s").count() == 1


def test_corpus_job(spark, tmp_path):
    src = tmp_path / "corpus"
    src.mkdir()
    (src / "a.json").write_text(json.dumps([{"cve_id": "CVE-1", "description": "x" * 5000}, {"cve_id": "CVE-2"}]))
    n = jobs.build_corpus(spark, str(src), str(tmp_path / "table"))
    assert n == 4 and jobs.build_corpus(spark, str(src), str(tmp_path / "table")) == 4
    (src / "a.json").write_text(json.dumps([{"cve_id": "CVE-1", "description": "short"}]))
    assert jobs.build_corpus(spark, str(src), str(tmp_path / "table")) == 2


def test_sql_functions(spark):
    jobs.register_functions(spark)
    row = spark.sql("SELECT anomaly_score(2D, 2D) AS a, anomaly_score(3D, NULL) AS b, cve_ids('CVE-2021-1 CVE-2021-1 x') AS c").first()
    assert tuple(row) == (0.5, 3.0, ["CVE-2021-1"])
    spark.createDataFrame([("CVE-1", "Heap overflow", 1.0, "2023-01-01"), ("CVE-2", "other", 2.0, "")],
                          "cve_id string, text string, score double, published string").createOrReplaceTempView("records")
    jobs.register_search(spark, "records")
    assert [r.cve_id for r in spark.sql("SELECT * FROM cve_search('OVERFLOW')").collect()] == ["CVE-1"]
    spark.createDataFrame([(i, f"d{i}", [float(i), 0.0]) for i in range(9)], "id bigint, document string, embedding array<double>").createOrReplaceTempView("held")
    jobs.register_retrieval(spark, "held", 2)
    assert [(r.id, r.distance) for r in spark.sql("SELECT * FROM nearest_chunks(array(2.2D, 0D))").collect()] == [(2, pytest.approx(0.04)), (3, pytest.approx(0.64))]


@pytest.fixture
def events(spark, tmp_path):
    rng = np.random.default_rng(4)
    start = dt.datetime(2024, 1, 1)
    pdf = pd.DataFrame({"event_id": np.arange(900), "ts": [start + dt.timedelta(seconds=int(s)) for s in np.sort(rng.integers(0, 7200, 900))],
                        "svc": rng.choice(["a", "a", "a", "b"], 900), "v": rng.random(900).round(2)})
    folder = str(tmp_path / "in")
    df = spark.createDataFrame(pdf)
    df.where("event_id < 500").coalesce(1).write.parquet(folder)
    df.where("event_id >= 500").coalesce(1).write.mode("append").parquet(folder)
    return df, folder


def test_stream_metrics_equal_batch(spark, events, tmp_path):
    df, folder = events
    s = streams.event_stream(spark, folder, "*.parquet")
    got = streams.request_metrics_stream(s, ["svc"], "v", F.col("v") > 0.9, str(tmp_path / "m"), late="1 minute").toPandas()
    minute = df.withColumn("w", F.window("ts", "60 seconds")["start"])
    want = latency_percentiles(minute, ["w", "svc"], "v", F.col("v") > 0.9).toPandas()
    last = df.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=1)
    want = want.sort_values(["w", "svc"])
    got = got.sort_values(["window_start", "svc"])
    assert len(got) == len(want) > 50
    assert got.is_closed.tolist() == (want.w + pd.Timedelta(minutes=1) <= last).tolist() and not got.is_closed.all()
    for c in ("p50_ms", "p95_ms", "p99_ms", "error_rate", "total_requests"):
        assert got[c].tolist() == pytest.approx(want[c].tolist())


def test_stream_drift_and_scores(spark, events, tmp_path):
    df, folder = events
    base = DriftBaseline.from_scores(df, F.col("v"))
    s = streams.event_stream(spark, folder, "*.parquet")
    got = {r.window_label: r for r in streams.drift_stream(s, F.col("v"), base, str(tmp_path / "d"), every="30 minutes", late="1 minute").collect()}
    half = df.withColumn("w", F.window("ts", "30 minutes")["start"])
    want = {r.window_label: r for r in base.check_scores(half, F.col("v"), "w").collect()}
    assert got.keys() == want.keys() and all(got[k].kl_divergence == want[k].kl_divergence for k in got)
    assert sum(r.is_closed for r in got.values()) == 3 < len(got)
    scored = streams.score_stream(s, lambda d: d.withColumn("twice", F.col("v") * 2), str(tmp_path / "s"))
    assert scored.count() == 900 and scored.agg(F.sum(F.col("twice") - 2 * F.col("v"))).first()[0] == 0


@pytest.mark.parametrize("compact_every", [1, 2, 20])
def test_stream_last_n_over_runs(spark, events, tmp_path, compact_every):
    df, folder = events

    def run():
        s = streams.event_stream(spark, folder, "*.parquet")
        return streams.last_n_stream(s, "svc", ["ts", "event_id"], 4, str(tmp_path / "l"), compact_every)

    want = df.toPandas().sort_values(["ts", "event_id"]).groupby("svc").tail(4)
    assert sorted(r.event_id for r in run().collect()) == sorted(want.event_id)
    for i in range(2):
        late = df.limit(1).withColumns({"ts": F.expr(f"ts + INTERVAL {9 + i} HOURS"), "event_id": F.lit(5000 + i).cast("bigint"), "svc": F.lit("b")})
        late.write.mode("append").parquet(folder)
        ids = {r.event_id for r in run().where("svc = 'b'").collect()}
        assert len(ids) == 4 and 5000 + i in ids
    assert {5000, 5001} <= ids
