"""Rows that an earlier form lost: gaps in features, equal ids of two sources, questions without a vector."""
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.functions.flow_features import add_flow_features
from flowtally.operators import knn
from flowtally.operators.anomaly import AnomalyDetector
from flowtally.operators.retrieval import answer_records, retrieve
from flowtally.operators.split import stratified_fold
from flowtally.plans import jobs
from flowtally.sources.versions import VersionedTable


def test_detector_scores_rows_with_gaps(spark):
    rows = [(i, float(i % 7), None if i % 8 == 0 else float(i % 5), float("nan") if i % 9 == 0 else 1.0 + i % 3, float("inf") if i == 5 else 2.0 * (i % 4)) for i in range(57)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    detector = AnomalyDetector(["a", "b", "c", "d"], 2)
    detector.fit(df)
    got = detector.score(df).collect()
    assert sorted(r["id"] for r in got) == list(range(57))
    assert all(0 <= r["anomaly_score"] <= 1 and r["reconstruction_error"] >= 0 and r["is_anomaly"] is not None for r in got)
    assert detector.encode(df).count() == 57


def test_a_null_label_stays_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0, None), (None, 2.0, 3.0, 4.0, 5.0, 1)],
                               "total_fwd_packets double, total_bwd_packets double, total_len_fwd_packets double, total_len_bwd_packets double, flow_duration double, label int")
    got = add_flow_features(df).collect()
    assert {r["label"] for r in got} == {None, 1} and {r["total_fwd_packets"] for r in got} == {1.0, 0.0}


def test_two_sources_with_one_id(spark, tmp_path):
    folder, table = tmp_path / "adv", str(tmp_path / "table")
    folder.mkdir()
    (folder / "vendorA.json").write_text(json.dumps([{"cve_id": "CVE-1", "title": "first", "description": "words of A"}]))
    assert jobs.build_corpus(spark, str(folder), table) == 1
    (folder / "vendorA.json").rename(tmp_path / "kept.json")
    (folder / "vendorB.json").write_text(json.dumps([{"cve_id": "CVE-1", "title": "second", "description": "words of B"}]))
    assert jobs.build_corpus(spark, str(folder), table) == 2
    (folder / "vendorB.json").write_text(json.dumps([{"cve_id": "CVE-1", "title": "third", "description": "x"}]))
    assert jobs.build_corpus(spark, str(folder), table) == 2
    texts = " ".join(r["document"] for r in VersionedTable(spark, table).read().collect())
    assert "words of A" in texts and "third" in texts and "words of B" not in texts


def test_feed_and_advisories_share_a_table(spark, tmp_path):
    def page(text, published):
        return {"vulnerabilities": [{"cve": {"id": "CVE-2020-1", "published": published, "descriptions": [{"lang": "en", "value": text}], "metrics": {}, "weaknesses": []}}]}

    feed, adv, table = tmp_path / "feed", tmp_path / "adv", str(tmp_path / "table")
    feed.mkdir()
    adv.mkdir()
    (feed / "1.json").write_text(json.dumps(page("old text", "2020-01-01T00:00:00.000")))
    (feed / "2.json").write_text(json.dumps(page("new text", "2020-02-01T00:00:00.000")))
    (adv / "a.json").write_text(json.dumps([{"cve_id": "CVE-2020-1", "title": "t", "description": "advice"}]))
    assert jobs.build_feed(spark, str(feed), table) == 1
    assert jobs.build_corpus(spark, str(adv), table) == 2
    assert jobs.build_feed(spark, str(feed), table) == 2
    texts = " ".join(r["document"] for r in VersionedTable(spark, table).read().collect())
    assert "new text" in texts and "advice" in texts and "old text" not in texts


@pytest.mark.parametrize("limit", [0, 4096])
def test_neighbours_by_string_ids_and_without_vectors(spark, limit):
    chunks = spark.createDataFrame([("c1_chunk0", [1.0, 0.0], "one", "s"), ("c2_chunk0", [0.0, 1.0], "two", "s"), ("c2_chunk1", [0.0, 1.0], "more", "t"), ("c3", None, "x", "u")],
                                   "id string, embedding array<double>, document string, cve_id string")
    asked = spark.createDataFrame([("q1", [0.1, 1.0], "?"), ("q2", None, "?")], "id string, embedding array<double>, question string")
    got = [(r["query_id"], r["rank"], r["chunk_id"]) for r in knn.knn_exact(asked, chunks, 2, query_limit=limit).orderBy("query_id", "rank").collect()]
    assert got == [("q1", 1, "c2_chunk0"), ("q1", 2, "c2_chunk1")]
    if limit:
        answers = {r["query_id"]: r for r in answer_records(asked, retrieve(asked, chunks, 2)).collect()}
        assert answers["q1"]["contexts"] == ["two", "more"] and answers["q1"]["sources"] == ["s", "t"]
        assert answers["q2"]["context_chunks"] == 0 and answers["q2"]["answer"] is not None


def test_a_broken_log_is_no_missing_table(spark, tmp_path):
    store = VersionedTable(spark, str(tmp_path / "t"))
    assert store.version() == 0
    store.write(spark.range(3))
    assert store.version() == 1 and store.read().count() == 3


def test_folds_are_even_in_every_label(spark):
    df = spark.createDataFrame([(i, "rare" if i < 11 else "usual") for i in range(500)], "k long, label string")
    counts = stratified_fold(df, ["label"], "k", 5).groupBy("label", "fold").count().collect()
    assert len(counts) == 10
    for name, n in (("rare", 11), ("usual", 489)):
        assert {r["count"] for r in counts if r["label"] == name} <= {n // 5, n // 5 + 1}
    again = stratified_fold(df.repartition(7), ["label"], "k", 5)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in stratified_fold(df, ["label"], "k", 5).collect()} and again.where(F.col("fold").isNull()).count() == 0


def test_model_queries_take_every_row(spark):
    from flowtally.plans import registered
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert registered._train(spark, sf).na.drop().count() < n
    assert sum(r["n"] for r in registered.pca_anomaly(spark, sf).collect()) == n
    rows, _ = registered._forest(spark, sf)
    assert rows.count() == n


def test_corpus_answers_over_whole_texts(spark, tmp_path):
    """The query on a small folder, next to chunks, vectors and nearest passages worked out by hand."""
    import re
    from collections import Counter

    from flowtally.plans.registered import all_queries
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.choice(words, rng.integers(40, 400))).replace("w1", "W1") for i in range(12)}
    items = {i: " ".join(rng.choice(words, 30)) for i in range(5)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i,) for i in (1, 4, 7)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.query_id: r for r in all_queries()["corpus_answers"](spark, str(tmp_path)).collect()}

    def chunks(rows, text):
        from flowtally.functions.text import explode_chunks
        return explode_chunks(spark.createDataFrame(rows, "id string, text string"), "text", "id").select("id", "document").collect()

    fitted = [r.document for r in chunks([(f"d{i}", t) for i, t in texts.items()] + [(f"i{i}", t) for i, t in items.items()], "text")]
    held = chunks([(f"doc_{i}_documents_0", t.lower() if i in (1, 4, 7) else t) for i, t in texts.items()] + [(f"item_{i}_benchmark_0", t) for i, t in items.items()], "text")
    from pyspark.ml.feature import HashingTF
    place = HashingTF(numFeatures=384)
    split = [re.findall(r"\w+", t.lower()) for t in fitted]
    df = Counter(place.indexOf(w) for t in split for w in {x: x for x in t})
    seen = Counter()
    for t in split:
        seen.update({place.indexOf(w) for w in t})

    def vector(text):
        v = np.zeros(384)
        for w in re.findall(r"\w+", text.lower()):
            v[place.indexOf(w)] += 1
        v *= np.array([np.log((len(fitted) + 1) / (seen[j] + 1)) for j in range(384)])
        return v / np.linalg.norm(v)

    import hashlib
    stored = [(r.id, vector(r.document), r.document) for r in held]
    for i, t in items.items():
        q = vector(t)
        order = sorted(stored, key=lambda s: (round(float(((s[1] - q) ** 2).sum()), 6), s[0]))[:3]
        assert got[i].contexts_md5 == [hashlib.md5(s[2].encode()).hexdigest() for s in order]
        assert got[i].context_chunks == 3 and got[i].answer is None and "item_" in got[i].sources


def test_last_record_of_a_batch_wins(spark, tmp_path):
    import json

    from flowtally.plans import jobs
    from flowtally.sources.versions import VersionedTable

    def page(*records):
        return json.dumps({"vulnerabilities": [{"cve": {"id": i, "published": p, "descriptions": [{"lang": "en", "value": t}]}} for i, p, t in records]})

    (tmp_path / "p0.json").write_text(page(("CVE-1", "2024-01-01", "old " * 300), ("CVE-2", "2024-01-01", "first"), ("CVE-2", "2024-01-01", "second")))
    (tmp_path / "p1.json").write_text(page(("CVE-1", "2024-01-01", "new"), ("CVE-3", "2023-01-01", "later page, older")))
    (tmp_path / "p2.json").write_text(page(("CVE-3", "2022-01-01", "oldest")))
    jobs.build_feed(spark, str(tmp_path), str(tmp_path / "table"))
    found = {r.cve_id: r.document for r in VersionedTable(spark, str(tmp_path / "table")).read().collect()}
    assert len(found) == 3 and "new" in found["CVE-1"] and "second" in found["CVE-2"] and "later page" in found["CVE-3"]
