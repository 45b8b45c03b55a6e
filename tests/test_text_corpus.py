import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowtally.functions import text as tx
from flowtally.operators.textclf import labelled_texts
from flowtally.schema import CWE_LABELS, VULNERABILITY_DDL
from flowtally.sources import corpus
from flowtally.sources.versions import VersionedTable, latest


def pieces(text):
    out = []
    for lo in range(0, len(text), 1792):
        if text[lo:lo + 2048].strip():
            out.append(text[lo:lo + 2048].strip())
    return out


@pytest.mark.parametrize("text", ["x" * 4500, "x" * 1900, "", "  \n\t ", "é" * 1792 + " " * 300, " a " * 900, "\xa0lead" + "y" * 2048, "z" * 1792])
def test_chunks(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(tx.chunks(F.col("t")).alias("c")).first().c
    assert got == pieces(text)


def vulnerability(i, lang="en", desc="A long enough description of the flaw.", metrics=None, weaknesses=(), published="2023-05-06T00:00"):
    cve = {"descriptions": [{"lang": "fr", "value": "non"}, {"lang": lang, "value": desc}], "metrics": metrics or {},
           "weaknesses": [{"description": [{"lang": w[0], "value": w[1]} for w in ws]} for ws in weaknesses], "published": published}
    return {"cve": cve | ({"id": i} if i else {})}


def score(s, sev):
    return [{"cvssData": {"baseScore": s, "baseSeverity": sev}}]


VULNS = [
    vulnerability("CVE-1", metrics={"cvssMetricV31": score(9.8, "CRITICAL"), "cvssMetricV2": score(5.0, "MEDIUM")},
                  weaknesses=[[("en", "CWE-1"), ("es", "CWE-79")], [("en", "CWE-89")]]),
    vulnerability("CVE-2", metrics={"cvssMetricV31": [], "cvssMetricV2": score(5.0, None)}, weaknesses=[[("en", "OTHER"), ("en", "CWE-22")]]),
    vulnerability("CVE-3", lang="de", metrics={"cvssMetricV30": score(0.0, "NONE")}),
    vulnerability(None, desc="short"),
]


@pytest.fixture
def vulns(spark, folder):
    (open(folder + "/page.json", "w")).write(json.dumps({"totalResults": 4, "vulnerabilities": VULNS}, indent=1))
    return corpus.read_vulnerability_pages(spark, folder)


def test_extract(vulns):
    got = {r.cve_id: r for r in corpus.vulnerability_records(vulns).collect()}
    assert got["CVE-1"].text == ("CVE ID: CVE-1\nDescription: A long enough description of the flaw.\nWeaknesses: CWE-1, CWE-89\n"
                                 "CVSS Score: 9.8 (CRITICAL)")
    assert (got["CVE-1"].score, got["CVE-1"].severity, got["CVE-1"].published) == (9.8, "CRITICAL", "2023-05-06")
    assert got["CVE-2"].text.endswith("CVSS Score: 5.0 (None)") and got["CVE-2"].severity == "UNKNOWN"
    assert got["CVE-3"].text == "CVE ID: CVE-3\nDescription: " and got["CVE-3"].score == 0.0 and got["CVE-3"].severity == "NONE"
    assert got["UNKNOWN"].cwes == [] and str(got["UNKNOWN"].published_date) == "2023-05-06"


def test_search_and_years(spark, folder, vulns):
    r = corpus.search_vulnerabilities(vulns, "ENOUGH", 1).collect()
    assert [(x.cve_id, x.cvss_score, x.published) for x in r] == [("CVE-1", 9.8, "2023-05-06")]
    assert corpus.read_vulnerability_pages(spark, folder, [2022]).count() == 0


def test_labels(vulns):
    got = {r.cve_id: r.label for r in labelled_texts(vulns).collect()}
    assert got == {"CVE-1": CWE_LABELS.index("CWE-79"), "CVE-2": CWE_LABELS.index("CWE-22")}
    assert labelled_texts(vulns, max_per_year=1).count() <= 1


def test_vulnerability_chunks(vulns):
    c = corpus.chunk_metadata(corpus.vulnerability_chunks(vulns)).where("cve_id = 'CVE-1'").first()
    assert c.id == "CVE-1_chunk0" and c.metadata["cwes"] == '["CWE-1","CWE-89"]' and c.metadata["source"] == "nvd"


def test_corpus_folder(spark, folder):
    item = {"cve_id": "CVE-9", "title": "T", "description": "D", "mitigation": "patch", "cwes": ["CWE-20"], "cvss_score": 7.5, "severity": "HIGH"}
    files = {"a.json": json.dumps([item, {"title": "bare"}]), "b.json": "{broken", "c.json": '{"not": "a list"}', "d.txt": "plain " * 500, "e.csv": "no"}
    for name, body in files.items():
        open(f"{folder}/{name}", "w").write(body)
    got = {(r.source, r.item_no): r for r in corpus.corpus_records(spark, folder).collect()}
    assert set(got) == {("a.json", 0), ("a.json", 1), ("b.json", 0), ("c.json", 0), ("d.txt", 0)}
    assert got["a.json", 0].text == ("Identifier: CVE-9\nTitle: T\nAttack Type: \nDescription: D\nWeaknesses: CWE-20\n"
                                     "CVSS Score: 7.5 (HIGH)\nMitigation & Remediation: patch")
    assert got["a.json", 1].cve_id == "a" and got["a.json", 1].severity == "UNKNOWN"
    assert got["b.json", 0].text == "{broken" and got["d.txt", 0].cve_id == "d"
    chunks = corpus.corpus_chunks(corpus.corpus_records(spark, folder))
    assert chunks.select("id").distinct().count() == chunks.count() == 6


def test_upsert(spark, folder):
    store = VersionedTable(spark, folder + "/t")
    assert store.version() == 0
    with pytest.raises(FileNotFoundError):
        store.read()
    rows = lambda *r: spark.createDataFrame(list(r), "id string, doc string, v int, seq int")
    store.upsert(rows(("d_0", "d", 1, 1), ("d_0", "d", 2, 2), ("d_1", "d", 3, 1), ("e_0", "e", 4, 1)), order="seq")
    assert {(r.id, r.v) for r in store.read().collect()} == {("d_0", 2), ("d_1", 3), ("e_0", 4)}
    store.upsert(rows(("d_0", "d", 9, 1)), order="seq", replace_by="doc")
    assert {(r.id, r.v) for r in store.read().collect()} == {("d_0", 9), ("e_0", 4)}
    store.rewrite(lambda df: df.withColumn("v", F.col("v") + 1))
    assert store.version() == 3 and {r.v for r in store.read().collect()} == {10, 5}
    assert latest(rows(("a", "x", 1, 1)), "id", None).count() == 1


def test_ids_trace_tokens(spark):
    df = spark.createDataFrame([("CVE-2021-44228, CVE-2014-0160 and CVE-2021-44228; cve-2020-1",)], "t string")
    assert df.select(tx.cve_ids(F.col("t")).alias("i")).first().i == ["CVE-2021-44228", "CVE-2014-0160"]
    ids, mask = tx.padded_tokens(tx.words(F.col("t")), 4)
    row = df.select(ids.alias("i"), mask.alias("m")).first()
    assert row.i == ["cve", "2021", "44228", "cve"] and row.m == [1, 1, 1, 1]
    ids, mask = tx.padded_tokens(F.array(F.lit("a")), 3)
    assert tuple(df.select(ids, mask).first()) == (["a", "[PAD]", "[PAD]"], [1, 0, 0])


def test_ddl(spark):
    assert spark.createDataFrame([], VULNERABILITY_DDL).schema["cve"].dataType["published"].dataType.typeName() == "string"


def test_own_tokenizer(spark):
    @F.pandas_udf("array<string>")
    def letters(t: pd.Series) -> pd.Series:
        return t.map(list)

    r = tx.encode_tokens(spark.createDataFrame([("abc",)], "t string"), "t", 4, letters).first()
    assert r.tokens == ["a", "b", "c", "[PAD]"] and r.attention_mask == [1, 1, 1, 0]


def test_search_many(vulns):
    r = corpus.search_many(vulns, ["enough", "SHORT", "absent"], 1).collect()
    assert {(x.keyword, x.cve_id, x["rank"]) for x in r} == {("enough", "CVE-1", 1), ("SHORT", None, 1)}


def test_pieces_are_searched_for_blanks_only_where_an_end_is_blank(spark):
    """Chunks of odd texts are those of a plain trim of every piece, and whole pieces are not searched."""
    blanks = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", " ", " ", " ", "　"]
    texts = [None, "", "x", *blanks, *[f"{b}a{b}b{b}" for b in blanks], "".join(blanks), "abcdef" + "\n\n\x85", "\U0001f600 \U0001f600", "  ab cd  ef gh " * 5, "​ a ﻿"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    size, step = 3 * tx.CHARS_PER_TOKEN, 2 * tx.CHARS_PER_TOKEN
    got = {r["i"]: r["p"] for r in df.select("i", tx.chunks(F.col("t"), 3, 1).alias("p")).collect()}
    cut = "".join(blanks) + "\x1d\x1e\x1f"
    for i, t in enumerate(texts):
        assert got[i] == [p for p in ((t or "")[k:k + size].strip(cut) for k in range(0, max(len(t or "") - 1, 0) + 1, step)) if p]
    plan = df.select(tx.chunks(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan  # before, every piece was searched whole
