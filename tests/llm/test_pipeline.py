"""The pipeline against plain Python on small tables."""
import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from flowtally.llm.queries import tokenizer_path
from test_dedup import brute_lines
from test_jaccard import brute as brute_groups
from test_native import brute_quality, words

tokenizers = pytest.importorskip("tokenizers")


def test_stages_one_by_one(spark, sample_docs, tmp_path):
    docs = sample_docs
    stages = dict(corpus_pipeline.STAGES)
    before = docs.collect()
    good = stages["quality rules"](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in good) == sorted(r["doc_id"] for r in before if brute_quality(r["text"])["kept"])

    docs = spark.createDataFrame(good, sample_docs.schema)
    clean = stages["line dedup"](spark, docs, "").collect()
    want = {i: x for (i, _), x in brute_lines([(r["doc_id"], r["text"]) for r in good], 8).items()}
    lines = {r["doc_id"]: sum(1 for x in r["text"].split("\n") if words(x)) for r in good}
    assert {r["doc_id"]: r["text"] for r in clean} == {i: t for i, (t, n) in want.items() if n < lines[i]}
    assert all(r["n_chars"] == len(r["text"]) for r in clean if want[r["doc_id"]][1])

    docs = spark.createDataFrame(clean, sample_docs.schema)
    one = stages["n-gram Jaccard join"](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in one) == sorted({c for _, _, n, c in brute_groups([(r["doc_id"], r["text"]) for r in clean])})

    docs = spark.createDataFrame(one, sample_docs.schema)
    mix = stages["mixing sources to target weights"](spark, docs, "").collect()
    times = Counter(r["doc_id"] for r in mix)
    assert set(times.values()) <= {1, 2} and set(mix[0].asDict()) == set(sample_docs.columns)
    size = {r["doc_id"]: len(words(r["text"])) for r in one}
    assert abs(sum(size[i] * n for i, n in times.items()) - 1.5 * sum(size.values())) <= sum(max(size[r["doc_id"]] for r in one if r["source"] == s) for s in {r["source"] for r in one})

    docs = spark.createDataFrame(mix, sample_docs.schema)
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in mix}
    last = stages["BPE encoding and decoding"](spark, docs, "").collect()
    assert len(last) == len(mix)
    for r in last:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()

    sample_docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, last))


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert set(docs.columns) == set(odd_docs.columns), name
            docs = spark.createDataFrame(docs.collect(), odd_docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
