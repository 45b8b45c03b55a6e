"""The audit of sources against plain counting, the perfect hash against a dictionary, and odd tables."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowtally.llm import divergence
from flowtally.llm.queries import op13_source_divergence
from tests.llm.conftest import SAMPLE


def brute(rows, least=30):
    """rows: lang, source, text."""
    rows = [tuple(x or "" for x in r) for r in rows]
    small = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(small)) for _, _, t in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        here = [(r[1], w) for r, w in zip(rows, words) if r[0] == lang]
        df = Counter(t for _, w in here for t in set(w))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for s, _ in here}
        for s, w in here:
            counts[s].update(w)
        counts["whole", ""] = sum(counts.values(), Counter())
        p = {}
        for s, c in counts.items():
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        q = p.pop(("whole", ""))
        for s in p:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in p if o != s))
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(pairs)}
            items = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:50]
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(items)}
    return out


def answers(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.binary(max_size=9), max_size=300), st.sets(st.binary(max_size=9), max_size=50))
def test_perfect_hash(keys, others):
    keys = sorted(keys)
    made = divergence.PerfectHash(keys)
    at = made.find(keys).tolist()
    assert sorted(at) == list(range(len(keys))) and [made.key(s) for s in at] == keys
    assert made.find(sorted(others - set(keys))).tolist() == [-1] * len(others - set(keys))


def test_perfect_hash_of_many_and_of_keys_no_level_parts(monkeypatch):
    keys = [b"key %d" % i for i in range(30_000)]
    made = divergence.PerfectHash(keys)
    assert sorted(made.find(keys).tolist()) == list(range(30_000)) and not made.rest
    assert (made.find([b"other %d" % i for i in range(5000)]) == -1).all()
    assert sum(8 * len(words) for _, words, _ in made.levels) < 30_000 * 5 / 8  # under five bits a key
    monkeypatch.setattr(divergence.PerfectHash, "LEVELS", 1)
    made = divergence.PerfectHash(keys[:500])
    assert made.rest and sorted(made.find(keys[:500]).tolist()) == list(range(500)) and made.find([b"no"]).tolist() == [-1]


def test_query(spark, sample_docs):
    want = brute([(r.lang, r.source, r.text) for r in sample_docs.collect()])
    got = answers(op13_source_divergence(spark, SAMPLE))
    assert got == want and {r[2] for r in got} == {"pair", "term"}


def test_small_blocks_shards_and_passes_give_the_same(spark, sample_docs, monkeypatch):
    want = brute([(r.lang, r.source, r.text) for r in sample_docs.collect()], 8)
    for name, n in (("SHARD_TERMS", 40), ("SENT_BYTES", 1), ("HELD_TERMS", 50), ("HELD_SLOTS", 50), ("CELLS", 60)):
        monkeypatch.setattr(divergence, name, n)
    assert answers(divergence.audit_sources(sample_docs, 8)) == want


def test_odd_documents(spark, odd_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    for least in (1, 2, 1000):
        assert answers(divergence.audit_sources(odd_docs, least)) == brute(rows, least)


def test_ties_at_the_last_rank_and_a_hot_source(spark):
    docs = spark.range(240).select(F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 9)).alias("source"),
                                   F.concat_ws(" ", *[F.lit(f"Term{chr(97 + i // 10)}{chr(97 + i % 10)}É") for i in range(70)], F.when(F.col("id") % 3 == 0, F.lit("rare rare"))).alias("text"))
    assert answers(divergence.audit_sources(docs)) == brute([tuple(r) for r in docs.collect()])


def test_no_documents(no_docs):
    assert answers(divergence.audit_sources(no_docs)) == set()
