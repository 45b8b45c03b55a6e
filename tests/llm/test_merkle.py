"""Merkle manifest against plain Python, its layout against a written-out recursion, and odd tables."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowtally.llm import merkle
from flowtally.llm.queries import op11_merkle_manifest
from tests.llm.conftest import SAMPLE


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, i):
    path = []
    for level in levels[:-1]:
        run = level[i // 16 * 16:i // 16 * 16 + 16]
        path.append((run[:i % 16], run[i % 16 + 1:]))
        i //= 16
    return path


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    def leaf(r, text):
        return h("".join(map(field, (*r[:4], text))))
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        sources[s].sort(key=lambda x: x[:3])
        trees[s] = levels_of([x[2] for x in sources[s]])
    top = levels_of([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, r) in enumerate(sources[s]):
            path = path_of(trees[s], i) + path_of(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if r[4] is not None else None) if hit else own
            for left, right in path:
                node = h("".join(left) + node + "".join(right))
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h("".join("".join(a + b) for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=str)


def laid_out(height, n, level=0, index=0):
    """Nodes (level from the leaves, index) in van Emde Boas order, written out."""
    levels = height + 1
    if levels == 1:
        return [(0, 0)]
    low = levels // 2
    widths = [-(-n // 16 ** k) for k in range(levels)]
    out = [(a + low, b) for a, b in laid_out(levels - low - 1, widths[low])]
    span = 16 ** (low - 1)
    for t in range(widths[low - 1]):
        for a, b in laid_out(low - 1, min(span, n - t * span)):
            out.append((a, b + t * (span // 16 ** a)))
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3), st.data())
def test_addresses(height, data):
    n = data.draw(st.integers(1, 16 ** height))
    order = laid_out(height, n)
    assert len(order) == merkle.n_nodes(height, n)
    table = merkle.addresses(height, n)
    for at, (level, index) in list(enumerate(order))[:600]:
        assert merkle.address(height, n, level, index) == at == table[level][index]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 700))
def test_subtree(n):
    leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
    want = levels_of([x.hex() for x in leaves])
    tree = merkle.Subtree.grown(leaves, len(want) - 1)
    assert tree.root.hex() == want[-1][0]
    again = merkle.Subtree(tree.height, n, tree.nodes.tobytes())
    for i, path in enumerate(again.paths()):
        assert merkle.folded(leaves[i], path).decode() == want[-1][0]
        assert [p.decode() for p in path] == ["".join(x) for pair in path_of(want, i) for x in pair]


def rows_of(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]


def answers(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_query(spark, sample_docs):
    got = answers(op11_merkle_manifest(spark, SAMPLE))
    assert got == brute(rows_of(sample_docs))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


@pytest.mark.parametrize("height", [1, 2])
def test_many_tiers_and_sources(spark, monkeypatch, height):
    """Subtrees of 16 or 256 leaves: several tiers in a hot source, and in the tree over 300 sources."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"),
                                    F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 900).cast("string"))).alias("source"), F.lit(5).cast("long").alias("n_chars"))
    manifest = merkle.build_manifest(docs.select(F.col("doc_id").alias("id"), "source", merkle.digest(F.col("text")).alias("digest"), F.lit(None).cast("binary").alias("other")))
    assert len(manifest.tiers) >= 2 and len(manifest.over) >= 2
    assert max(r.m for r in manifest.tiers[0].select("m").collect()) <= 16 ** height
    assert answers(merkle.audit_documents(docs)) == brute(rows_of(docs))


def test_odd_documents(spark, odd_docs):
    assert answers(merkle.audit_documents(odd_docs)) == brute(rows_of(odd_docs))


def test_one_and_none(spark, odd_docs, no_docs):
    one = odd_docs.where("doc_id = 3")
    got = answers(merkle.audit_documents(one))
    assert got == brute(rows_of(one)) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == h("")
    assert answers(merkle.audit_documents(no_docs)) == []
