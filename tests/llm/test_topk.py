import math
import random

import numpy as np

from pyspark.sql import functions as F

from flowtally.llm import topk

SCHEMA = "vec_id long, embedding array<float>, norm string, score string"


def brute(rows, k, scale=256):
    ok = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in ok if i % 5 == 0}:
        best = {}
        for i, v in ok:
            if i != q:
                best[i] = max(best.get(i, -10**30), max(sum(a * b for a, b in zip(v, w)) for j, w in ok if j == q))
        out |= {(q, r + 1, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])}
    return out


def found(spark, rows, k=5, tile=None, monkeypatch=None):
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], SCHEMA)
    got = topk.top_k(df, F.col("id") % 5 == 0, "vec_id", "embedding", k, 256.0).collect()
    assert len(got) == len({(r["query_id"], r["rank"]) for r in got})
    return {tuple(r) for r in got}


def test_brute_force_with_ties_repeats_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "HEAD_ROWS", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 9)
    monkeypatch.setattr(topk, "SENT_NUMBERS", 120)
    monkeypatch.setattr(topk, "TILE", 37)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) * (1 + i % 7) for _ in range(6)]) for i in range(160)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, -1.0]) for i in range(200, 230)]  # one very common vector: ties
    rows += [rows[3], rows[5], (5, [3.0] * 6), (7, [1.0] * 4), (300, None), (301, []), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6)]
    for dense in (0.0, 1 / 16, 1.0):  # all tiles whole, some, none
        monkeypatch.setattr(topk, "DENSE", dense)
        assert found(spark, rows) == brute(rows, 5)


def test_few_rows_and_none(spark):
    assert found(spark, [(0, [1.0, 2.0]), (1, [1.0, 1.0])]) == {(0, 1, 1, 256 * 256 * 3)}
    assert found(spark, [(0, [1.0, 2.0])]) == set()
    assert found(spark, [(0, None)]) == set()
    assert found(spark, []) == set()
    assert found(spark, [(1, [1.0])]) == set()


def test_long_vectors_are_multiplied_in_whole_numbers(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 1 / 256]), (2, [2.0**20, 2 / 256])]
    assert found(spark, rows) == brute(rows, 5)
