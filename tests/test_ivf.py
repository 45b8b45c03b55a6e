"""The inverted file against brute force: recall, exact distances, k rows for every query, gaps and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtally.operators import ivf
from flowtally.operators.knn import knn_exact


@pytest.fixture(scope="module")
def vectors(spark):
    """Twelve clouds, one of them with most of the rows, and copies of one vector."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 8)) * 6
    x = np.concatenate([middle[rng.choice(12, 900, p=[0.45] + [0.05] * 11)] + rng.normal(size=(900, 8)), np.tile(middle[:1], (60, 1))])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")


def brute(x, q, k, metric):
    if metric == "cosine":
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.sort(1 - u @ u[q])[:k]
    return np.sort(((x - x[q]) ** 2).sum(axis=1))[:k]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("limit", [4096, 0])
def test_recall_and_rows(spark, vectors, metric, limit, monkeypatch):
    x, df = vectors
    monkeypatch.setattr(ivf, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ivf, "QUERY_LIMIT", 200)
    index = ivf.build_index(df, metric=metric, cells=24)
    assert index.sizes.sum() == len(x) and 1 <= index.probes < 24
    asked = df.where("id % 3 = 0")
    got = ivf.search(index, asked, 5, query_limit=limit).toPandas()
    assert not got.duplicated(["query_id", "chunk_id"]).any() and (got.groupby("query_id").size() == 5).all() and got.query_id.nunique() == 320
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        d = brute(x, q, 5, metric)
        own = ((x[g.chunk_id] - x[q]) ** 2).sum(axis=1) if metric == "l2" else 1 - (x[g.chunk_id] @ x[q]) / np.linalg.norm(x[g.chunk_id], axis=1) / np.linalg.norm(x[q])
        assert g.distance.tolist() == pytest.approx(own.tolist(), abs=1e-9) and (np.diff(g.distance) >= -1e-12).all()
        hits += (g.distance.to_numpy() <= d.max() + 1e-9).sum()
    assert hits >= 0.9 * 5 * 320
    r = ivf.recall(ivf.search(index, asked, 5, query_limit=limit), knn_exact(asked, df, 5, metric)).first()
    assert r.n_queries == 320 and r.least_rows == 5 and r.recall == pytest.approx(hits / 1600)
    share = ivf.compared_share(index, asked, 5).first()
    assert share.n_queries == 320 and 0 < share.share_compared < 0.75


def test_all_cells_are_the_exact_answer(spark, vectors):
    _, df = vectors
    index = ivf.build_index(df, cells=10)
    got = ivf.search(index, df.where("id < 50"), 4, probes=10).orderBy("query_id", "rank").collect()
    want = knn_exact(df.where("id < 50"), df, 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.chunk_id) for r in got] == [(r.query_id, r.rank, r.chunk_id) for r in want]


def test_more_cells_are_visited_until_k_rows_are_there(spark, vectors):
    _, df = vectors
    index = ivf.build_index(df.where("id < 40"), cells=20)
    for limit in (4096, 0):
        assert ivf.search(index, df.where("id < 30"), 7, probes=1, query_limit=limit).groupBy("query_id").count().where("count <> 7").count() == 0
    assert ivf.search(index, df.where("id < 2"), 100).count() == 80


def test_saved_index_string_ids_gaps_and_none(spark, vectors, folder):
    _, df = vectors
    named = df.select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") % 10 > 0, F.col("embedding")).alias("embedding"))
    ivf.build_index(named, cells=8, path=f"{folder}/index")
    index = ivf.InvertedFile.load(spark, f"{folder}/index")
    assert index.sizes.sum() == 864 and index.held[-1] == 1.0 and index.held == sorted(index.held)
    got = ivf.search(index, named.where("id in ('c0', 'c1', 'c2')"), 3).collect()
    assert sorted({r.query_id for r in got}) == ["c1", "c2"] and all(r.rank > 1 or r.chunk_id == r.query_id for r in got)
    assert ivf.search(index, named.where("id = 'c0'"), 3).count() == 0
    assert ivf.build_index(df.where("id < 0")) is None


def test_searches_read_the_visited_cells_only(spark, vectors):
    _, df = vectors
    index = ivf.build_index(df, cells=24)
    plan = ivf.search(index, df.where("id = 1"), 5, probes=2)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell, [" in plan or "PushedFilters: [IsNotNull(cell)" in plan or "In(cell" in plan
