"""Exact top-k inner products: vectors by descending length, rotated partial sums, residual bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.session import fresh_path, settled

#: Queries that are multiplied at once, numbers of queries that go to the tasks in one job, and the longest vectors that
#: set first thresholds.
QUERY_BLOCK = 1024
SENT_NUMBERS = 1 << 22
HEAD_ROWS = 2048
#: Share of a tile's pairs that must outlive the first bound for the tile to be multiplied whole.
DENSE = 1 / 16
#: Vectors that a task multiplies at once, and pairs whose exact product it forms at once.
TILE = 1024
PAIRS = 1 << 15
#: Sums up to here are exact in doubles; longer vectors are multiplied as whole numbers of any size.
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id, v, norm: components floor(scale * x) as doubles. Rows without an id, without a vector, with an empty
    vector or with a null or non-finite component are left out."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))

    def floor(c):
        y = c * F.lit(float(scale))
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)

    v = F.transform(x, floor)
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)).where(sound)
            .select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
            .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, short ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    sizes = np.diff(ends)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """The right singular vectors of all rows, strongest first: each task adds up its products of components,
    width x width sums come to the driver."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = _matrix(b.column(0), width)
            x = x / max(1.0, np.abs(x).max(initial=0.0))
            total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "s"])

    rows = vectors.select("v").mapInArrow(products, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    gram = np.zeros((width, width))
    gram[rows["i"], rows["j"]] = rows["s"]
    _, axes = np.linalg.eigh(gram)
    return np.ascontiguousarray(axes[:, ::-1])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number products of paired rows; beyond the range of a long they stop at its ends."""
    out = np.empty(len(q), dtype=np.int64)
    for a in range(0, len(q), PAIRS):
        p, r = q[a:a + PAIRS], x[a:a + PAIRS]
        if np.abs(p).max(initial=0.0) * np.abs(r).max(initial=0.0) * q.shape[1] < EXACT:
            out[a:a + PAIRS] = np.einsum("ij,ij->i", p, r)
        else:
            out[a:a + PAIRS] = [max(-LONG - 1, min(LONG, sum(int(s) * int(t) for s, t in zip(u, w)))) for u, w in zip(p, r)]
    return out


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to smaller ids, an id counted once with its best score."""
    order = np.lexsort((ids, ~score, q))
    q, ids, score = q[order], ids[order], score[order]
    again = np.lexsort((np.arange(len(q)), ids, q))
    first = np.ones(len(q), dtype=bool)
    first[again[1:]] = (q[again[1:]] != q[again[:-1]]) | (ids[again[1:]] != ids[again[:-1]])
    q, ids, score = q[first], ids[first], score[first]
    start = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - start < k
    return q[keep], ids[keep], score[keep]


class _Search:
    """One block of queries against tiles of vectors that come longest first."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, axes: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.qid, self.q, self.k, self.axes = qid, q, k, axes
        d = q.shape[1]
        self.steps = sorted({max(1, d // 4), max(1, d // 2)})
        self.turned = q @ axes
        self.length = np.sqrt((q * q).sum(1))
        self.rest = [np.sqrt((self.turned[:, s:] ** 2).sum(1)) for s in self.steps]
        self.floor = np.full(len(q), -np.inf) if floor is None else floor.copy()
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
        longest = norms.max(initial=0.0)
        slack = 1e-9 * self.length * longest + 1e-6
        alive = np.flatnonzero(self.length * longest + slack >= self.floor)
        if not len(alive) or not len(x):
            return
        turned = x @ self.axes
        s = self.steps[0]
        rest = np.sqrt((turned[:, s:] ** 2).sum(1))
        bound = self.turned[alive, :s] @ turned[:, :s].T + np.outer(self.rest[0][alive], rest)
        open_ = bound >= (self.floor - slack)[alive, None]
        if np.count_nonzero(open_) > DENSE * open_.size and np.abs(self.q).max(initial=0.0) * np.abs(x).max(initial=0.0) * x.shape[1] < EXACT:
            self._whole(alive, open_, ids, x)
            return
        a, xi = np.nonzero(open_)
        qi = alive[a]
        own = self.qid[qi] != ids[xi]
        qi, xi = qi[own], xi[own]
        for n, s in enumerate(self.steps[1:], 1):
            rest = np.sqrt((turned[:, s:] ** 2).sum(1))
            keep = np.zeros(len(qi), dtype=bool)
            for b in range(0, len(qi), PAIRS):
                u, w = qi[b:b + PAIRS], xi[b:b + PAIRS]
                keep[b:b + PAIRS] = np.einsum("ij,ij->i", self.turned[u, :s], turned[w, :s]) + self.rest[n][u] * rest[w] >= (self.floor - slack)[u]
            qi, xi = qi[keep], xi[keep]
        score = np.concatenate([_exact(self.q[qi[b:b + PAIRS]], x[xi[b:b + PAIRS]]) for b in range(0, len(qi), PAIRS)] or [np.zeros(0, np.int64)])
        self._keep(qi, ids[xi], score)

    def _whole(self, alive: np.ndarray, open_: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """All products of a tile at once, exact in doubles; only those that reach the threshold go on."""
        score = self.q[alive] @ x.T
        open_ &= self.qid[alive][:, None] != ids[None, :]
        need = self.floor[alive]
        if len(ids) > self.k and len(np.unique(ids)) == len(ids):  # no id counts twice, so the tile's own k-th is a threshold
            score[~open_] = -np.inf
            need = np.maximum(need, np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        a, xi = np.nonzero(open_ & (score >= need[:, None]))
        self._keep(alive[a], ids[xi], score[a, xi].astype(np.int64))

    def _keep(self, qi: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        high = score >= self.floor[qi]
        if not high.any():
            return
        qi, ids, score = qi[high], ids[high], score[high]
        self.found = _best(np.concatenate([self.found[0], qi]), np.concatenate([self.found[1], ids]), np.concatenate([self.found[2], score]), self.k)
        q, _, score = self.found
        last = np.flatnonzero(np.diff(np.append(q, -1)) != 0)
        full = last[np.bincount(q, minlength=len(self.q))[q[last]] >= self.k] if len(q) else last
        self.floor[q[full]] = np.maximum(self.floor[q[full]], score[full])


def top_k(vectors: DataFrame, is_query, id_col: str, vector_col: str, k: int = 5, scale: float = 1.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query id its k highest inner products with the rows of
    other ids, ties to smaller ids; fewer where there are fewer rows.

    ``is_query``: condition on ``id``. Vectors lie in a table sorted by falling length, in even ranges. The
    longest vectors give each query a first threshold. Then every task goes through its tiles, for many blocks of
    queries in one job: a tile that is too short for a query is skipped, partial sums along the strongest axes plus
    the product of the residual lengths bound the rest, and only pairs whose bound reaches the threshold are
    multiplied in whole numbers, tile by tile where many are left. Short vectors are filled with zeros. An id given more than
    once takes part with all its rows, and the best score of two ids counts. Scores beyond a long stop at its
    ends. An empty table, or one without usable vectors, gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(whole_vectors(vectors, id_col, vector_col, scale).withColumn("deal", F.xxhash64("id"))
                   .repartitionByRange(parts, F.desc("norm"), "deal").sortWithinPartitions(F.desc("norm"), "id"), "vectors")
    size = rows.agg(F.max(F.size("v")).alias("d")).first()["d"]
    empty = spark.createDataFrame([], schema)
    if size is None:
        return empty.select("query_id", F.lit(0).alias("rank"), "vec_id", "score")
    axes = rotation(rows, size)
    head = rows.orderBy(F.desc("norm"), "id").limit(HEAD_ROWS).toArrow()
    head_ids, head_x, head_norms = head["id"].to_numpy(), _matrix(head["v"], size), head["norm"].to_numpy()

    heads = spark.sparkContext.broadcast((head_ids, head_x, head_norms, axes))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query's k-th best among the longest vectors."""
        ids, x, norms, turn = heads.value
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(at, QUERY_BLOCK)
                search = _Search(part.column(0).to_numpy(), _matrix(part.column(1), size), turn, k)
                for a in range(0, len(ids), TILE):
                    search.add(ids[a:a + TILE], x[a:a + TILE], norms[a:a + TILE])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(search.floor)], ["id", "v", "floor"])

    asked = settled(rows.where(is_query).select("id", "v").distinct().mapInArrow(first, "id long, v array<double>, floor double"), "queries")
    jobs = max(1, -(-asked.count() * size // SENT_NUMBERS))
    asked = asked.withColumn("job", F.pmod(F.xxhash64("v", "id"), F.lit(jobs)).cast("int"))
    out = fresh_path(spark, "topk")
    spark.createDataFrame([], schema).write.parquet(out)
    for n in range(jobs):
        some = asked.where(F.col("job") == n).toArrow()
        if not some.num_rows:
            continue
        sent = spark.sparkContext.broadcast((some["id"].to_numpy(), _matrix(some["v"], size), some["floor"].to_numpy(), axes))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q, floor, turn = sent.value
            each = [_Search(qid[a:a + QUERY_BLOCK], q[a:a + QUERY_BLOCK], turn, k, floor[a:a + QUERY_BLOCK]) for a in range(0, len(qid), QUERY_BLOCK)]
            for b in batches:
                ids, x, norms = b.column(0).to_numpy(), _matrix(b.column(1), size), b.column(2).to_numpy()
                for a in range(0, len(ids), TILE):
                    for own in each:
                        own.add(ids[a:a + TILE], x[a:a + TILE], norms[a:a + TILE])
            for own in each:
                at, ids, score = own.found
                yield pa.RecordBatch.from_arrays([pa.array(own.qid[at], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], ["query_id", "vec_id", "score"])

        (rows.select("id", "v", "norm").mapInArrow(scan, schema)
         .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
         .write.mode("append").parquet(out))
        sent.unpersist()
    found = spark.read.schema(schema).parquet(out)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
