"""Approximate neighbours by an inverted file: every vector in the cell of its nearest centre, queries visit a few cells.

The centres are fitted on a bounded sample; everything else covers all rows. How many cells a query visits is found by
an exact search for a bounded set of sample queries: the fewest that hold the wanted share of their true neighbours.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.operators.knn import BLOCK_ROWS, QUERY_LIMIT, TOP_K, Nearest, _by_blocks, _ids, _named, _out, _ranked, _vectors, knn_exact
from flowtally.session import fresh_path

#: Cells at most, and sample rows per cell that fit them.
MAX_CELLS = 4096
ROWS_PER_CELL = 64
#: Sample queries that tell how many cells a search visits, and the share of true neighbours these must hold.
TRIAL_QUERIES = 256
TARGET = 0.95


@dataclass
class InvertedFile:
    """A written index: ``path`` has cell, id, vec sorted by cell; ``centres`` are at most ``MAX_CELLS`` vectors,
    ``sizes`` the rows of each cell, ``probes`` the cells that a query visits."""

    path: str
    centres: np.ndarray
    sizes: np.ndarray
    metric: str
    probes: int
    held: list[float] = field(default_factory=list)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")

    def save(self, spark: SparkSession) -> None:
        meta = json.dumps({"centres": self.centres.tolist(), "sizes": self.sizes.tolist(), "metric": self.metric, "probes": self.probes, "held": self.held})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> InvertedFile:
        m = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return cls(path, np.array(m["centres"]), np.array(m["sizes"]), m["metric"], m["probes"], m["held"])


def _ordered(centres: np.ndarray, vecs: np.ndarray) -> np.ndarray:
    """Cells for each vector, the nearest centre first, ties to the smaller number."""
    rough = (centres * centres).sum(1)[None, :] - 2.0 * (vecs @ centres.T)
    return np.argsort(rough, axis=1, kind="stable")


def _enough(sizes: np.ndarray, order: np.ndarray, k: int, probes: int) -> np.ndarray:
    """Cells to visit for each query: ``probes``, or more where these hold fewer than ``k`` vectors."""
    reach = np.cumsum(sizes[order], axis=1)
    return np.minimum(np.maximum(probes, (reach < k).sum(axis=1) + 1), order.shape[1])


def _unit(df: DataFrame, metric: str) -> DataFrame:
    """Vectors of length 1 for the cosine distance, whose order is then that of the Euclidean one."""
    if metric != "cosine":
        return df
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("_n", norm).withColumn("vec", F.when(F.col("_n") > 0, F.transform("vec", lambda x: x / F.col("_n"))).otherwise(F.col("vec"))).drop("_n")


def _fit_centres(rows: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Centres of a sample of ``ROWS_PER_CELL`` rows a cell, taken by a hash of their ids."""
    sample = rows.orderBy(F.xxhash64(F.col("id"), F.lit(seed)), "id").limit(cells * ROWS_PER_CELL).select(array_to_vector("vec").alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(sample)
    return np.array([c.tolist() for c in model.clusterCenters()])


def build_index(chunks: DataFrame, chunk_id: str = "id", chunk_vec: str = "embedding", metric: str = "l2", cells: int | None = None,
                k: int = TOP_K, target: float = TARGET, seed: int = 42, path: str | None = None) -> InvertedFile | None:
    """Fit, fill and write an index of every row with a vector, and find the number of cells to visit for ``target``
    of the ``k`` nearest. About the root of the rows in cells, at most ``MAX_CELLS``. None where there are no vectors."""
    spark = chunks.sparkSession
    rows = _unit(_named(chunks, chunk_id, chunk_vec), metric)
    n = rows.count()
    if not n:
        return None
    cells = min(cells or max(1, round(n ** 0.5)), MAX_CELLS, n)
    index = InvertedFile(path or fresh_path(spark, "ivf"), _fit_centres(rows, cells, seed) if cells > 1 else np.zeros((1, len(rows.first()["vec"]))), np.zeros(0, int), metric, 1)
    sent = spark.sparkContext.broadcast(index.centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vecs = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                rough = (sent.value ** 2).sum(1)[None, :] - 2.0 * (vecs @ sent.value.T)
                yield pa.RecordBatch.from_arrays([pa.array(rough.argmin(axis=1), pa.int32()), batch.column("id"), batch.column("vec")], ["cell", "id", "vec"])

    kind = rows.schema["id"].dataType.simpleString()
    filled = rows.mapInArrow(assign, f"cell int, id {kind}, vec array<double>")
    parts = max(spark.sparkContext.defaultParallelism, -(-n // (16 * BLOCK_ROWS)))
    filled.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell").write.parquet(f"{index.path}/cells")
    stored = index.rows(spark)
    index.sizes = np.zeros(len(index.centres), int)
    for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per cell
        index.sizes[r["cell"]] = r["n"]
    index.probes, index.held = _probes(index, stored, k, target, seed)
    index.save(spark)
    return index


def _probes(index: InvertedFile, stored: DataFrame, k: int, target: float, seed: int) -> tuple[int, list[float]]:
    """The fewest cells that hold ``target`` of the true ``k`` nearest of the sample queries, and the share that each
    number of cells holds. A query itself is not counted among its neighbours."""
    asked = stored.orderBy(F.xxhash64(F.col("id"), F.lit(seed + 1)), "id").limit(TRIAL_QUERIES).select("id", "vec")
    found = knn_exact(asked, stored, k + 1, query_vec="vec", chunk_vec="vec").where("query_id <> chunk_id")
    cells = found.join(stored.select(F.col("id").alias("chunk_id"), "cell"), "chunk_id").select("query_id", "cell").collect()  # k + 1 for each sample query at most
    known = asked.collect()
    if not cells:
        return 1, [1.0]
    order = _ordered(index.centres, np.array([r["vec"] for r in known], dtype="float64"))
    places = {r["id"]: np.argsort(o) for r, o in zip(known, order)}  # of each cell in the query's order
    depth = np.array([places[r["query_id"]][r["cell"]] for r in cells])
    held = [float((depth < p).mean()) for p in range(1, len(index.centres) + 1)]
    return next(p for p, share in enumerate(held, 1) if share >= target), held


def search(index: InvertedFile, queries: DataFrame, k: int = TOP_K, probes: int | None = None, query_id: str = "id", query_vec: str = "embedding",
           query_limit: int = QUERY_LIMIT) -> DataFrame:
    """Rows (query_id, chunk_id, distance, rank): the ``k`` nearest in the cells that a query visits, distances exact.
    Every query gets ``k`` rows if the index has so many.

    Up to ``query_limit`` queries go to every task and only the visited cells are read; more go out in blocks, one after
    the other.
    """
    spark = queries.sparkSession
    q, stored = _unit(_named(queries, query_id, query_vec), index.metric), index.rows(spark)
    asked = _with_visits(index, q, k, probes or index.probes)
    known = asked.limit(query_limit + 1).collect()
    if not known:
        return _ranked(spark.createDataFrame([], _out(q, stored)), k)

    def found(some: list, cells: DataFrame) -> DataFrame:
        near = _by_tasks(some, cells, _out(q, stored), k)
        return _ranked(near.withColumn("distance", F.col("distance") / 2) if index.metric == "cosine" else near, k)

    return found(known, stored) if len(known) <= query_limit else _by_blocks(asked, stored, found, written=True)


def _with_visits(index: InvertedFile, q: DataFrame, k: int, probes: int) -> DataFrame:
    """Queries with the cells that they visit, a bit for each cell."""
    sent = q.sparkSession.sparkContext.broadcast((index.centres, index.sizes))
    kind = q.schema["id"].dataType.simpleString()

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                order = _ordered(sent.value[0], part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                many = _enough(sent.value[1], order, k, probes)
                visited = np.zeros(order.shape, bool)
                np.put_along_axis(visited, order, np.arange(order.shape[1])[None, :] < many[:, None], axis=1)
                bits = pa.array([row.tobytes() for row in np.packbits(visited, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), bits], ["id", "vec", "visits"])

    return q.mapInArrow(visits, f"id {kind}, vec array<double>, visits binary")


def _by_tasks(known: list, stored: DataFrame, out: str, k: int) -> DataFrame:
    if not known:
        return stored.sparkSession.createDataFrame([], out)
    bits = np.array([np.frombuffer(r["visits"], np.uint8) for r in known])
    visited = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0)))
    sent = stored.sparkSession.sparkContext.broadcast((_ids([r["id"] for r in known]), _vectors(known), np.ascontiguousarray(bits.T)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_vecs, visits = sent.value
        best = Nearest(q_ids, q_vecs, k, "l2")
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            ids, vecs = batch.column("id").to_numpy(zero_copy_only=False), batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for cell in np.unique(cells).tolist():
                here, rows = np.flatnonzero(visits[cell >> 3] & (128 >> (cell & 7))), cells == cell
                if len(here):
                    best.add(ids[rows], vecs[rows], here)
        yield from best.batches()

    return stored.where(F.col("cell").isin(visited.tolist())).mapInArrow(nearest, out)


def compared_share(index: InvertedFile, queries: DataFrame, k: int = TOP_K, probes: int | None = None, query_id: str = "id", query_vec: str = "embedding") -> DataFrame:
    """One row: n_queries, and the share of all pairs of queries and stored vectors that a search compares."""
    q = _unit(_named(queries, query_id, query_vec), index.metric)
    sent, probes = q.sparkSession.sparkContext.broadcast((index.centres, index.sizes)), probes or index.probes

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                order = _ordered(sent.value[0], part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1))
                many = _enough(sent.value[1], order, k, probes)
                n += [int(sent.value[1][o[:m]].sum()) for o, m in zip(order, many)]
            yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64())})

    total = float(max(1, index.sizes.sum()))
    return q.mapInArrow(count, "n long").agg(F.count(F.lit(1)).alias("n_queries"), (F.sum("n") / F.lit(total) / F.count(F.lit(1))).alias("share_compared"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_queries, least_rows (the fewest rows of a query), recall: the share of the exact hits' ranks whose
    distance the approximate hits reach, so that equal distances count alike."""
    best = exact.select("query_id", "rank", F.col("distance").alias("true"))
    both = best.join(found.select("query_id", "rank", "distance"), ["query_id", "rank"], "left")
    edge = best.groupBy("query_id").agg(F.max("true").alias("edge"))
    hit = (F.col("distance") <= F.col("edge") * (1 + 1e-9) + 1e-9).cast("int")
    per_query = both.join(edge, "query_id").groupBy("query_id").agg(F.count("distance").alias("rows"), F.count(F.lit(1)).alias("wanted"), F.sum(F.coalesce(hit, F.lit(0))).alias("hits"))
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), F.min("rows").alias("least_rows"), (F.sum("hits") / F.sum("wanted")).alias("recall"))
