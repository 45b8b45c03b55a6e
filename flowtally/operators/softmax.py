"""Boosted trees for many classes in one model: softmax margins, histograms of binned features.

Each round grows one tree per class, all of them level by level at once: a level is one pass over the rows, in which
tasks add up first and second derivatives per (class, node, feature, bin), and one split per node is found from the
sums. Rows are bytes (a bin per feature), a label and the margins so far; margins are written every few rounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtally.operators.ensemble import class_ids
from flowtally.session import settled

#: Bins of a feature; the last one holds what is missing.
BINS = 32
#: Rounds after which margins are written anew, parts that sums of a node meet in first, and rows a task treats at once.
KEPT_ROUNDS = 10
SALTS = 16
ROWS = 4096


@dataclass
class SoftmaxSettings:
    rounds: int = 300
    depth: int = 7
    rate: float = 0.1
    l2: float = 1.0
    least_gain: float = 1e-9


# A tree: arrays over its nodes: feature (below 0 for leaves), bin (rows up to it go left), left, right, value.
Tree = dict[str, np.ndarray]


def leaf_of(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """The node that each row of bins reaches."""
    at, every = np.zeros(len(bins), int), np.arange(len(bins))
    while (inner := tree["feature"][at] >= 0).any():
        goes_left = bins[every, np.maximum(tree["feature"][at], 0)] <= tree["bin"][at]
        at = np.where(inner, np.where(goes_left, tree["left"][at], tree["right"][at]), at)
    return at


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def best_split(sums: np.ndarray, l2: float, least_gain: float) -> tuple[int, int, float, float, float] | None:
    """Feature, bin, gain, and values of the left and right side, from sums (features, bins, [gradient, hessian, rows]);
    None where no split gains. Of equal gains the first feature and bin are taken."""
    left = sums.cumsum(axis=1)[:, :-1]
    whole = sums[0].sum(axis=0)
    right = whole - left

    def worth(s):
        return s[..., 0] ** 2 / (s[..., 1] + l2)

    gain = np.where((left[..., 2] > 0) & (right[..., 2] > 0), worth(left) + worth(right) - worth(whole), -np.inf)
    at = int(gain.argmax())
    f, b = divmod(at, gain.shape[1])
    if not gain[f, b] > least_gain:
        return None
    return f, b, float(gain[f, b]), float(-left[f, b, 0] / (left[f, b, 1] + l2)), float(-right[f, b, 0] / (right[f, b, 1] + l2))


@dataclass
class SoftmaxModel:
    """names, cuts (upper ends of the bins of each feature), classes, rounds of one tree per class, learning rate."""

    names: list[str]
    cuts: list[list[float]]
    classes: list[int]
    base: list[float]
    rounds: list[list[Tree]]
    rate: float

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probabilities`` (one per class, of sum 1) and ``prediction``; a row for each row, gaps or not."""
        model = (self.cuts, np.array(self.base), self.rounds, self.rate)
        sent, n = df.sparkSession.sparkContext.broadcast(model), len(self.names)
        schema = T.StructType([*df.schema.fields, T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
        given = F.array(*[F.col(c).cast("double") for c in self.names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts, base, rounds, rate = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
                bins = binned(x, cuts)
                margins = np.tile(base, (len(x), 1))
                for trees in rounds:
                    for c, tree in enumerate(trees):
                        margins[:, c] += rate * tree["value"][leaf_of(tree, bins)]
                shares = softmax(margins)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, shares.size + 1, shares.shape[1], dtype="int32")), pa.array(shares.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_x"], lists], names=schema.names)

        out = df.withColumn("_x", given).mapInArrow(run, schema)
        ids = F.array(*[F.lit(c) for c in self.classes])
        return out.withColumn("prediction", F.get(ids, F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1))

    def save(self, spark: SparkSession, path: str) -> None:
        plain = [[{k: v.tolist() for k, v in tree.items()} for tree in trees] for trees in self.rounds]
        rows = [(i, json.dumps(trees)) for i, trees in enumerate(plain)]
        rows.append((-1, json.dumps({"names": self.names, "cuts": self.cuts, "classes": self.classes, "base": self.base, "rate": self.rate})))
        spark.createDataFrame(rows, "round int, value string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SoftmaxModel:
        rows = {r["round"]: json.loads(r["value"]) for r in spark.read.parquet(path).collect()}
        head = rows.pop(-1)
        rounds = [[{k: np.array(v) for k, v in tree.items()} for tree in rows[i]] for i in sorted(rows)]
        return cls(head["names"], head["cuts"], head["classes"], head["base"], rounds, head["rate"])


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """The bin of every value: how many cuts lie below it; a missing value is in the last bin."""
    out = np.empty(x.shape, np.uint8)
    for f, ends in enumerate(cuts):
        out[:, f] = np.where(np.isnan(x[:, f]), BINS - 1, np.searchsorted(np.asarray(ends, float), x[:, f], side="left"))
    return out


def _cuts(df: DataFrame, names: Sequence[str]) -> list[list[float]]:
    """Up to ``BINS`` - 2 cuts per feature at even shares of its rows, from one mergeable sketch each."""
    shares = F.array(*[F.lit(i / (BINS - 1)) for i in range(1, BINS - 1)])
    row = df.agg(*[F.expr(f"kll_sketch_agg_double(CAST(`{n}` AS DOUBLE), 1024) FILTER (WHERE abs(CAST(`{n}` AS DOUBLE)) < double('inf'))").alias(f"s{i}") for i, n in enumerate(names)])
    ends = row.select(*[F.when(F.call_function("kll_sketch_get_n_double", f"s{i}") > 0, F.call_function("kll_sketch_get_quantile_double", F.col(f"s{i}"), shares)).alias(f"s{i}") for i in range(len(names))]).first()
    return [sorted(set(e or [])) for e in ends]


def fit_softmax(df: DataFrame, names: Sequence[str], label: str = "label", settings: SoftmaxSettings | None = None) -> SoftmaxModel:
    """Fit on the rows with a label. Jobs: rounds times depth, each one pass; sums per node meet in ``SALTS`` parts first,
    so no task gets the sums of all tasks at once."""
    s = settings or SoftmaxSettings()
    spark, names = df.sparkSession, list(names)
    rows = df.where(F.col(label).isNotNull())
    classes, cuts = class_ids(rows, label), _cuts(rows, names)
    k, n = len(classes), len(names)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int")) - 1

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bins = binned(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n), cuts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bins], pa.binary())], ["y", "bins"])

    given = rows.select(index.cast("int").alias("y"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"))
    stored = settled(given.mapInArrow(to_bins, "y int, bins binary"), "bins")
    counts = {r["y"]: r["count"] for r in stored.groupBy("y").count().collect()}  # a row per class
    total = sum(counts.values())
    base = [float(np.log(counts[c] / total)) for c in range(k)] if total else []
    model = SoftmaxModel(names, cuts, classes, base, [], s.rate)
    if k < 2:
        return model
    stored, done = _with_margins(stored, [], base, s.rate, k, n), 0
    for _ in range(s.rounds):
        if len(model.rounds) - done >= KEPT_ROUNDS:
            stored, done = settled(_with_margins(stored, model.rounds[done:], None, s.rate, k, n), "margins"), len(model.rounds)
        model.rounds.append(_grown(spark, stored, model.rounds[done:], s, k, n))
    return model


def _batch(batch: pa.RecordBatch, lo: int, k: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = batch.slice(lo, ROWS)
    bins = np.frombuffer(b"".join(part.column("bins").to_pylist()), np.uint8).reshape(-1, n)
    return part.column("y").to_numpy(), bins, part.column("margins").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _with_margins(stored: DataFrame, rounds: list[list[Tree]], base: list[float] | None, rate: float, k: int, n: int) -> DataFrame:
    """Rows with their margins after some more rounds."""
    if base is not None:
        return stored.withColumn("margins", F.array(*[F.lit(b) for b in base]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                y, bins, margins = _batch(batch, lo, k, n)
                margins = _moved(margins, bins, rounds, rate)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, margins.size + 1, k, dtype="int32")), pa.array(margins.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(y), batch.column("bins").slice(lo, ROWS), lists], ["y", "bins", "margins"])

    return stored.mapInArrow(run, "y int, bins binary, margins array<double>")


def _moved(margins: np.ndarray, bins: np.ndarray, rounds: list[list[Tree]], rate: float) -> np.ndarray:
    margins = margins.copy()
    for trees in rounds:
        for c, tree in enumerate(trees):
            margins[:, c] += rate * tree["value"][leaf_of(tree, bins)]
    return margins


def _grown(spark: SparkSession, stored: DataFrame, rounds: list[list[Tree]], s: SoftmaxSettings, k: int, n: int) -> list[Tree]:
    """One tree per class from the derivatives at the present margins."""
    nodes = [{"feature": [-1], "bin": [0], "left": [-1], "right": [-1], "value": [0.0]} for _ in range(k)]
    frontier = [[0] for _ in range(k)]  # nodes of the level that may be split, by class
    for depth in range(s.depth):
        trees = [{key: np.array(v) for key, v in tree.items()} for tree in nodes]
        sent = spark.sparkContext.broadcast((rounds, trees, frontier))
        size = n * BINS * 3

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            before, growing, open_ = sent.value
            held = {(c, node): np.zeros(size) for c in range(k) for node in open_[c]}
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    y, bins, margins = _batch(batch, lo, k, n)
                    shares = softmax(_moved(margins, bins, before, s.rate))
                    cells = (np.arange(n) * BINS + bins).astype(np.int64)
                    for c in range(k):
                        at, g = leaf_of(growing[c], bins), shares[:, c] - (y == c)
                        h = shares[:, c] * (1 - shares[:, c])
                        for node in open_[c]:
                            here = at == node
                            if here.any():
                                flat, m = cells[here].ravel(), n * BINS
                                held[c, node] += np.concatenate([np.bincount(flat, np.repeat(w[here], n), m) for w in (g, h, np.ones(len(y)))])
            for (c, node), v in held.items():
                if v.any():
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([node], pa.int32()), pa.array([v.tobytes()], pa.binary())], ["c", "node", "sums"])

        def added(key, table):
            total = np.zeros(size)
            for v in table.column("sums"):
                total += np.frombuffer(v.as_py(), float)
            return pa.table({"c": table.column("c")[:1], "node": table.column("node")[:1], "sums": pa.array([total.tobytes()], pa.binary())})

        def split(key, table):
            total = added(key, table).column("sums")[0].as_py()
            found = best_split(np.frombuffer(total, float).reshape(3, n, BINS).transpose(1, 2, 0), s.l2, s.least_gain)
            whole = np.frombuffer(total, float).reshape(3, n, BINS)[:, 0].sum(axis=1)
            f, b, _, left, right = found or (-1, 0, 0.0, 0.0, 0.0)
            return pa.table({"c": table.column("c")[:1], "node": table.column("node")[:1], "feature": pa.array([f], pa.int32()), "bin": pa.array([b], pa.int32()),
                             "left": [left], "right": [right], "value": [float(-whole[0] / (whole[1] + s.l2))]})

        partial = stored.mapInArrow(sums, "c int, node int, sums binary").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        once = partial.groupBy("c", "node", "salt").applyInArrow(added, "c int, node int, sums binary")
        found = once.groupBy("c", "node").applyInArrow(split, "c int, node int, feature int, bin int, left double, right double, value double").collect()  # a row per open node
        frontier = [[] for _ in range(k)]
        for r in sorted(found, key=lambda r: (r["c"], r["node"])):
            tree = nodes[r["c"]]
            if depth == 0:
                tree["value"][0] = r["value"]
            if r["feature"] < 0:
                continue
            children = len(tree["feature"]), len(tree["feature"]) + 1
            tree["feature"][r["node"]], tree["bin"][r["node"]] = r["feature"], r["bin"]
            tree["left"][r["node"]], tree["right"][r["node"]] = children
            for value in (r["left"], r["right"]):
                for key, v in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1), ("value", value)):
                    tree[key].append(v)
            frontier[r["c"]] += children
        if not any(frontier):
            break
    return [{key: np.array(v) for key, v in tree.items()} for tree in nodes]
