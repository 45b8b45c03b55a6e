"""Boosted trees one-vs-rest, the models of all classes grown in the same passes over binned rows.

Method, settings and draws are those of Spark ML's ``GBTClassifier`` (logistic loss, variance as impurity, 32 bins from a
sample of 10,000 rows, a share of rows per tree and of features per node), and the fitted models are its models, but where
two splits of a node differ by rounding alone: either may then be taken, as sums meet in another order. Its own fit holds an object per row and class and goes through them once a class, tree and level. Here rows are bytes, a bin per
feature, in blocks that are written once; a pass over them adds up one level of the trees of all classes. Tasks hold a
block and the sums of a level; sums meet by (class, node, feature), where the best split is found.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.session import batches_by_rows, fresh_path, settled

#: Bins of a feature, and rows from whose sample their limits are taken.
BINS = 32
SAMPLED = 10_000
#: Rows of a block, and trees after which margins are written anew.
BLOCK = 1 << 15
KEPT_TREES = 8
#: Sums of two features that are counted together, and nodes of a level that are compared one after the other.
PAIR_CELLS = 1 << 17
ONE_BY_ONE = 32
#: Bytes of a row group of blocks: what a reader holds.
GROUP_BYTES = 1 << 24

_NODES = ("treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double, "
          "leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>")


class Scaling:
    """What a fitted preparation does to raw values: medians into gaps, then scales."""

    def __init__(self, prep, names: Sequence[str]):
        imputer, _, scaler = prep.stages
        medians, deviation = imputer.surrogateDF.first().asDict(), scaler.std.toArray()
        self.medians, self.mean = np.array([medians[n] for n in names], float), scaler.mean.toArray()
        self.scale = np.divide(1.0, deviation, out=np.zeros(len(deviation)), where=deviation != 0)

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        """``raw`` is (features, rows)."""
        x = (np.where(np.isnan(raw), self.medians[:, None], raw) - self.mean[:, None]) * self.scale[:, None]
        if not np.isfinite(x).all():
            raise ValueError("features hold values that are not finite")
        return x


def _raw(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]).astype(float, copy=False)


# --- limits of bins ---------------------------------------------------------------------------

def limits_of(values: np.ndarray, wanted: float, bins: int = BINS) -> np.ndarray:
    """Limits between a feature's bins from a sample of which ``wanted`` rows were expected; what falls short of them
    counts as zeros."""
    found, counts = np.unique(values[values != 0], return_counts=True)
    counts = counts.astype(float)
    if not len(found):
        return np.empty(0)
    if wanted - counts.sum() > np.finfo(float).eps * counts.sum() * 100:
        at = np.searchsorted(found, 0.0)
        found, counts = np.insert(found, at, 0.0), np.insert(counts, at, wanted - counts.sum())
    between = (found[:-1] + found[1:]) / 2
    if len(between) < bins:
        return between
    limits, stride = [], wanted / bins
    goal, before = stride, counts[0]
    for limit, n in zip(between.tolist(), counts[1:].tolist()):
        if abs(before - goal) < abs(before + n - goal):
            limits.append(limit)
            goal += stride
        before += n
    return np.array(limits)


def bin_limits(rows: DataFrame, names: Sequence[str], scaling: Scaling, n: int, seed: int) -> list[np.ndarray]:
    """Limits of all features from one sample of rows, ``SAMPLED`` on average."""
    spark = rows.sparkSession
    share = min(1.0, SAMPLED / n)
    given = rows.select(*names)
    drawn = given._jdf.javaRDD().sample(False, share, spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt())
    sample = DataFrame(spark._jsparkSession.createDataFrame(drawn, given._jdf.schema()), spark).collect()
    x = scaling(np.array(sample, float).reshape(len(sample), len(names)).T)
    return [limits_of(v, share * n, min(BINS, n)) for v in x]


def binned_blocks(rows: DataFrame, names: Sequence[str], label: Column, scaling: Scaling, limits: list[np.ndarray], trees: int, row_share: float, seed: int) -> DataFrame:
    """Rows as blocks: how many, their bins (feature after feature), labels, and per tree a bit for each row drawn."""
    some = row_share < 1
    given = rows.select(*names, label.cast("short").alias("_label"), *[(F.rand(seed + t + 1) < row_share).alias(f"_t{t}") for t in range(trees) if some])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = scaling(_raw(part, names))
                bins = np.stack([np.searchsorted(s, v).astype(np.uint8) for s, v in zip(limits, x)])
                drawn = np.stack([part.column(f"_t{t}").to_numpy(zero_copy_only=False) for t in range(trees)]) if some else np.ones((trees, part.num_rows), bool)
                if n + part.num_rows > BLOCK:
                    yield block(held)
                    held, n = [], 0
                held.append((bins, part.column("_label").to_numpy().astype(np.int16), drawn))
                n += part.num_rows
        if n:
            yield block(held)

    def block(held: list) -> pa.RecordBatch:
        bins, labels, drawn = (np.concatenate(x, axis=-1) for x in zip(*held))
        bits = np.packbits(drawn, axis=1)
        return pa.RecordBatch.from_arrays([pa.array([len(labels)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (bins, labels, bits)), pa.array([None], pa.binary())],
                                          names=["n", "bins", "labels", "draws", "margins"])

    return given.mapInArrow(pack, "n int, bins binary, labels binary, draws binary, margins binary")


# --- trees ------------------------------------------------------------------------------------

class Tree:
    """A tree that grows level by level. Nodes are numbered as they come, two children in a row."""

    def __init__(self):
        self.feature, self.last, self.left, self.gain, self.impurity = [-1], [0], [-1], [-1.0], [None]
        self.stats: list[np.ndarray] = [np.zeros(3)]
        self.levels: list[list[int]] = []
        self.open = [0]

    def split(self, node: int, feature: int, last: int, gain: float, left: np.ndarray, right: np.ndarray) -> None:
        self.feature[node], self.last[node], self.gain[node], self.left[node] = feature, last, gain, len(self.feature)
        for stats in (left, right):
            for column, value in ((self.feature, -1), (self.last, 0), (self.left, -1), (self.gain, -1.0), (self.impurity, variance(stats)), (self.stats, stats)):
                column.append(value)

    def value(self, node: int) -> float:
        n, total, _ = self.stats[node]
        return float(total / n) if n else 0.0

    def flat(self) -> dict:
        """What tasks need: the split nodes by level and the nodes' values."""
        return {"levels": self.levels, "feature": np.array(self.feature, np.intp), "last": np.array(self.last), "left": np.array(self.left),
                "values": np.array([self.value(i) for i in range(len(self.feature))])}

    def records(self, limits: list[np.ndarray]) -> list[tuple]:
        """The nodes as Spark ML saves them: numbered from the top, left before right, leaves of one value merged."""
        kept = list(self.left)
        for node in reversed(range(len(kept))):
            k = kept[node]
            if k >= 0 and kept[k] < 0 and kept[k + 1] < 0 and self.value(k) == self.value(k + 1):
                kept[node] = -1
        out: list[list] = []
        todo = [(0, -1)]
        while todo:
            node, above = todo.pop()
            at, inner = len(out), kept[node] >= 0
            if above >= 0:
                out[above][6 if out[above][6] < 0 else 7] = at
            stats = self.stats[node]
            split = (self.feature[node], [float(limits[self.feature[node]][self.last[node]])], -1) if inner else (-1, [], -1)
            out.append([at, self.value(node), float(variance(stats)), stats.tolist(), int(stats[0]), float(self.gain[node]) if inner else -1.0, -1, -1, split])
            if inner:
                todo += [(kept[node] + 1, at), (kept[node], at)]
        return [tuple(r) for r in out]


def variance(stats: np.ndarray) -> np.ndarray:
    """Mean squared distance from the mean, of (…, rows, sum, sum of squares)."""
    n, total, squares = stats[..., 0], stats[..., 1], stats[..., 2]
    safe = np.maximum(n, 1)
    return np.where(n > 0, (squares - total * total / safe) / safe, 0.0)


def _reached(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The node that each row of bins (features, rows) is in."""
    n = bins.shape[1]
    kind = np.uint8 if len(tree["left"]) <= 256 else np.uint16 if len(tree["left"]) <= 1 << 16 else np.uint32
    at = np.zeros(n, kind)
    for nodes in tree["levels"]:
        if len(nodes) <= ONE_BY_ONE:
            for node in nodes:
                step = (bins[tree["feature"][node]] > tree["last"][node]).astype(kind)
                step += kind(tree["left"][node] - node)
                step *= at == node
                at += step
        else:
            inner = tree["left"][at] >= 0
            goes_right = bins[np.maximum(tree["feature"][at], 0), np.arange(n)] > tree["last"][at]
            at = np.where(inner, tree["left"][at] + goes_right, at).astype(kind)
    return at


def _margins(block: dict, trees: list[list[tuple[float, dict]]]) -> np.ndarray:
    """Margins (classes, rows): those written beside the block and the trees since."""
    n, margins = len(block["labels"]), block["margins"]
    out = np.zeros((len(trees), n)) if margins is None else margins.copy()
    for c, grown in enumerate(trees):
        for weight, tree in grown:
            out[c] += tree["values"][_reached(tree, block["bins"])] * weight
    return out


def _blocks(batches: Iterator[pa.RecordBatch], features: int, classes: int) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            n, bins, labels, draws, margins = (batch.column(c)[i] for c in ("n", "bins", "labels", "draws", "margins"))
            n = n.as_py()
            yield {"bins": np.frombuffer(bins.as_buffer(), np.uint8).reshape(features, n), "labels": np.frombuffer(labels.as_buffer(), np.int16),
                   "draws": np.frombuffer(draws.as_buffer(), np.uint8).reshape(-1, -(-n // 8)), "margins": np.frombuffer(margins.as_buffer()).reshape(classes, n) if margins.is_valid else None}


def _sums_of(bins: np.ndarray, residuals: np.ndarray, slots: np.ndarray, out: np.ndarray) -> None:
    """Add rows, sums and squares of residuals to ``out`` (measures, slots, features, bins)."""
    squares, (_, n_slots, features, width) = residuals * residuals, out.shape
    weights = (None, residuals, squares)
    at = slots.astype(np.intp)
    paired = features - features % 2 if n_slots * width * width <= PAIR_CELLS else 0
    at *= width * width
    for f in range(0, paired, 2):
        code = np.multiply(bins[f], width, dtype=np.intp)
        code += bins[f + 1]
        code += at
        for m, w in enumerate(weights):
            both = np.bincount(code, w, n_slots * width * width).reshape(n_slots, width, width)
            out[m, :, f] += both.sum(axis=2)
            out[m, :, f + 1] += both.sum(axis=1)
    at //= width
    for f in range(paired, features):
        code = at + bins[f]
        for m, w in enumerate(weights):
            out[m, :, f] += np.bincount(code, w, n_slots * width).reshape(n_slots, width)


def _best_split(sums: np.ndarray, n_limits: int, impurity: float | None) -> tuple[float, int, list[float], list[float]]:
    """Gain, last bin to the left and the stats of both sides of a feature's best split; a gain below 0 where none is valid."""
    upto = np.cumsum(sums.reshape(3, -1).T, axis=0)
    total = upto[n_limits]
    left = upto[:n_limits]
    right = total - left
    n = left[:, 0] + right[:, 0]
    before = variance(left + right) if impurity is None else impurity
    gain = before - left[:, 0] / np.maximum(n, 1) * variance(left) - right[:, 0] / np.maximum(n, 1) * variance(right)
    gain = np.where((left[:, 0] >= 1) & (right[:, 0] >= 1) & (gain >= 0), gain, -1.0)
    k = int(gain.argmax())
    return float(gain[k]), k, left[k].tolist(), right[k].tolist()


def _drawn_features(generator, spark: SparkSession, features: int, some: int) -> list[int]:
    """The features that a node may split on: a reservoir of ``some``."""
    if some >= features:
        return list(range(features))
    chosen, rand = list(range(some)), spark._jvm.org.apache.spark.util.random.XORShiftRandom(generator.nextLong())
    for f in range(some, features):
        at = int(rand.nextDouble() * (f + 1))
        if at < some:
            chosen[at] = f
    return chosen


def _level(blocks: DataFrame, trees: list[list[tuple[float, dict]]], growing: list[Tree], drawn: list[list[list[int]]], number: int, limits: list[np.ndarray]) -> dict[tuple[int, int], list]:
    """The best split of each feature drawn, by (class, place among the open nodes)."""
    spark, features, classes = blocks.sparkSession, len(limits), len(growing)
    width = max(len(s) for s in limits) + 1
    sent = spark.sparkContext.broadcast({"trees": trees, "growing": [(g.flat(), g.open) for g in growing], "drawn": drawn})
    first = np.cumsum([0, *[len(g.open) for g in growing]]) * features  # cells of a class's first node
    impurity = {int(first[c] // features) + i: (float(g.impurity[node]) if g.impurity[node] is not None else None) for c, g in enumerate(growing) for i, node in enumerate(g.open)}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = sent.value
        sums = [np.zeros((3, len(nodes), features, width)) for _, nodes in told["growing"]]
        slot_of = []
        for tree, nodes in told["growing"]:
            slots = np.full(len(tree["left"]), -1, np.int32)
            slots[nodes] = np.arange(len(nodes))
            slot_of.append(slots)
        for block in _blocks(batches, features, classes):
            n = len(block["labels"])
            is_drawn = np.unpackbits(block["draws"][number], count=n).view(bool)
            margins = _margins(block, told["trees"]) if number else None
            for c, (tree, nodes) in enumerate(told["growing"]):
                if not nodes:
                    continue
                slots = slot_of[c][_reached(tree, block["bins"])]
                rows = np.flatnonzero(is_drawn & (slots >= 0))
                y = np.where(block["labels"][rows] == c, 1.0, -1.0)
                residuals = 4.0 * y / (1.0 + np.exp(2.0 * y * margins[c][rows])) if number else y
                _sums_of(block["bins"].take(rows, axis=1), residuals, slots[rows], sums[c])
        cells, values = [], []
        for c, (_, nodes) in enumerate(told["growing"]):
            for i in range(len(nodes)):
                for f in told["drawn"][c][i]:
                    cells.append(int(first[c]) + i * features + f)
                    values.append(sums[c][:, i, f].ravel())
        if cells:
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(cells), pa.int32()), pa.array(values, pa.list_(pa.float64()))], names=["cell", "task", "sums"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, found = -1, None, []

        def end() -> None:
            f = at % features
            if total is not None and len(limits[f]):
                gain, k, left, right = _best_split(total, len(limits[f]), impurity[at // features])
                found.append({"cell": at, "gain": gain, "last": k, "left": left, "right": right})

        for batch in batches:
            values = batch.column("sums").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for cell, sums in zip(batch.column("cell").to_pylist(), values):
                if cell != at:
                    end()
                    at, total = cell, sums.reshape(3, -1).copy()
                else:
                    total += sums.reshape(3, -1)
        end()
        if found:
            yield pa.RecordBatch.from_pylist(found, pa.schema([("cell", pa.int64()), ("gain", pa.float64()), ("last", pa.int32()), ("left", pa.list_(pa.float64())), ("right", pa.list_(pa.float64()))]))

    met = blocks.mapInArrow(add_up, "cell bigint, task int, sums array<double>").repartition(max(1, min(int(first[-1]), spark.sparkContext.defaultParallelism)), "cell").sortWithinPartitions("cell", "task")
    out: dict[tuple[int, int], dict[int, tuple]] = {}
    for r in met.mapInArrow(best, "cell bigint, gain double, last int, left array<double>, right array<double>").collect():  # one row per node and feature
        c = int(np.searchsorted(first, r["cell"], side="right")) - 1
        i, f = divmod(int(r["cell"] - first[c]), features)
        out.setdefault((c, i), {})[f] = r
    sent.destroy()
    return {key: [by_feature[f] for f in drawn[key[0]][key[1]] if f in by_feature] for key, by_feature in out.items()}


def grow(blocks: DataFrame, limits: list[np.ndarray], classes: int, trees: int, depth: int, rate: float, column_share: float, seed: int) -> list[list[Tree]]:
    """The trees of all classes, one after the other, from blocks of binned rows."""
    spark, features = blocks.sparkSession, len(limits)
    some = max(1, int(np.ceil(column_share * features)))
    out: list[list[Tree]] = [[] for _ in range(classes)]
    since: list[list[tuple[float, dict]]] = [[] for _ in range(classes)]
    for number in range(trees):
        growing, random = [Tree() for _ in range(classes)], [spark._jvm.java.util.Random(seed + number) for _ in range(classes)]
        for level in range(depth):
            if not any(g.open for g in growing):
                break
            drawn = [[_drawn_features(r, spark, features, some) for _ in g.open] for g, r in zip(growing, random)]
            found = _level(blocks, since, growing, drawn, number, limits) if any(map(len, limits)) else {}
            for c, tree in enumerate(growing):
                split, below = [], []
                for i, node in enumerate(tree.open):
                    of_node = found.get((c, i), [])
                    if not of_node:
                        continue
                    top = max(of_node, key=lambda r: r["gain"])  # the first of equals, in the order drawn
                    left, right = np.array(top["left"]), np.array(top["right"])
                    if node == 0:
                        tree.stats[0] = left + right
                        tree.impurity[0] = variance(tree.stats[0])
                    if top["gain"] <= 0:
                        continue
                    tree.split(node, int(top["cell"] % features), int(top["last"]), top["gain"], left, right)
                    split.append(node)
                    children = [tree.left[node], tree.left[node] + 1]
                    below += [k for k in children if level + 1 < depth and abs(tree.impurity[k]) >= np.finfo(float).eps]
                tree.levels.append(split)
                tree.open = below[::-1]  # the last comes first
        for c, tree in enumerate(growing):
            out[c].append(tree)
            since[c].append((rate if number else 1.0, tree.flat()))
        if (number + 1) % KEPT_TREES == 0 and number + 1 < trees:
            blocks, since = settled(_with_margins(blocks, since, features), "margins"), [[] for _ in range(classes)]
    return out


def _with_margins(blocks: DataFrame, trees: list[list[tuple[float, dict]]], features: int) -> DataFrame:
    sent = blocks.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(_blocks([batch], features, len(sent.value))):
                one = batch.slice(i, 1)
                yield one.set_column(4, "margins", pa.array([_margins(block, sent.value).tobytes()], pa.binary()))

    return blocks.mapInArrow(run, blocks.schema)


def _model(spark: SparkSession, trees: list[Tree], limits: list[np.ndarray], rate: float, params: dict) -> GBTClassificationModel:
    """Trees as a model of Spark ML, by way of its saved form."""
    path = fresh_path(spark, "boosted")
    about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}
    own = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", "uid": f"GBTClassifier_{path[-12:]}", "paramMap": params, "defaultParamMap": {
        "cacheNodeIds": False, "checkpointInterval": 10, "featuresCol": "features", "impurity": "variance", "labelCol": "label", "leafCol": "", "lossType": "logistic", "maxBins": BINS,
        "maxMemoryInMB": 256, "minInfoGain": 0.0, "minInstancesPerNode": 1, "minWeightFractionPerNode": 0.0, "predictionCol": "prediction", "probabilityCol": "probability",
        "rawPredictionCol": "rawPrediction", "validationTol": 0.01}, "numFeatures": len(limits), "numTrees": len(trees)} | about
    of_tree = json.dumps({"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "uid": f"dtr_{path[-12:]}", "defaultParamMap": {}, "paramMap": {
        "featuresCol": "features", "maxDepth": params["maxDepth"], "seed": params["seed"]}} | about)
    spark.createDataFrame([(json.dumps(own),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    spark.createDataFrame([(t, of_tree, rate if t else 1.0) for t in range(len(trees))], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(t, node) for t, tree in enumerate(trees) for node in tree.records(limits)], _NODES).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def fit_boosted(rows: DataFrame, names: Sequence[str], prep, label: Column, classes: int, trees: int, depth: int, rate: float, row_share: float, column_share: float, seed: int,
                parallel: int = 4) -> list[GBTClassificationModel]:
    """A boosted model per class, each for its class (positions 0, 1, … in ``label``) against the rest."""
    spark = rows.sparkSession
    scaling, n = Scaling(prep, names), rows.count()
    limits = bin_limits(rows, names, scaling, n, seed)
    blocks = binned_blocks(rows, names, label, scaling, limits, trees, row_share, seed)
    path = fresh_path(spark, "blocks")
    with batches_by_rows(spark):
        blocks.repartition(3 * spark.sparkContext.defaultParallelism).write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    grown = grow(spark.read.schema(blocks.schema).parquet(path), limits, classes, trees, depth, rate, column_share, seed)
    params = {"maxIter": trees, "maxDepth": depth, "stepSize": rate, "subsamplingRate": row_share, "seed": seed, "featureSubsetStrategy": str(column_share)}
    with ThreadPool(parallel) as pool:
        return pool.map(lambda of_class: _model(spark, of_class, limits, rate, params), grown)
