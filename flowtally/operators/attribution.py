"""Per-row tree attributions (Shapley values of the boosted trees), as a batch job.

Trees go to the tasks as plain node tables and are gone through path by path over whole batches of rows
(``treepaths``). Models with more nodes than ``MAX_NODES`` go out in parts, one pass over the rows for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtally.operators.ensemble import SoftVoteModel
from flowtally.operators.treepaths import add_attributions, keep_tables, margins_mean, path_tree
from flowtally.session import fresh_path

TOP_FEATURES = 10
#: Nodes that are sent to the tasks at once (about 40 bytes each).
MAX_NODES = 1_000_000

# A tree: its weight and its nodes by id.
Tree = tuple[float, dict[int, dict]]


def export_trees(spark: SparkSession, model) -> list[Tree]:
    """The trees of a boosted model, read back from its saved form."""
    path = fresh_path(spark, "trees")
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["prediction"].alias("prediction"),
        node["rawCount"].alias("count"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"))
    trees: dict[int, dict[int, dict]] = {}
    for r in rows.toLocalIterator():  # a model, which its fit held in the driver too
        trees.setdefault(r["tree"], {})[r["id"]] = r.asDict()
    return [(model.treeWeights[t], trees[t]) for t in sorted(trees)]


def _parts(per_class: list[list[Tree]]) -> list[list[tuple[int, Tree]]]:
    """Trees with their class, in parts of at most ``MAX_NODES`` nodes (or one tree)."""
    parts: list[list[tuple[int, Tree]]] = [[]]
    held = 0
    for at, trees in enumerate(per_class):
        for tree in trees:
            if parts[-1] and held + len(tree[1]) > MAX_NODES:
                parts.append([])
                held = 0
            parts[-1].append((at, tree))
            held += len(tree[1])
    return parts


def _ready(sent: dict) -> list[tuple[int, dict]]:
    """A worker's trees as path arrays: built once beside what was broadcast, used by all its batches and tasks."""
    if "ready" not in sent:
        sent["ready"] = [(at, path_tree(nodes, weight)) for at, (weight, nodes) in sent.pop("trees")]
        keep_tables([tree for _, tree in sent["ready"]])
    return sent["ready"]


def _signed(batch: pa.RecordBatch, sent: dict, before: str | None, classes: int, n_features: int) -> np.ndarray:
    """Signed attributions (classes, features, rows) of a batch with ``_scaled``, added to those of earlier parts."""
    n = batch.num_rows
    x = np.ascontiguousarray(batch.column("_scaled").flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T)
    phi = np.zeros((classes, n_features, n))
    if before is not None:
        phi += batch.column(before).flatten().to_numpy(zero_copy_only=False).reshape(n, classes, n_features).transpose(1, 2, 0)
    for at, tree in _ready(sent):
        add_attributions(tree, x, phi[at])
    return phi


def _with_signed(df: DataFrame, parts: list, classes: int, n_features: int, out: str) -> DataFrame:
    """Add the signed attributions of all classes, one after the other, to rows with ``_scaled``: a pass for each part
    of the trees."""
    kinds = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def adder(sent, before: str | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    phi = _signed(batch, sent.value, before, classes, n_features)
                    flat = pa.array(np.ascontiguousarray(phi.transpose(2, 0, 1)).ravel())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, classes * n_features, dtype="int32")), flat)
                    kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != out]
                    yield pa.RecordBatch.from_arrays([*kept, lists], names=kinds.names)
        return run

    for i, part in enumerate(parts):
        df = df.mapInArrow(adder(df.sparkSession.sparkContext.broadcast({"trees": part}), out if i else None), kinds)
    return df


def signed_attributions(model: SoftVoteModel, df: DataFrame, out: str = "attributions", base: str = "base") -> DataFrame:
    """Add ``out`` (per class the signed attribution of each feature to the margin of its boosted trees) and ``base`` (the
    margins' means, which the attributions are added to): they sum up to the margins."""
    names = list(model.names)
    per_class = [export_trees(df.sparkSession, m) for m in model.boosted]
    ready = model.prepare(df).select(*df.columns, vector_to_array("features").alias("_scaled"))
    means = [margins_mean([path_tree(nodes, weight) for weight, nodes in trees]) for trees in per_class]
    wide = _with_signed(ready, _parts(per_class), len(per_class), len(names), "_phi")
    rows = F.transform(F.sequence(F.lit(0), F.lit(len(per_class) - 1)), lambda c: F.slice("_phi", c * len(names) + 1, len(names)))
    return wide.select(*df.columns, rows.alias(out), F.array(*[F.lit(float(m)) for m in means]).alias(base))


def sum_rule_gap(model: SoftVoteModel, df: DataFrame, out: str = "gap") -> DataFrame:
    """Add the largest difference, over the classes, between the margin and base plus attributions."""
    told = signed_attributions(model, df, "_signed", "_base")
    scored = model.margins(told, "_margins")
    gaps = F.transform(F.arrays_zip("_signed", "_base", "_margins"), lambda c: F.abs(F.aggregate(c["_signed"], c["_base"], lambda s, x: s + x) - c["_margins"]))
    return scored.withColumn(out, F.array_max(gaps)).drop("_signed", "_base", "_margins")


def top_attributions(model: SoftVoteModel, df: DataFrame, top_n: int = TOP_FEATURES,
                     out: str = "top_features") -> DataFrame:
    """Add the ``top_n`` features per row as ``array<struct<feature, value, shap>>``.

    ``shap`` is the mean absolute attribution over the classes of the boosted member, rounded
    to 4 digits; ``value`` is the feature as it came in.
    """
    names = list(model.names)
    per_class = [export_trees(df.sparkSession, m) for m in model.boosted]
    given = F.array(*[F.col(n).cast("double") for n in names])
    ready = model.prepare(df).select(*df.columns, vector_to_array("features").alias("_scaled"), given.alias("_given"))
    *first, last = _parts(per_class)
    wide = _with_signed(ready, first, len(per_class), len(names), "_phi")
    sent, before, classes = df.sparkSession.sparkContext.broadcast({"trees": last}), "_phi" if first else None, len(per_class)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StructType([
        T.StructField("feature", T.StringType()), T.StructField("value", T.DoubleType()),
        T.StructField("shap", T.DoubleType())])))])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mean = np.ascontiguousarray(np.abs(_signed(batch, sent.value, before, classes, len(names))).mean(axis=0).T)
            order = np.argsort(-mean, axis=1, kind="stable")[:, :top_n]
            n = order.shape[1]
            cells = order + np.arange(0, mean.size, mean.shape[1])[:, None]
            top = pa.StructArray.from_arrays([
                pa.array(names).take(pa.array(order.ravel())),
                batch.column("_given").flatten().take(pa.array(cells.ravel())),
                pa.array(np.round(mean.ravel()[cells.ravel()], 4))], ["feature", "value", "shap"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, n, dtype="int32")), top)
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("_scaled", "_given", "_phi")]
            yield pa.RecordBatch.from_arrays([*kept, lists], names=schema.names)

    return wide.mapInArrow(rank, schema)


def top_n_of(names: Sequence[str], values, n: int = TOP_FEATURES):
    """Column form: the ``n`` entries of a value array with the largest magnitude, named."""
    pairs = F.zip_with(F.array(*[F.lit(x) for x in names]), values, lambda f, v: F.struct(
        (-F.abs(v)).alias("_order"), f.alias("feature"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda s: F.struct(s["feature"], s["value"]))
