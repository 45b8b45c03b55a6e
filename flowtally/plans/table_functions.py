"""SQL table functions over whole tables: scoring, keyword search and retrieval.

``SELECT * FROM score_flows(TABLE(flows))``: the schema of the answer follows from the table's, rows go through in
batches where they lie, and a PARTITION BY is kept. Fitted models travel as plain arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from flowtally.functions.flow_features import add_flow_features
from flowtally.operators.anomaly import AnomalyDetector
from flowtally.operators.ensemble import SoftVoteModel
from flowtally.operators.evaluate import display_name
from flowtally.schema import LABEL_NAMES
from flowtally.session import fresh_path

#: Rows that a table function scores or compares at once.
BATCH = 4096


def _trees(spark: SparkSession, model, of_classes: bool) -> list[dict]:
    """The trees of a saved ensemble as arrays by node; a leaf's value is its weighted prediction, or its class shares."""
    path = fresh_path(spark, "trees")
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"),
        node["prediction"].alias("prediction"), node["impurityStats"].alias("stats"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold")).orderBy("tree", "id")
    found: dict[int, list] = {}
    for r in rows.toLocalIterator():  # a model, which its fit held in the driver too
        found.setdefault(r["tree"], []).append(r)
    out = []
    for tree, nodes in sorted(found.items()):
        if of_classes:
            stats = np.array([r["stats"] for r in nodes])
            value = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
        else:
            value = np.array([[model.treeWeights[tree] * r["prediction"]] for r in nodes])
        out.append({"left": np.array([r["left"] for r in nodes]), "right": np.array([r["right"] for r in nodes]), "feature": np.array([max(r["feature"], 0) for r in nodes]),
                    "threshold": np.array([r["threshold"] if r["threshold"] is not None else 0.0 for r in nodes]), "value": value})
    return out


def _sum_of_trees(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """The summed values of the leaves that the rows of ``x`` reach."""
    total, every = 0.0, np.arange(len(x))
    for t in trees:
        at = np.zeros(len(x), int)
        while (inner := t["left"][at] >= 0).any():
            goes_left = x[every, t["feature"][at]] <= t["threshold"][at]
            at = np.where(inner, np.where(goes_left, t["left"][at], t["right"][at]), at)
        total = total + t["value"][at]
    return total


def _scaled(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    return np.divide(x - mean, deviation, out=np.zeros_like(x), where=deviation > 0)


def portable_scorer(spark: SparkSession, model: SoftVoteModel, detector: AnomalyDetector | None = None) -> dict:
    """A fitted soft vote (and detector) as arrays; ``score_rows`` works on them anywhere."""
    imputer, _, scaler = model.prep.stages
    medians = imputer.surrogateDF.first().asDict()
    out = {"names": list(model.names), "classes": list(model.classes), "medians": np.array([medians[n] for n in model.names]),
           "mean": scaler.mean.toArray(), "deviation": scaler.std.toArray(), "boosted": [_trees(spark, m, False) for m in model.boosted],
           "forest": _trees(spark, model.forest, True) if model.forest is not None else None, "detector": None}
    if detector is not None:
        _, scale, axes = detector._fitted().stages
        out["detector"] = {"names": detector.names, "mean": scale.mean.toArray(), "deviation": scale.std.toArray(), "axes": axes.pc.toArray(), "threshold": detector.threshold}
    return out


def score_rows(scorer: dict, columns: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Position of the class, its confidence, anomaly score and flag of ``n`` rows; absent features count as 0."""
    def given(names: list[str]) -> np.ndarray:
        return np.stack([columns.get(c, np.zeros(n)) for c in names], axis=1).astype("float64")

    raw = given(scorer["names"])
    x = _scaled(np.where(np.isnan(raw), scorer["medians"], raw), scorer["mean"], scorer["deviation"])
    margins = np.concatenate([_sum_of_trees(trees, x) for trees in scorer["boosted"]], axis=1)
    member = 1.0 / (1.0 + np.exp(-2.0 * margins))
    shares = member / member.sum(axis=1, keepdims=True)
    if scorer["forest"] is not None:
        shares = (shares + _sum_of_trees(scorer["forest"], x) / len(scorer["forest"])) / 2
    best = shares.argmax(axis=1)
    out = {"best": best, "confidence": shares[np.arange(n), best], "anomaly_score": np.zeros(n), "is_anomaly": np.zeros(n, bool)}
    if d := scorer["detector"]:
        raw = given(d["names"])
        x = _scaled(np.where(np.isfinite(raw), raw, 0.0), d["mean"], d["deviation"])
        z = x @ d["axes"]
        error = np.maximum(((x * x).sum(axis=1) - (z * z).sum(axis=1)) / len(d["names"]), 0.0)
        out["anomaly_score"] = 1.0 / (1.0 + np.exp(-(error / d["threshold"] - 1.0))) if d["threshold"] > 0 else error
        out["is_anomaly"] = error > d["threshold"]
    return out


def rounded(values: np.ndarray, digits: int = 4) -> np.ndarray:
    """Rounded as Python does: by the number itself, not by what scaling makes of it."""
    scaled = values * 10.0 ** digits
    out, near = np.rint(scaled) / 10.0 ** digits, np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-6
    out[near] = [round(v, digits) for v in values[near].tolist()]
    return out


def register_scoring(spark: SparkSession, model: SoftVoteModel, detector: AnomalyDetector | None = None, name: str = "score_flows", label_names: dict[int, str] = LABEL_NAMES, schema: T.StructType | None = None) -> None:
    """``score_flows(TABLE(t))``: the columns of ``t`` with prediction, label_id, confidence, anomaly_score, is_anomaly;
    a row for each row. Engineered features that ``t`` lacks should be put in before (``add_flow_features``). With the
    ``schema`` of the only table it is for, rows go through in Arrow batches instead of one by one."""
    scorer = portable_scorer(spark, model, detector)
    shown = spark.range(1).select(*[display_name(F.lit(c), label_names, "CLASS_").alias(f"c{i}") for i, c in enumerate(model.classes)]).first()
    names, classes, batch = list(shown), [int(c) for c in scorer["classes"]], BATCH
    wanted = list(dict.fromkeys([*scorer["names"], *((scorer["detector"] or {}).get("names", []))]))
    added = [T.StructField("prediction", T.StringType()), T.StructField("label_id", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
             T.StructField("anomaly_score", T.DoubleType()), T.StructField("is_anomaly", T.BooleanType())]

    def with_scores(table: T.StructType) -> T.StructType:
        clash = {f.name.lower() for f in table.fields} & {f.name for f in added}
        if clash:
            raise ValueError(f"the table has a column {sorted(clash)[0]} already")
        return T.StructType([*table.fields, *added])

    class ScoreFlows:
        def __init__(self):
            self.rows = []

        @staticmethod
        def analyze(flows: AnalyzeArgument) -> AnalyzeResult:
            if not flows.isTable:
                raise ValueError("give a table: TABLE(name)")
            return AnalyzeResult(schema=with_scores(flows.dataType))

        def eval(self, flows) -> Iterator[tuple]:
            self.rows.append(flows)
            if len(self.rows) == batch:
                yield from self.scored()

        def terminate(self) -> Iterator[tuple]:
            if self.rows:
                yield from self.scored()

        def scored(self) -> Iterator[tuple]:
            rows, self.rows = self.rows, []
            given = dict(zip(rows[0].__fields__, zip(*rows)))  # column by column: a row's fields are not looked up by name
            columns = {c: np.array(given[c], dtype=float) for c in wanted if c in given}
            found = score_rows(scorer, columns, len(rows))
            told = zip(rows, *(found[c].tolist() for c in ("best", "confidence", "anomaly_score", "is_anomaly")))
            for row, k, confidence, anomaly, flag in told:
                yield (*row, names[k], classes[k], round(confidence, 4), round(anomaly, 4), flag)

    class ScoreBatches:
        def eval(self, flows: pa.RecordBatch) -> Iterator[pa.Table]:
            for at in range(0, flows.num_rows, batch):
                rows = flows.slice(at, batch)
                columns = {c: rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in wanted if c in rows.schema.names}
                found = score_rows(scorer, columns, rows.num_rows)
                best = pa.array(found["best"])
                yield pa.Table.from_arrays([*rows.columns, pa.array(names).take(best), pa.array(classes, pa.int32()).take(best), pa.array(rounded(found["confidence"])),
                                            pa.array(rounded(found["anomaly_score"])), pa.array(found["is_anomaly"])], names=[*rows.schema.names, *(f.name for f in added)])

    spark.udtf.register(name, F.udtf(ScoreFlows) if schema is None else F.arrow_udtf(ScoreBatches, returnType=with_scores(schema)))


def register_table_search(spark: SparkSession, name: str = "rows_with", text: str = "text") -> None:
    """``rows_with(TABLE(t), 'keyword')``: the rows of ``t`` whose text holds the keyword, small and large letters alike."""
    class RowsWith:
        @staticmethod
        def analyze(rows: AnalyzeArgument, keyword: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable or text not in rows.dataType.names:
                raise ValueError(f"give a table with a column {text}")
            return AnalyzeResult(schema=rows.dataType)

        def eval(self, rows, keyword) -> Iterator[tuple]:
            if keyword is not None and rows[text] is not None and keyword.lower() in rows[text].lower():
                yield tuple(rows)

    spark.udtf.register(name, F.udtf(RowsWith))


def register_table_retrieval(spark: SparkSession, name: str = "nearest_rows", id_col: str = "id", vector: str = "embedding") -> None:
    """``nearest_rows(TABLE(chunks), array(array(…), …), k)``: query_no, id, distance of the ``k`` nearest rows to each
    vector in every part of the table; a ranking over the few rows that come back gives the table's own ``k``."""
    batch = BATCH

    class NearestRows:
        def __init__(self):
            self.rows, self.asked, self.k = [], None, 0
            self.best = None

        @staticmethod
        def analyze(chunks: AnalyzeArgument, vectors: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
            if not chunks.isTable or not {id_col, vector} <= set(chunks.dataType.names):
                raise ValueError(f"give a table with columns {id_col} and {vector}")
            return AnalyzeResult(schema=T.StructType([T.StructField("query_no", T.IntegerType()), T.StructField("id", chunks.dataType[id_col].dataType), T.StructField("distance", T.DoubleType())]))

        def eval(self, chunks, vectors, k) -> None:
            if self.asked is None:
                self.asked, self.k, self.best = np.array(vectors, float), int(k), [[] for _ in vectors]
            if chunks[vector] is not None:
                self.rows.append((chunks[id_col], chunks[vector]))
            if len(self.rows) == batch:
                self.compare()

        def compare(self) -> None:
            rows, self.rows = self.rows, []
            held = np.array([v for _, v in rows], float)
            for q, asked in enumerate(self.asked):
                distance = ((held - asked) ** 2).sum(axis=1)
                near = np.flatnonzero(distance <= np.partition(distance, min(self.k, len(rows)) - 1)[min(self.k, len(rows)) - 1])
                self.best[q] = sorted([*self.best[q], *((float(distance[i]), rows[i][0]) for i in near)])[:self.k]

        def terminate(self) -> Iterator[tuple]:
            if self.rows:
                self.compare()
            for q, found in enumerate(self.best or []):
                for distance, at in found:
                    yield q, at, distance

    spark.udtf.register(name, F.udtf(NearestRows))


def score_table(spark: SparkSession, rows, model: SoftVoteModel, detector: AnomalyDetector | None = None):
    """A table of flows scored through the SQL function, engineered features derived where their base columns are there."""
    base = {"total_fwd_packets", "total_bwd_packets", "total_len_fwd_packets", "total_len_bwd_packets", "flow_duration"}
    wide = add_flow_features(rows) if base <= set(rows.columns) else rows
    register_scoring(spark, model, detector, schema=wide.schema)
    return spark.sql("SELECT * FROM score_flows(TABLE(SELECT * FROM {flows}))", flows=wide)
