"""Soft-voting tree classifier: boosted trees one-vs-rest and a forest, on Spark ML."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.functions.numeric import finite_or_zero
from flowtally.functions.vectors import argmax, mean_vectors
from flowtally.operators.boosting import fit_boosted
from flowtally.operators.evaluate import classification_report, confusion
from flowtally.operators.split import stratified_fold, stratified_split

MAX_CLASSES = 1000


@dataclass
class TreeSettings:
    """Model settings; the defaults are the fixed values of the full training run."""

    trees: int = 300
    depth: int = 7
    rate: float = 0.1
    row_share: float = 0.8
    column_share: float = 0.8
    seed: int = 42
    parallel_fits: int = 4
    forest: bool = True


def class_ids(df: DataFrame, label: str) -> list[int]:
    """Sorted distinct label ids; the position of an id is its column in the probabilities."""
    rows = df.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return sorted(int(r[0]) for r in rows)


def preparation(names: Sequence[str], relative_error: float = 1e-4) -> Pipeline:
    """Median imputation, assembly and scaling."""
    filled = [f"_i_{n}" for n in names]
    return Pipeline(stages=[
        Imputer(strategy="median", relativeError=relative_error, inputCols=list(names), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw_vec", handleInvalid="keep"),
        StandardScaler(inputCol="_raw_vec", outputCol="features", withMean=True, withStd=True),
    ])


@dataclass
class SoftVoteModel:
    names: list[str]
    classes: list[int]
    prep: PipelineModel
    boosted: list[GBTClassificationModel]
    forest: RandomForestClassificationModel | None = None

    def prepare(self, df: DataFrame) -> DataFrame:
        doubles = df.withColumns({n: F.col(n).cast("double") for n in self.names})
        return self.prep.transform(doubles).drop("_raw_vec", *[f"_i_{n}" for n in self.names])

    def margins(self, df: DataFrame, out: str = "margins") -> DataFrame:
        """Add the margins of the boosted trees, one per class."""
        wide = self.prepare(df)
        for i, model in enumerate(self.boosted):
            model.setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_p{i}").setPredictionCol(f"_y{i}")
            wide = model.transform(wide)
        return wide.select(*df.columns, F.array(*[F.get(vector_to_array(f"_raw{i}"), F.lit(1)) for i in range(len(self.boosted))]).alias(out))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probabilities`` (one per class), dense ``prediction_index`` and label ``prediction``."""
        out = self.prepare(df)
        margins = []
        for i, model in enumerate(self.boosted):
            model.setRawPredictionCol(f"_raw{i}").setProbabilityCol(f"_p{i}").setPredictionCol(f"_y{i}")
            out = model.transform(out)
            margins.append(F.get(vector_to_array(f"_raw{i}"), F.lit(1)))
        member = F.array(*[1.0 / (1.0 + F.exp(-2.0 * m)) for m in margins])
        total = F.aggregate(member, F.lit(0.0), lambda a, x: a + x)
        votes = [F.transform(member, lambda x: x / total)]
        if self.forest is not None:
            self.forest.setRawPredictionCol("_rawf").setProbabilityCol("_pf").setPredictionCol("_yf")
            out = self.forest.transform(out)
            votes.append(vector_to_array("_pf"))
        out = out.withColumn("probabilities", mean_vectors(votes)).withColumn("prediction_index", argmax(F.col("probabilities")))
        ids = F.array(*[F.lit(c) for c in self.classes])
        out = out.withColumn("prediction", F.get(ids, F.col("prediction_index")))
        scratch = [c for c in out.columns if c.startswith(("_raw", "_p", "_y"))]
        return out.drop(*scratch)

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.write().overwrite().save(f"{path}/prep")
        for i, m in enumerate(self.boosted):
            m.write().overwrite().save(f"{path}/boosted_{i}")
        if self.forest is not None:
            self.forest.write().overwrite().save(f"{path}/forest")
        meta = json.dumps({"names": self.names, "classes": self.classes, "forest": self.forest is not None})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SoftVoteModel:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        boosted = [GBTClassificationModel.load(f"{path}/boosted_{i}") for i in range(len(meta["classes"]))]
        forest = RandomForestClassificationModel.load(f"{path}/forest") if meta["forest"] else None
        return cls(meta["names"], meta["classes"], PipelineModel.load(f"{path}/prep"), boosted, forest)


def fit_soft_vote(df: DataFrame, names: Sequence[str], label: str = "label",
                  settings: TreeSettings | None = None) -> SoftVoteModel:
    """Fit preparation, one boosted model per class and a forest.

    The boosted models grow in the same passes over binned rows (``boosting``); the forest is Spark ML's, over a
    persisted input (disk is used when memory is short).
    """
    s = settings or TreeSettings()
    doubles = df.where(F.col(label).isNotNull()).withColumns({n: F.col(n).cast("double") for n in names})
    classes = class_ids(doubles, label)
    prep = preparation(names).fit(doubles)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int")) - 1
    boosted = fit_boosted(doubles, names, prep, index, len(classes), s.trees, s.depth, s.rate, s.row_share, s.column_share, s.seed, s.parallel_fits) if classes else []
    forest = None
    if s.forest:
        ready = prep.transform(doubles).select("features", index.cast("double").alias("_y")).persist()
        try:
            forest = RandomForestClassifier(featuresCol="features", labelCol="_y", numTrees=s.trees, maxDepth=s.depth,
                                            subsamplingRate=s.row_share, seed=s.seed).fit(ready)
        finally:
            ready.unpersist()
    return SoftVoteModel(list(names), classes, prep, boosted, forest)


@dataclass
class ImportanceResult:
    importance: DataFrame
    confusion: DataFrame
    report: DataFrame
    folds: DataFrame


def forest_importance(df: DataFrame, names: Sequence[str], label: str, key: str, trees: int = 150,
                      depth: int = 30, folds: int = 5, seed: int = 42) -> ImportanceResult:
    """Random-forest importances with test confusion, report and cross-validation accuracy."""
    spark = df.sparkSession
    classes = class_ids(df, label)
    index = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("int")) - 1
    doubles = df.withColumns({n: finite_or_zero(F.col(n).cast("double")) for n in names})  # gaps count as 0
    vec = VectorAssembler(inputCols=list(names), outputCol="features")
    rows = vec.transform(doubles).select(key, index.cast("double").alias("label"), "features")
    parts = stratified_fold(stratified_split(rows, "label", key, 0.7, seed), ["label", "is_train"], key, folds, seed).persist()
    try:
        def forest(train: DataFrame) -> RandomForestClassificationModel:
            return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(train)

        train = parts.where("is_train")

        def fold_score(k: int) -> tuple[int, float]:
            scored = forest(train.where(F.col("fold") != k)).transform(train.where(F.col("fold") == k))
            return k, scored.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]

        with ThreadPool(2) as pool:
            scores = pool.map(fold_score, range(folds))
        model = forest(train)
        weights = [(n, float(w)) for n, w in zip(names, model.featureImportances.toArray())]
        cells = confusion(model.transform(parts.where("not is_train"))).collect()  # one row per class pair
    finally:
        parts.unpersist()
    named = dict(enumerate(classes))
    table = spark.createDataFrame([(named[int(r[0])], named[int(r[1])], r["n"]) for r in cells],
                                  "label int, prediction int, n bigint")
    return ImportanceResult(
        spark.createDataFrame(weights, "feature string, importance double").orderBy(F.desc("importance"), "feature"),
        table, classification_report(table, classes=classes, weight="n"),
        spark.createDataFrame(scores, "fold int, score double"))


def importance_comparison(importance: DataFrame, kruskal: DataFrame) -> DataFrame:
    """Tree importance next to the rank statistic of each feature, most important first."""
    return importance.join(kruskal, "feature", "left").orderBy(F.desc("importance"), "feature")

