"""Benign-only reconstruction detector: how far a flow lies from the main directions of
normal traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.functions.numeric import finite_or_zero, sigmoid_score
from flowtally.functions.vectors import dot
from flowtally.operators.ordered import exact_quantiles
from flowtally.session import settled

# Latent width and threshold percentile.
LATENT = 64
PERCENTILE = 95.0
# Fixed value: alert level of the scoring handler when no threshold is stored.
FALLBACK_THRESHOLD = 0.01


class AnomalyDetector:
    """Scale, project on the first principal directions, and measure what is lost.

    The directions are orthonormal, so the squared reconstruction error is the squared length
    of the scaled row minus that of its projection: plain column arithmetic.
    """

    def __init__(self, names: Sequence[str], latent: int = LATENT):
        self.names = list(names)
        self.latent = max(1, min(latent, len(self.names) - 1))
        self.model: PipelineModel | None = None
        self.threshold: float | None = None

    @staticmethod
    def _filled(name: str) -> Column:
        """A feature with 0 in its gaps (null, NaN, infinity), as in a request that leaves it out."""
        return finite_or_zero(F.col(name).cast("double"))

    def fit(self, benign: DataFrame, percentile: float = PERCENTILE) -> float:
        """Learn from benign rows, gaps filled, set the threshold at the percentile of their errors, and
        return the mean error (the training loss)."""
        rows = benign.select(*[self._filled(n).alias(n) for n in self.names])
        self.model = Pipeline(stages=[
            VectorAssembler(inputCols=self.names, outputCol="_x", handleInvalid="error"),
            StandardScaler(inputCol="_x", outputCol="_scaled", withMean=True, withStd=True),
            PCA(k=self.latent, inputCol="_scaled", outputCol="latent"),
        ]).fit(rows)
        errors = settled(self.reconstruction_errors(rows).select("reconstruction_error"), "errors")
        self.threshold = exact_quantiles(errors, [], "reconstruction_error", [percentile / 100.0]).first()["quantile"]
        return errors.agg(F.avg("reconstruction_error")).first()[0]

    def _fitted(self) -> PipelineModel:
        if self.model is None:
            raise RuntimeError("fit the detector before use")
        return self.model

    def _projected(self, df: DataFrame) -> DataFrame:
        doubles = df.withColumns({f"_d_{n}": self._filled(n) for n in self.names})
        stage = self._fitted().stages[0].copy()
        stage.setInputCols([f"_d_{n}" for n in self.names])
        out = stage.transform(doubles).drop(*[f"_d_{n}" for n in self.names])
        for s in self._fitted().stages[1:]:
            out = s.transform(out)
        return out

    def encode(self, df: DataFrame) -> DataFrame:
        """Add the latent vector as an array."""
        return self._projected(df).withColumn("latent", vector_to_array("latent")).drop("_x", "_scaled")

    def reconstruction_errors(self, df: DataFrame) -> DataFrame:
        out = self._projected(df)
        x, z = vector_to_array("_scaled"), vector_to_array("latent")
        lost = F.greatest((dot(x, x) - dot(z, z)) / F.lit(float(len(self.names))), F.lit(0.0))
        return out.withColumn("reconstruction_error", lost).drop("_x", "_scaled", "latent")

    def flag(self, error: Column) -> Column:
        if self.threshold is None:
            raise RuntimeError("fit the detector before use")
        return error > F.lit(self.threshold)

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``reconstruction_error``, ``anomaly_score`` in [0, 1] and ``is_anomaly``; one row for each row."""
        out = self.reconstruction_errors(df)
        e = F.col("reconstruction_error")
        return out.withColumns({"anomaly_score": sigmoid_score(e, self.threshold), "is_anomaly": self.flag(e)})

    def save(self, spark: SparkSession, path: str) -> None:
        self._fitted().write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(self.names, self.latent, self.threshold)],
                              "names array<string>, latent int, threshold double").coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> AnomalyDetector:
        meta = spark.read.parquet(f"{path}/meta").first()
        out = cls(meta["names"], meta["latent"])
        out.model, out.threshold = PipelineModel.load(f"{path}/model"), meta["threshold"]
        return out
