"""Weakness classifier on advisory text, and its labelled data set."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.text import cwe_id, english, primary_cwe
from flowtally.operators.split import cap_per_group, exact_split

# Shortest description, rows per year, validation share.
MIN_CHARS = 30
MAX_PER_YEAR = 5000
TRAIN_SHARE = 0.85


def labelled_texts(vulnerabilities: DataFrame, year: Column | None = None, max_per_year: int = MAX_PER_YEAR,
                   max_chars: int | None = None) -> DataFrame:
    """Rows (cve_id, text, label): the first ``max_per_year`` records of each year by id (the bound
    on labelled rows), then those with a long enough English description. Texts are whole unless
    ``max_chars`` cuts them for a model with a limit."""
    year = year if year is not None else F.substring("cve.published", 1, 4)
    rows = vulnerabilities.select("cve", year.alias("year"), F.col("cve.id").alias("cve_id"))
    capped = cap_per_group(rows, "year", "cve_id", max_per_year)
    text = english(F.col("cve.descriptions"), "")
    return capped.where(F.length(text) >= MIN_CHARS).select(
        "cve_id", (text if max_chars is None else F.substring(text, 1, max_chars)).alias("text"),
        cwe_id(primary_cwe(F.col("cve.weaknesses"))).alias("label"))


def text_classifier(width: int = 4096, iterations: int = 20) -> Pipeline:
    return Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width),
        IDF(inputCol="_tf", outputCol="features"),
        LogisticRegression(family="multinomial", maxIter=iterations, regParam=0.01, labelCol="label"),
    ])


def train_text_classifier(rows: DataFrame, key: str, width: int = 4096,
                          iterations: int = 20, seed: int = 42) -> tuple[PipelineModel, DataFrame]:
    """Fit on the training share and return the model with the scored validation rows."""
    parts = exact_split(rows, key, TRAIN_SHARE, seed)
    model = text_classifier(width, iterations).fit(parts.where("is_train").withColumn("label", F.col("label").cast("double")))
    held = model.transform(parts.where("not is_train"))
    return model, held.drop("_words", "_tf", "features", "rawPrediction")
