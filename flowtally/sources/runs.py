"""Run metrics, emitted metrics and evaluation files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_DDL = "run string, kind string, name string, step int, value double, text string"
METRIC_DDL = "name string, value double, unit string, dimensions map<string,string>"


def log_run(spark: SparkSession, path: str, run: str, params: dict | None = None, metrics: dict | None = None,
            steps: dict[str, list[float]] | None = None) -> None:
    """Append parameters, final metrics and per-step values of one run. Text goes to params
    only; a metric is a number."""
    rows = [(run, "param", k, None, None, str(v)) for k, v in (params or {}).items()]
    rows += [(run, "metric", k, None, float(v), None) for k, v in (metrics or {}).items() if isinstance(v, (int, float))]
    rows += [(run, "step", k, i, float(v), None) for k, vs in (steps or {}).items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, RUN_DDL).coalesce(1).write.mode("append").parquet(path)


def metric_rows(df: DataFrame, values: dict[str, tuple[Column, str]], dimensions: dict[str, Column] | None = None) -> DataFrame:
    """Turn a wide metric table into (name, value, unit, dimensions) rows."""
    dims = [x for k, v in (dimensions or {}).items() for x in (F.lit(k), v.cast("string"))]
    dim = F.create_map(*dims) if dims else F.create_map().cast("map<string,string>")
    rows = [F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"), F.lit(u).alias("unit"),
                     dim.alias("dimensions")) for n, (v, u) in values.items()]
    return df.select(F.inline(F.array(*rows)))


def put_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items from a JSON list."""
    return spark.read.schema("question string, ground_truth string").option("multiLine", True).json(path).fillna(
        {"ground_truth": ""})


def read_labelled_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("text string, label int").option("multiLine", True).json(path)


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """The class report as one text file: a line per class and average, widths fixed."""
    width = 28
    cell = lambda c: F.lpad(F.format_string("%.2f", F.col(c)), 10, " ")
    body = report.select(F.concat(F.lpad("name", width, " "), cell("precision"), cell("recall"), cell("f1"),
                                  F.lpad(F.col("support").cast("string"), 10, " ")).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)
