"""Flow table readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.schema import RAW_FLOW_SCHEMA


def _text_lines(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    return (spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", str(recursive).lower())
            .text(folder).select("value", F.col("_metadata.file_path").alias("file")))


def csv_encodings(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """Encoding per file: utf-8, or latin-1 where any line is not valid utf-8."""
    valid = F.bool_and(F.is_valid_utf8("value"))
    return _text_lines(spark, folder, recursive).groupBy("file").agg(
        F.when(valid, F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")).alias("encoding"))


def read_flow_csvs(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """All ``*.csv`` files of a folder as one table of 78 numbers and a label, by position.

    One scan, whatever the encodings: files are read as one-byte text, in which every byte has a letter, and each text
    value is turned back to its bytes. Valid utf-8 is read as such, anything else stays latin-1, value by value. An
    empty folder is an error; files are not listed.
    """
    if _text_lines(spark, folder, recursive).limit(1).isEmpty():
        raise FileNotFoundError(f"no CSV files in {folder}")
    rows = (spark.read.schema(RAW_FLOW_SCHEMA).option("header", True).option("enforceSchema", True)
            .option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE")
            .option("pathGlobFilter", "*.csv").option("recursiveFileLookup", str(recursive).lower()).csv(folder))
    texts = {f.name: _from_bytes(F.col(f"`{f.name}`")) for f in RAW_FLOW_SCHEMA if f.dataType.simpleString() == "string"}
    return rows.withColumns(texts)


def _from_bytes(one_byte: Column) -> Column:
    """Text read as latin-1, as utf-8 where its bytes are."""
    given = F.encode(one_byte, "ISO-8859-1").cast("string")
    return F.when(F.is_valid_utf8(given), given).otherwise(one_byte)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Vertical concat; columns that a table lacks become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_splits(df: DataFrame, folder: str, flag: str = "is_train") -> None:
    """One write of both splits, as ``split=train`` and ``split=val`` partitions."""
    named = df.withColumn("split", F.when(F.col(flag), F.lit("train")).otherwise(F.lit("val"))).drop(flag)
    named.write.mode("overwrite").partitionBy("split").parquet(folder)


def read_splits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    both = spark.read.parquet(folder)
    return tuple(both.where(F.col("split") == s).drop("split") for s in ("train", "val"))


def label_stats(spark: SparkSession, path: str, label: str = "label_str") -> DataFrame:
    """SQL straight over a Parquet path: rows per label, most frequent first."""
    return spark.sql(f"SELECT {label}, COUNT(*) AS n FROM {{flows}} GROUP BY {label} ORDER BY n DESC, {label}",
                     flows=spark.read.parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def assert_output(spark: SparkSession, path: str, least_rows: int = 1) -> int:
    """Row count of a written table; too few rows is an error."""
    n = spark.read.parquet(path).count()
    if n < least_rows:
        raise ValueError(f"{path} holds {n} rows, expected {least_rows} or more")
    return n


def artifact_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path and their sizes, without reading them."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
            .load(path).select("path", "length"))


def assert_artifacts(spark: SparkSession, path: str, pattern: str = "*.parquet") -> int:
    """Total size of the files of an output; none, or nothing in them, is an error."""
    total = artifact_sizes(spark, path, pattern).agg(F.sum("length")).first()[0]
    if not total:
        raise FileNotFoundError(f"nothing like {pattern} in {path}")
    return total
