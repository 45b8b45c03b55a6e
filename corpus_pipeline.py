"""The corpus pipeline: quality rules, line dedup, near-duplicate join, source mix, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.llm import bpe, jaccard, linededup, mixing, quality
from flowtally.llm.common import free_name
from flowtally.llm.queries import tokenizer_path
from flowtally.session import settled


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects."""
    return quality.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines, n_chars counted anew; a document of which
    nothing but copied lines is made goes."""
    found = free_name(docs, "dedup")
    out = linededup.dedup_lines(docs, into=found)
    out = out.where(F.col(f"{found}.n_lines").isNull() | (F.col(f"{found}.n_lines") == 0) | (F.col(f"{found}.n_removed") < F.col(f"{found}.n_lines")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(f"{found}.n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.keep_first(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mix_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each document, and the digest of the text they decode to."""
    return bpe.encode_texts(docs, tokenizer_path(), keep_ids=False)


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", distinct_documents),
    ("mixing sources to target weights", mixed_sources),
    ("BPE encoding and decoding", encoded),
]

#: Encoding is not SQL; tests/llm compares the pipeline with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each one keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
