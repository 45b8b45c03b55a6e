"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.llm import bpe, divergence, jaccard, licenses, linededup, merkle, mixing, pagetext, quality, spans, tokenfiles, topk, urlrules

#: The tokenizer that the contract of op2 names, in the folder of public vocabularies.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    """Where the public vocabularies lie."""
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("id") % 50 == 0, "vec_id", "embedding", k=5, scale=256.0)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_path(), keep_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "dedup.n_lines", "dedup.n_removed")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree ``source/thousands/hundreds/id``; every 97th is its folder's LICENSE."""
    i = F.col("doc_id")
    name = F.when(i % 97 == 0, F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(i / 1000).cast("string"), F.when(i % 97 != 0, F.floor(i / 100).cast("string")), name)
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select(i.alias("id"), path.alias("path"), "text"))
    return found.withColumnRenamed("id", "doc_id")


def op9_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_spans(table(spark, sf_dir, "documents"), both_ends=True)


#: The rules that the contract of op10 names: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = urlrules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", *[f"judged.{c}" for c in ("host", "path", "rule", "verdict")])


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_documents(table(spark, sf_dir, "documents"))


#: The id that ends a document in the files of op12.
END_ID = 1


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)
    return tokenfiles.read_token_files(files)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline
    found = (op1_topk_search, op2_bpe, op3_line_dedup, op4_source_mix, op5_page_text, op6_quality_rules, op7_ngram_join, op8_license_scan,
             op9_span_dedup, op10_url_filter, op11_merkle_manifest,
             op12_token_files, op13_source_divergence)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def llm_sql() -> dict[str, str]:
    from flowtally.llm.oracle import SQL
    return dict(SQL)
