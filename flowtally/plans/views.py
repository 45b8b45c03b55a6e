"""Views of the sample tables in the shape of flows, requests, scores and vulnerabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.operators.sized import spread

RETURN_FLAGS = ("A", "N", "R")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text table, spread over the cores: work on long texts is heavy per row."""
    return spread(table(spark, sf_dir, "documents"))


def flows(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Line items as flows: gaps, infinities, a constant and a repeated column included."""
    c = F.col

    def num(x: Column) -> Column:
        return x.cast("double")

    return table(spark, sf_dir, "lineitem").select(
        *keep,
        F.when(c("l_linenumber") != 7, c("l_quantity")).alias("total_fwd_packets"),
        num(c("l_linenumber")).alias("total_bwd_packets"),
        c("l_extendedprice").alias("total_len_fwd_packets"),
        (c("l_extendedprice") * c("l_discount")).alias("total_len_bwd_packets"),
        (c("l_tax") * 1e6).alias("flow_duration"),
        F.when(c("l_tax") == 0, F.lit(float("inf"))).otherwise(c("l_extendedprice") / F.nullif(c("l_tax"), F.lit(0.0))).alias("flow_bytes_per_s"),
        c("l_discount").alias("flow_iat_mean"),
        c("l_tax").alias("flow_iat_std"),
        (c("l_quantity") * 20).alias("fwd_header_len"),
        num(c("l_linenumber") % 3).alias("fin_flag_count"),
        num(c("l_linenumber") % 2).alias("syn_flag_count"),
        num(c("l_returnflag") == "R").alias("rst_flag_count"),
        F.lit(0.0).alias("psh_flag_count"),
        num(c("l_linestatus") == "O").alias("ack_flag_count"),
        c("l_extendedprice").alias("subflow_fwd_bytes"),
        c("l_returnflag").alias("label_str"),
        (F.array_position(F.array(*[F.lit(x) for x in RETURN_FLAGS]), c("l_returnflag")) - 1).cast("int").alias("label"),
    )


NUMERIC = ["total_fwd_packets", "total_bwd_packets", "total_len_fwd_packets", "total_len_bwd_packets",
           "flow_duration", "flow_bytes_per_s", "flow_iat_mean", "fwd_header_len"]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth, prediction and class probabilities, all plain functions of a line item."""
    c = F.col
    raw = [c("l_discount") * 10 + 1, c("l_tax") * 100 + 1, c("l_quantity") / 25 + 1]
    total = raw[0] + raw[1] + raw[2]
    return table(spark, sf_dir, "lineitem").select(
        (F.array_position(F.array(*[F.lit(x) for x in RETURN_FLAGS]), c("l_returnflag")) - 1).cast("int").alias("label"),
        (c("l_linenumber") % 3).cast("int").alias("prediction"),
        F.array(*[r / total for r in raw]).alias("probabilities"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a request log: the service is the event type, the latency its value."""
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("route"), F.col("value").alias("latency_ms"),
        (F.col("event_type") == "error").alias("error"), "props")


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with raw flow labels: padded, with the odd dash, and one that is unknown."""
    t = F.col("event_type")
    label = (F.when(t == "click", F.lit(" BENIGN")).when(t == "view", F.lit("DoS Hulk\t"))
             .when(t == "purchase", F.lit("Web Attack \x96 XSS")).when(t == "error", F.lit("Heartbleed"))
             .otherwise(F.lit("no such label")))
    return table(spark, sf_dir, "events").select("event_id", label.alias("label"))


def vulnerabilities(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents as nested vulnerability records with the gaps that real records have, beside the columns ``keep``."""
    i = F.col("doc_id")

    def metric(score: Column, severity: Column) -> Column:
        return F.array(F.struct(F.struct(score.alias("baseScore"), severity.alias("baseSeverity")).alias("cvssData")))

    none = F.filter(metric(F.lit(0.0), F.lit("")), lambda m: F.lit(False))
    score = (F.pmod(i, F.lit(11))).cast("double")

    def entry(lang: str, value: Column) -> Column:
        return F.struct(F.lit(lang).alias("lang"), value.alias("value"))

    def weakness(*entries: Column) -> Column:
        return F.struct(F.array(*entries).alias("description"))

    first = F.concat(F.lit("CWE-"), F.pmod(i, F.lit(130)).cast("string"))
    return documents(spark, sf_dir).select(
        *keep,
        F.struct(
            F.when(i % 50 != 0, F.concat(F.lit("CVE-"), (2020 + i % 5).cast("string"), F.lit("-"), (1000 + i).cast("string"))).alias("id"),
            F.array(entry("xx", F.lit("other")), F.struct(F.when(i % 9 == 0, "es").otherwise("en").alias("lang"), F.col("text").alias("value"))).alias("descriptions"),
            F.struct(
                F.when(i % 3 == 0, metric(score, F.lit("HIGH"))).otherwise(none).alias("cvssMetricV31"),
                F.when(i % 3 == 1, metric(score, F.lit("LOW"))).alias("cvssMetricV30"),
                F.when(i % 4 != 3, metric(F.lit(5.0), F.lit(None).cast("string"))).alias("cvssMetricV2")).alias("metrics"),
            F.array(weakness(entry("en", first), entry("es", F.lit("CWE-79"))), weakness(entry("en", F.lit("CWE-787")))).alias("weaknesses"),
            F.concat((2020 + i % 5).cast("string"), F.lit("-03-07T10:00:00.000")).alias("published"),
        ).alias("cve"))


def neighbours_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
