"""Every operator as a query over the sample tables: name -> (session, folder) -> table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.functions import text as tx
from flowtally.functions.flow_features import add_flow_features, feature_matrix
from flowtally.functions.numeric import sigmoid_score
from flowtally.functions.vectors import argmax, mean_vectors, row_mse
from flowtally.operators import clean, evaluate, ivf, knn, monitor, profile, requests, retrieval, split, stats_tests
from flowtally.operators.anomaly import AnomalyDetector
from flowtally.operators.attribution import sum_rule_gap, top_attributions, top_n_of
from flowtally.operators.ensemble import (TreeSettings, fit_soft_vote, forest_importance, importance_comparison)
from flowtally.operators.ordered import exact_quantiles
from flowtally.operators.sized import spread
from flowtally.operators.softmax import SoftmaxSettings, fit_softmax
from flowtally.operators.textclf import labelled_texts, train_text_classifier
from flowtally.plans import jobs
from flowtally.plans.table_functions import score_table
from flowtally.plans.views import (NUMERIC, documents, flows, neighbours_of, raw_labels, requests as request_log, scored, table,
                                   vulnerabilities)
from flowtally.schema import ENGINEERED
from flowtally.session import fresh_path, settled
from flowtally.sources import corpus
from flowtally.sources.feed import land_pages, read_feed
from flowtally.sources.flows import label_stats, union_all
from flowtally.sources.versions import VersionedTable, merged
from flowtally.streaming import jobs as streams
from flowtally.streaming.rolling import rolling_stream

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) + 0.0 for n in names})


# --- flow features and cleaning ---------------------------------------------------------------

@query
def flow_feature_summary(spark, sf):
    """Mean of every derived feature per label."""
    wide = add_flow_features(flows(spark, sf))
    small = [f for f in ENGINEERED if f not in ("total_pkts_per_s", "iat_cv")]
    return wide.groupBy("label_str").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f), 4).alias(f) for f in small],
        F.round(F.avg("total_pkts_per_s") / 1e6, 4).alias("total_mpkts_per_s"),
        F.round(F.avg("iat_cv") / 1e3, 4).alias("iat_cv_thousands")).orderBy(F.desc("n"), "label_str")


@query
def flow_features(spark, sf):
    return add_flow_features(flows(spark, sf, "l_orderkey", "l_partkey")).select("l_orderkey", "l_partkey", *ENGINEERED)


@query
def feature_matrix_rows(spark, sf):
    """Checks the assembled vector: its width and the sum of its first entries (single precision)."""
    m, names = feature_matrix(flows(spark, sf, "l_orderkey"))
    v = vector_to_array("features")
    return m.select("l_orderkey", F.size(v).alias("width"), F.lit(len(names)).alias("n_names"),
                    v[0].alias("first_value"), v[2].alias("third_value"))


@query
def label_encode(spark, sf):
    return clean.encode_labels(raw_labels(spark, sf)).select("event_id", "label", "label_str")


@query
def unknown_labels(spark, sf):
    return clean.unknown_label_audit(raw_labels(spark, sf))


@query
def label_group_filter(spark, sf):
    grouped = clean.group_labels(clean.encode_labels(raw_labels(spark, sf)))
    return profile.value_counts(clean.drop_rare_groups(grouped), "attack_type")


@query
def sql_label_stats(spark, sf):
    return label_stats(spark, f"{sf}/events.parquet", "event_type")


@query
def union_tables(spark, sf):
    """Two tables stacked, one without a column of the other."""
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"))
    return union_all([c, table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))])


@query
def label_share(spark, sf):
    return profile.label_share(table(spark, sf, "events"), "event_type")


@query
def table_shape(spark, sf):
    return profile.table_shape(flows(spark, sf), "label_str")


@query
def rows_per_file(spark, sf):
    return profile.rows_per_file(table(spark, sf, "documents"))


@query
def anomaly_truth(spark, sf):
    f = clean.with_anomaly_truth(flows(spark, sf))
    return f.groupBy("is_attack").agg(F.count(F.lit(1)).alias("n"), big(F.sum((F.col("label") == 0).cast("int"))).alias("n_benign"))


@query
def benign_summary(spark, sf):
    return clean.benign(flows(spark, sf)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total_len_fwd_packets"), 4).alias("mean_bytes"))


@query
def coerce_numeric(spark, sf):
    """Text that is a number, padded, not a number, infinite or empty."""
    t, v = F.col("event_type"), F.col("value").cast("string")
    raw = (F.when(t == "error", F.lit("abc")).when(t == "view", F.lit("Infinity"))
           .when(t == "click", F.concat(F.lit(" "), v, F.lit("\t"))).when(t == "signup", F.lit("")).otherwise(v))
    df = table(spark, sf, "events").select("event_id", raw.alias("flow_duration"))
    return clean.nullify_infinite(clean.coerce_numeric(df))


@query
def nullify_inf(spark, sf):
    return clean.nullify_infinite(flows(spark, sf, "l_orderkey")).select("l_orderkey", "flow_bytes_per_s", "total_fwd_packets")


@query
def drop_null_rows(spark, sf):
    f = clean.nullify_infinite(flows(spark, sf))
    some = profile.value_counts(clean.drop_null_features(f.drop("flow_bytes_per_s")), "label_str").withColumnRenamed("n", "n_features")
    return some.join(profile.value_counts(clean.drop_any_null(f), "label_str").withColumnRenamed("n", "n_any"), "label_str", "left")


@query
def missing_profile(spark, sf):
    return rounded(profile.missing_profile(clean.nullify_infinite(flows(spark, sf))), 6, "pct_missing")


@query
def row_missing_profile(spark, sf):
    f = clean.nullify_infinite(flows(spark, sf))
    return rounded(profile.row_missing_profile(f), 6, "mean", "std", "min", "p25", "p50", "p75", "max")


@query
def inf_profile(spark, sf):
    return profile.infinite_profile(flows(spark, sf))


@query
def constant_columns(spark, sf):
    return profile.constant_columns(flows(spark, sf))


@query
def identical_columns(spark, sf):
    return profile.identical_columns(flows(spark, sf))


@query
def dup_count(spark, sf):
    return profile.duplicate_row_count(table(spark, sf, "documents").select("text", "lang"))


@query
def dedupe_rows(spark, sf):
    return clean.drop_duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


@query
def null_loss_by_label(spark, sf):
    return profile.null_loss(clean.nullify_infinite(flows(spark, sf)), "label_str")


@query
def describe_features(spark, sf):
    f = flows(spark, sf).withColumn("flow_bytes_per_s", F.col("flow_bytes_per_s") / 1e6)
    return rounded(rounded(profile.describe(f, NUMERIC), 4, "mean", "std"), 7, "min", "p25", "p50", "p75", "max")


@query
def outlier_pct(spark, sf):
    return rounded(profile.outlier_pct(flows(spark, sf), NUMERIC), 6, "outlier_pct")


@query
def high_outliers(spark, sf):
    return rounded(profile.high_outliers(flows(spark, sf), NUMERIC, 2.0), 6, "outlier_pct")


@query
def corr_matrix(spark, sf):
    return rounded(profile.correlations(flows(spark, sf), NUMERIC), 6, "r")


@query
def corr_matrix_wide(spark, sf):
    """All numeric and derived features at once: the matrix form of the same sums."""
    wide = add_flow_features(flows(spark, sf))
    names, _ = clean.feature_types(wide, "label")
    return rounded(profile.correlations(wide, names), 5, "r")


@query
def high_corr_pairs(spark, sf):
    corr = profile.correlations(flows(spark, sf), [*NUMERIC, "subflow_fwd_bytes"])
    high = profile.high_correlations(corr, 0.4).withColumn("multicollinear", F.col("r") >= 0.95)
    return rounded(high, 6, "r")


# --- tests ------------------------------------------------------------------------------------

@query
def kruskal(spark, sf):
    return rounded(stats_tests.kruskal_wallis(flows(spark, sf), NUMERIC, "label_str"), 6, "h", "p_value")


@query
def levene(spark, sf):
    return rounded(stats_tests.levene(flows(spark, sf), [*NUMERIC, "rst_flag_count"], "label_str"), 6, "w", "p_value")


@query
def homogeneous_features(spark, sf):
    t = stats_tests.levene(flows(spark, sf), NUMERIC, "label_str")
    return stats_tests.homogeneous_variance(t).select("feature")


@query
def anderson(spark, sf):
    t = stats_tests.anderson_darling(flows(spark, sf), NUMERIC)
    return t.select("feature", big("n").alias("n"), F.round(F.col("a2") / F.col("n"), 5).alias("a2_per_row"),
                    F.round("critical", 6).alias("critical"), "is_normal")


@query
def normality_tally(spark, sf):
    return stats_tests.normality_tally(stats_tests.anderson_darling(flows(spark, sf), NUMERIC))


# --- splits and samples -----------------------------------------------------------------------

@query
def split_exact(spark, sf):
    return split.exact_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")


@query
def split_stratified(spark, sf):
    return split.stratified_split(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query
def split_quick(spark, sf):
    return split.quick_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.85)


@query
def fold_assign(spark, sf):
    f = split.with_fold(table(spark, sf, "orders"), "o_orderkey")
    return f.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"))


@query
def cap_per_group(spark, sf):
    capped = split.cap_per_group(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 3000)
    return capped.withColumn("rank", big("rank"))


@query
def seeded_sample(spark, sf):
    return split.seeded_sample(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 10)


@query
def head_rows(spark, sf):
    return split.head(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"])


# --- metrics ----------------------------------------------------------------------------------

@query
def confusion(spark, sf):
    return evaluate.confusion(scored(spark, sf))


@query
def class_report(spark, sf):
    r = evaluate.classification_report(scored(spark, sf), classes=range(4), names={0: "flag A", 1: "flag N", 2: "flag R"})
    return rounded(r, 6, "precision", "recall", "f1")


@query
def macro_f1(spark, sf):
    return rounded(evaluate.macro_f1(scored(spark, sf)), 6, "f1_macro")


@query
def roc_auc_ovr(spark, sf):
    one = evaluate.one_vs_rest(scored(spark, sf), "label", "probabilities")
    return rounded(evaluate.roc_auc(one, ["cls"]), 8, "roc_auc")


@query
def avg_precision(spark, sf):
    one = evaluate.one_vs_rest(scored(spark, sf), "label", "probabilities")
    return rounded(evaluate.average_precision(one, ["cls"]), 8, "avg_precision")


@query
def macro_ovr(spark, sf):
    return rounded(evaluate.macro_ovr(scored(spark, sf)), 8, "roc_auc_macro", "auc_pr_macro")


def _detector_scores(spark, sf):
    f = flows(spark, sf)
    return f.select((F.col("label") != 0).cast("int").alias("positive"), (F.col("flow_iat_std") * F.col("fwd_header_len")).alias("score"))


@query
def pr_best_f1(spark, sf):
    return rounded(evaluate.best_f1(_detector_scores(spark, sf)), 8, "best_f1")


@query
def pr_curve(spark, sf):
    return rounded(evaluate.pr_curve(_detector_scores(spark, sf)), 9, "precision", "recall", "f1")


@query
def detector_eval(spark, sf):
    return rounded(evaluate.evaluate_detector(_detector_scores(spark, sf)), 8, "roc_auc", "best_f1")


@query
def error_threshold(spark, sf):
    q = exact_quantiles(table(spark, sf, "events"), ["event_type"], "value", [0.95])
    return q.select("event_type", F.round("quantile", 6).alias("threshold"), "n")


@query
def anomaly_score(spark, sf):
    e = table(spark, sf, "events")
    s = F.when(F.col("event_type") == "view", sigmoid_score(F.col("value"), None)).otherwise(sigmoid_score(F.col("value"), 100.0))
    return e.select("event_id", F.round(s, 9).alias("score"), (F.col("value") > 100.0).alias("is_anomaly"))


@query
def reconstruction_mse(spark, sf):
    e = table(spark, sf, "embeddings")
    rebuilt = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10) / 10)
    return e.select("vec_id", F.round(row_mse(F.col("embedding"), rebuilt), 9).alias("mse"))


@query
def soft_vote(spark, sf):
    """Mean of two probability vectors, predicted class and confidence."""
    s = scored(spark, sf)
    p = F.col("probabilities")
    vote = mean_vectors([p, F.reverse(p)])
    return s.select(argmax(vote).alias("cls"), F.array_max(vote).alias("c")).groupBy("cls").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean_confidence"))


@query
def score_spread(spark, sf):
    """Mean and population deviation of scores."""
    return rounded(evaluate.fold_summary(table(spark, sf, "events"), "value"), 6, "mean", "std")


@query
def class_names(spark, sf):
    s = scored(spark, sf).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    return s.select(evaluate.display_name(F.col("prediction"), {0: "BENIGN"}, "CLASS_").alias("name"), "n")


# --- drift and requests -----------------------------------------------------------------------

def _share(c: str = "latency_ms") -> Column:
    return F.col(c) / 250.0


@query
def score_histogram(spark, sf):
    h = monitor.score_histogram(request_log(spark, sf), _share(), ["route"])
    return h.select("route", "bin", F.round("weight", 3).alias("weight"))


def _baseline(spark, sf):
    return monitor.DriftBaseline.from_scores(request_log(spark, sf), _share())


@query
def drift_check(spark, sf):
    daily = request_log(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return _baseline(spark, sf).check_scores(daily, _share(), "day").select(
        "kl_divergence", "is_drifting", "threshold", "window_size", "out_of_range", "window_label", "reason")


@query
def drift_kl(spark, sf):
    """Divergence of each route from all requests."""
    d = _baseline(spark, sf).check_scores(request_log(spark, sf), _share(), "route")
    return d.select("window_label", "kl_divergence", "is_drifting")


@query
def drift_by_user(spark, sf):
    """Some users have fewer rows than a check needs."""
    log = request_log(spark, sf).withColumn("who", F.concat_ws("/", F.col("user_id").cast("string"), "route"))
    return _baseline(spark, sf).check_scores(log, _share(), "who").select(
        "kl_divergence", "is_drifting", "window_size", "window_label", "reason")


@query
def latency_percentiles(spark, sf):
    p = monitor.latency_percentiles(request_log(spark, sf), ["route"], "latency_ms", F.col("error"))
    return rounded(p, 4, "p50_ms", "p95_ms", "p99_ms", "error_rate")


@query
def rolling_latency(spark, sf):
    log = request_log(spark, sf).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1700000000000000))
    return rounded(monitor.rolling_latency(log, "route", "at", "event_id", "latency_ms"), 6, "p50_ms", "p95_ms", "p99_ms")


@query
def rolling_metrics(spark, sf):
    """Percentiles and error rate of the last 1,000 requests and the running total, at every request."""
    log = request_log(spark, sf).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1700000000000000))
    out = monitor.rolling_latency(log, "route", "at", "event_id", "latency_ms", error=F.col("error") | (F.col("latency_ms") > 100))
    return rounded(out, 6, "p50_ms", "p95_ms", "p99_ms", "error_rate")


@query
def request_summary(spark, sf):
    return monitor.request_summary(request_log(spark, sf), "route", "latency_ms", F.col("error"), ["click", "purchase"])


@query
def prediction_tally(spark, sf):
    log = request_log(spark, sf).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return monitor.prediction_tally(log, ["hour"], "route")


# --- corpus -----------------------------------------------------------------------------------

@query
def cve_extract(spark, sf):
    """Documents landed as feed pages of a thousand ids each, read back through the feed source."""
    folder = fresh_path(spark, "pages")
    rows = vulnerabilities(spark, sf, keep=("doc_id",))
    land_pages(rows, F.floor(F.col("doc_id") / 1000), folder)
    r = corpus.vulnerability_records(read_feed(spark, folder, suffixes=".txt"))
    return r.select("cve_id", F.md5("text").alias("text_md5"), big(F.length("text")).alias("n_chars"), "score", "severity",
                    F.to_json("cwes").alias("cwes"), "published", F.date_format("published_date", "yyyy-MM-dd").alias("published_date"))


@query
def cwe_label(spark, sf):
    r = labelled_texts(vulnerabilities(spark, sf))
    return r.select("cve_id", F.md5("text").alias("text_md5"), "label")


@query
def cve_keyword_search(spark, sf):
    return corpus.search_vulnerabilities(vulnerabilities(spark, sf), "TION")


@query
def cve_keyword_batch(spark, sf):
    r = corpus.search_many(vulnerabilities(spark, sf), ["tion", "heth", "no such word", "Que "], 7)
    return r.select("keyword", big("rank").alias("rank"), "cve_id", F.md5("description").alias("description_md5"), "cvss_score", "published")


@query
def chunk_text(spark, sf):
    c = tx.explode_chunks(documents(spark, sf).select("doc_id", "text"), "text", "doc_id")
    return c.select("id", "doc_id", big("chunk_no").alias("chunk_no"), F.md5("document").alias("document_md5"))


@query
def chunk_upsert(spark, sf):
    """Chunks of all documents, replaced by those of the documents that have a label."""
    d, l = documents(spark, sf), table(spark, sf, "labels")
    old = tx.explode_chunks(d.select("doc_id", "text"), "text", "doc_id").withColumn("batch", F.lit("old"))
    again = d.join(l, "doc_id").select("doc_id", F.upper("lang").alias("text"))
    fresh = tx.explode_chunks(again, "text", "doc_id").withColumn("batch", F.lit("new"))
    m = merged(old, fresh, "id", replace_by="doc_id")
    return m.select("id", "doc_id", "batch", F.md5("document").alias("document_md5"))


@query
def token_pad(spark, sf):
    d = tx.encode_tokens(documents(spark, sf).select("doc_id", "text"), "text")
    return d.select("doc_id", big(F.size("tokens")).alias("n_ids"),
                    big(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("n_real"),
                    F.md5(F.array_join("tokens", " ")).alias("ids_md5"))


# --- retrieval --------------------------------------------------------------------------------

@query
def knn_topk(spark, sf):
    e = neighbours_of(spark, sf)
    return rounded(knn.knn_exact(e, e, 5), 6, "distance").withColumn("rank", big("rank"))


@query
def knn_cosine(spark, sf):
    e = neighbours_of(spark, sf)
    return rounded(knn.knn_exact(e, e, 5, "cosine"), 6, "distance").withColumn("rank", big("rank"))


@query
def knn_blocks(spark, sf):
    """The way taken when the queries are too many to send to every task."""
    e = neighbours_of(spark, sf)
    return rounded(knn.knn_exact(e, e, 5, query_limit=0), 6, "distance").withColumn("rank", big("rank"))


@query
def knn_lsh(spark, sf):
    e = neighbours_of(spark, sf)
    return knn.knn_lsh(e, e, 5)


@query
def knn_lsh_blocks(spark, sf):
    """The way taken when the queries are too many to send to every task."""
    e = neighbours_of(spark, sf)
    return knn.knn_lsh(e, e, 5, query_limit=0)


def _indexed(spark, sf):
    """All vectors searched through an inverted file; what it found next to the exact answer."""
    e = neighbours_of(spark, sf)
    index = ivf.build_index(e)
    measured = ivf.recall(settled(ivf.search(index, e, 5), "found"), knn.knn_exact(e, e, 5))
    return index, measured.withColumn("share_compared", F.lit(ivf.compared_share(index, e, 5).first()["share_compared"]))


@query
def knn_ivf_recall(spark, sf):
    """Every query gets its five rows, and nine tenths of the true neighbours at least."""
    _, measured = _indexed(spark, sf)
    return measured.select("n_queries", big("least_rows").alias("least_rows"), (F.col("recall") >= 0.9).alias("recall_reached"), (F.col("share_compared") <= 1).alias("share_sound"))


@query
def knn_ivf_report(spark, sf):
    index, measured = _indexed(spark, sf)
    return measured.withColumns({"n_cells": F.lit(len(index.centres)), "n_visited": F.lit(index.probes)})


def _hits(spark, sf):
    e = neighbours_of(spark, sf)
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("source").alias("cve_id"))
    return retrieval.retrieve(e, e.join(texts, "id"), 5)


@query
def rag_context(spark, sf):
    questions = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("question"))
    a = retrieval.answer_records(questions, _hits(spark, sf))
    return a.select("query_id", "answer", F.md5("prompt").alias("prompt_md5"), F.array_join("sources", ",").alias("sources"), "context_chunks")


@query
def hit_lists(spark, sf):
    """Parallel result lists per query, zipped back to hits."""
    e = neighbours_of(spark, sf)
    lists = knn.knn_exact(e, e, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.round("distance", 6).alias("distance")))).alias("h"))
    wide = lists.select("query_id", F.transform("h", lambda h: h["chunk_id"]).alias("docs"),
                        F.transform("h", lambda h: h["rank"]).alias("metas"), F.transform("h", lambda h: h["distance"]).alias("dists"))
    z = retrieval.zipped_hits(wide, "docs", "metas", "dists", "query_id")
    return z.select("query_id", F.col("text").alias("chunk_id"), F.col("distance"), big("rank").alias("rank"))


@query
def retrieval_eval(spark, sf):
    test_set = documents(spark, sf).select(F.col("doc_id").alias("id"), F.col("text").alias("ground_truth"))
    rows = retrieval.evaluation_rows(test_set, retrieval.contexts(_hits(spark, sf)))
    q = retrieval.lexical_quality(rows)
    return rounded(q.select("id", "context_recall", "context_precision", "coverage"), 6, "context_recall", "context_precision", "coverage")


@query
def text_retrieval(spark, sf):
    """Benchmark passages looked up in the chunked documents by hashed term vectors."""
    chunks = tx.explode_chunks(documents(spark, sf).select("doc_id", "text"), "text", "doc_id").select(
        "id", "document", F.col("doc_id").cast("string").alias("cve_id"))
    chunks = settled(chunks, "chunks")  # read by the fit and the embedding
    embedder = retrieval.HashedTfIdf.fit(chunks, "document")
    ready = settled(retrieval.embed(chunks, embedder), "vectors")
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
    hits = retrieval.retrieve(embedder(asked, "question", "embedding"), ready, 5)
    return hits.select("query_id", "rank", "chunk_id", F.round("distance", 6).alias("distance"), "cve_id")


def _messages(spark, sf):
    """Conversations that name an id in each message, one that comes again and one that does not."""
    ids = F.concat(F.lit(" CVE-2021-"), (44000 + F.pmod("conv_id", F.lit(7))).cast("string"), F.lit(", CVE-"),
                   (2014 + F.pmod("turn", F.lit(3))).cast("string"), F.lit("-0160 and CVE-20-1"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat("text", ids).alias("text"))


@query
def cve_sources(spark, sf):
    s = retrieval.conversation_sources(_messages(spark, sf), "conv_id", "turn", "text")
    return s.select("conv_id", "cve_id", "first_turn", big("first_pos").alias("first_pos"))


@query
def message_cve_ids(spark, sf):
    return _messages(spark, sf).select("conv_id", "turn", F.array_join(tx.cve_ids(F.col("text")), ",").alias("ids"))


@query
def tool_trace(spark, sf):
    """Trace text per message: its role and length joined with arrows."""
    m = table(spark, sf, "conversations")
    steps = F.array(F.col("role"), F.length("text").cast("string"), F.lit("done"))
    return m.select("conv_id", "turn", F.array_join(steps, tx.TRACE_JOIN).alias("trace"))


# --- requests ---------------------------------------------------------------------------------

@query
def request_vector(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,double>").alias("features"))
    return e.select("event_id", F.array_join(requests.feature_vector(F.col("features"), ["k", "absent"]), ",").alias("vector"))


@query
def request_validate(spark, sf):
    q = table(spark, sf, "documents").select("doc_id", F.col("text").alias("query"))
    ok, refused = requests.split_by_reason(q, requests.validate_query(F.col("query")))
    both = ok.select("doc_id", F.lit("accepted").alias("verdict")).unionByName(refused.select("doc_id", F.col("reason").alias("verdict")))
    return both


@query
def payload_parse(spark, sf):
    """Bodies as named values, under ``features``, as a list, and as ``data``."""
    e, p = table(spark, sf, "events"), F.col("props")
    kind = F.col("event_id") % 4
    body = (F.when(kind == 0, p).when(kind == 1, F.concat(F.lit('{"features": '), p, F.lit("}")))
            .when(kind == 2, F.concat(F.lit('{"features": ['), F.col("value").cast("string"), F.lit(", 2]}"))))
    data = F.when(kind == 3, p)
    v = requests.payload_vector(body, data)
    return e.select("event_id", F.size(v).cast("bigint").alias("n"), F.get(v, F.lit(0)).alias("first_value"))


# --- models -----------------------------------------------------------------------------------

_SMALL = TreeSettings(trees=4, depth=4, parallel_fits=3)


def _train(spark, sf):
    """Flows with a row key, written once: training reads its input many times."""
    f = clean.nullify_infinite(spread(flows(spark, sf, "l_orderkey", "l_partkey", "l_suppkey")))
    return settled(f.withColumn("key", F.xxhash64(*f.columns)), "train")


_MODEL_NAMES = ["total_fwd_packets", "total_bwd_packets", "total_len_fwd_packets", "flow_duration", "flow_bytes_per_s",
                "flow_iat_mean", "fwd_header_len"]


@query
def model_report(spark, sf):
    """Soft vote fitted on the train split, reported on the rest."""
    parts = split.quick_split(_train(spark, sf), "key")
    model = fit_soft_vote(parts.where("is_train"), _MODEL_NAMES, "label", _SMALL)
    return evaluate.classification_report(model.transform(parts.where("not is_train")), classes=model.classes)


@query
def softmax_rows(spark, sf):
    """One boosted model for all classes: every row gets shares that sum to 1, gaps or not."""
    rows = _train(spark, sf)
    model = fit_softmax(rows, _MODEL_NAMES, "label", SoftmaxSettings(rounds=3, depth=3, rate=0.3))
    out = model.transform(rows)
    total = F.aggregate("probabilities", F.lit(0.0), lambda s, x: s + x)
    return out.groupBy("label_str").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.abs(total - 1) < 1e-9) & F.col("prediction").isNotNull()).alias("n_scored"))


def _fitted(spark, sf):
    rows = _train(spark, sf)
    model = fit_soft_vote(rows, _MODEL_NAMES, "label", _SMALL)
    detector = AnomalyDetector(_MODEL_NAMES, 4)
    detector.fit(clean.benign(rows))
    return rows, model, detector


@query
def batch_score(spark, sf):
    rows, model, detector = _fitted(spark, sf)
    out = jobs.score(rows.na.fill(0.0), model, detector, top_n=3)
    return out.select("key", "prediction", "label_id", "confidence", "anomaly_score", "is_anomaly",
                      F.to_json("shap_top_features").alias("shap_top_features"))


@query
def batch_score_rows(spark, sf):
    """Every row comes back scored, gaps or not."""
    rows, model, detector = _fitted(spark, sf)
    out = jobs.score(rows.drop("label"), model, detector, top_n=0)
    sound = F.col("confidence").between(0, 1) & F.col("anomaly_score").between(0, 1) & F.col("is_anomaly").isNotNull() & F.col("prediction").isNotNull()
    return out.groupBy("label_str").agg(F.count(F.lit(1)).alias("n"), F.count_if(sound).alias("n_scored"))


@query
def score_table_rows(spark, sf):
    """Every row scored by the SQL function ``score_flows`` over a whole table."""
    rows, model, detector = _fitted(spark, sf)
    out = score_table(spark, rows.drop("label"), model, detector)
    sound = F.col("confidence").between(0, 1) & F.col("anomaly_score").between(0, 1) & F.col("is_anomaly").isNotNull() & F.col("prediction").isNotNull()
    return out.groupBy("label_str").agg(F.count(F.lit(1)).alias("n"), F.count_if(sound).alias("n_scored"))


@query
def corpus_answers(spark, sf):
    """Ingest, embed, retrieve: all documents and all benchmark passages loaded as two sources, documents that have a
    label loaded once more in small letters, then every passage asked of the chunk table."""
    d, passages = table(spark, sf, "documents"), table(spark, sf, "benchmark")

    def records(rows, name, text, source):
        return rows.select(name.alias("cve_id"), F.lit(0).alias("item_no"), text.alias("text"), F.lit(0.0).alias("score"), F.lit(corpus.UNKNOWN).alias("severity"),
                           F.array().cast("array<string>").alias("cwes"), F.lit("").alias("attack_type"), F.lit(source).alias("source"))

    first = corpus.corpus_chunks(records(d, F.concat(F.lit("doc_"), "doc_id"), F.col("text"), "documents"))
    second = corpus.corpus_chunks(records(passages, F.concat(F.lit("item_"), "item_id"), F.col("text"), "benchmark"))
    again = corpus.corpus_chunks(records(d.join(table(spark, sf, "labels").select("doc_id"), "doc_id"), F.concat(F.lit("doc_"), "doc_id"), F.lower("text"), "documents"))
    first, second = settled(first, "chunks"), settled(second, "chunks")  # read by the fit and the loading
    embedder = retrieval.HashedTfIdf.fit(first.unionByName(second), "document")
    path = fresh_path(spark, "chunks")
    for chunks in (first, second, again):
        jobs.load_chunks(spark, chunks, path, embedder)
    a = jobs.answer(passages.select(F.col("item_id").alias("id"), F.col("text").alias("question")), VersionedTable(spark, path).read(), embedder, 3)
    return a.select("query_id", "answer", F.transform("contexts", F.md5).alias("contexts_md5"), F.array_join("sources", ",").alias("sources"), "context_chunks")


@query
def stratified_folds(spark, sf):
    f = split.stratified_fold(table(spark, sf, "orders"), ["o_orderstatus"], "o_orderkey", 5)
    return f.groupBy("o_orderstatus", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query
def tree_attribution(spark, sf):
    """Mean attribution per feature over all rows."""
    rows = _train(spark, sf)
    model = fit_soft_vote(rows, _MODEL_NAMES, "label", TreeSettings(trees=4, depth=4, forest=False))
    top = top_attributions(model, rows.select(*_MODEL_NAMES), len(_MODEL_NAMES)).select(F.inline("top_features"))
    return top.groupBy("feature").agg(F.avg("shap").alias("mean_shap"), F.count(F.lit(1)).alias("n"))


@query
def tree_sum_rule(spark, sf):
    """Attributions and the mean output add up to every row's margins."""
    rows = _train(spark, sf)
    model = fit_soft_vote(rows, _MODEL_NAMES, "label", TreeSettings(trees=3, depth=7, forest=False))
    told = sum_rule_gap(model, rows.select("label_str", *_MODEL_NAMES))
    return told.groupBy("label_str").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") < 1e-9).alias("n_adding_up"))


@query
def top_values(spark, sf):
    """The three largest entries by magnitude of each embedding."""
    e = table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))
    names = [f"d{i:02d}" for i in range(64)]
    t = e.select("vec_id", F.posexplode(top_n_of(names, F.col("v"), 3)).alias("pos", "f"))
    return t.select("vec_id", big("pos").alias("pos"), "f.feature", "f.value")


def _forest(spark, sf):
    rows = _train(spark, sf)
    return rows, forest_importance(rows, _MODEL_NAMES, "label", "key", trees=4, depth=5, folds=3)


@query
def rf_importance(spark, sf):
    rows, result = _forest(spark, sf)
    return importance_comparison(result.importance, stats_tests.kruskal_wallis(rows, _MODEL_NAMES, "label_str"))


@query
def cv_scores(spark, sf):
    _, result = _forest(spark, sf)
    return evaluate.fold_summary(result.folds)


@query
def text_classifier(spark, sf):
    """Language of the whole document text."""
    d = documents(spark, sf)
    known = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr", "it", "pt")])
    rows = d.select("doc_id", "text", F.array_position(known, F.col("lang")).cast("int").alias("label"))
    _, held = train_text_classifier(rows, "doc_id", 1024, 10)
    return evaluate.confusion(held.withColumn("prediction", F.col("prediction").cast("int")))


@query
def pca_anomaly(spark, sf):
    rows = _train(spark, sf)
    detector = AnomalyDetector(_MODEL_NAMES, 4)
    detector.fit(clean.benign(rows))
    return detector.score(rows).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("is_anomaly").cast("double")).alias("share"), F.avg("anomaly_score").alias("mean_score"))


@query
def latent_encode(spark, sf):
    e = table(spark, sf, "embeddings")
    wide = e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"d{i:02d}") for i in range(64)])
    detector = AnomalyDetector([f"d{i:02d}" for i in range(64)], 8)
    detector.fit(wide)
    return detector.encode(wide).select("vec_id", F.size("latent").alias("width"), F.col("latent")[0].alias("first_value"),
                                        F.round(F.aggregate("latent", F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"))


# --- streams ----------------------------------------------------------------------------------

@query
def stream_request_metrics(spark, sf):
    events = streams.event_stream(spark, sf, "events.parquet")
    m = streams.request_metrics_stream(events, ["event_type"], "value", F.col("event_type") == "error", fresh_path(spark, "metrics"))
    out = m.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type",
                   "p50_ms", "p95_ms", "p99_ms", "error_rate", "total_requests", "is_closed")
    return rounded(out, 6, "p50_ms", "p95_ms", "p99_ms", "error_rate")


@query
def stream_sigmoid(spark, sf):
    """A fixed threshold over arriving events."""
    events = streams.event_stream(spark, sf, "events.parquet")
    out = streams.score_stream(events, lambda d: d.select("event_id", sigmoid_score(F.col("value"), 100.0).alias("score"),
                                                          (F.col("value") > 100.0).alias("is_anomaly")), fresh_path(spark, "sigmoid"))
    return rounded(out, 9, "score")


@query
def stream_score(spark, sf):
    """A fitted detector over arriving events."""
    rows = table(spark, sf, "events").select("value", F.length("props").cast("double").alias("size"), F.col("user_id").cast("double").alias("who"))
    detector = AnomalyDetector(["value", "size", "who"], 2)
    detector.fit(rows)
    events = streams.event_stream(spark, sf, "events.parquet").select(
        "event_id", "value", F.length("props").cast("double").alias("size"), F.col("user_id").cast("double").alias("who"))
    return streams.score_stream(events, detector.score, fresh_path(spark, "scored"))


@query
def stream_drift(spark, sf):
    events = streams.event_stream(spark, sf, "events.parquet")
    d = streams.drift_stream(events, _share("value"), _baseline(spark, sf), fresh_path(spark, "drift"))
    return d.select("kl_divergence", "is_drifting", "window_size", "out_of_range",
                    F.substring("window_label", 1, 10).alias("window_label"), "is_closed")


@query
def stream_rolling(spark, sf):
    """Rolling percentiles, error rate and totals at every request, from state kept by a stream."""
    events = streams.event_stream(spark, sf, "events.parquet")
    log = events.select("event_id", F.unix_micros("ts").alias("at"), F.col("event_type").alias("route"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error"))
    out = rolling_stream(log, "route", "at", "event_id", "latency_ms", fresh_path(spark, "rolling"), F.col("error") | (F.col("latency_ms") > 100))
    return rounded(out, 6, "p50_ms", "p95_ms", "p99_ms", "error_rate")


@query
def stream_last_n(spark, sf):
    events = streams.event_stream(spark, sf, "events.parquet")
    last = streams.last_n_stream(events, "user_id", ["ts", "event_id"], 5, fresh_path(spark, "last"))
    return last.select("user_id", "event_id", "value")
