"""Score histograms, drift between them, and request metrics."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.operators.ordered import positions, quantile_columns

# Bins, smoothing, alert level and the least window size of a drift check.
N_BINS = 50
EPSILON = 1e-10
KL_THRESHOLD = 0.1
MIN_WINDOW = 10
# Percentiles and length of the rolling request window.
PERCENTILES = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}
ROLLING_ROWS = 1000


def score_bin(score: Column, n_bins: int = N_BINS) -> Column:
    """Bin 1..n over [0, 1], null outside; a score on an inner edge belongs to the upper bin
    and 1.0 to the last one. Edges are multiples of 1/n, compared as such."""
    step = 1.0 / n_bins
    guess = F.least(F.floor(score * n_bins), F.lit(n_bins - 1))
    lower = F.when(score < guess * step, guess - 1).otherwise(guess)
    place = F.when((lower < n_bins - 1) & (score >= (lower + 1) * step), lower + 1).otherwise(lower)
    return F.when((score >= 0) & (score <= 1), place + 1).cast("int")


def bin_counts(df: DataFrame, score: Column, keys: Sequence[str] = (), n_bins: int = N_BINS) -> DataFrame:
    """Row counts per (keys, bin) for the bins that occur; bin 0 collects scores outside [0, 1]."""
    b = F.coalesce(score_bin(score, n_bins), F.lit(0))
    return df.where(score.isNotNull()).select(*keys, b.alias("bin")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


def histograms(counts: DataFrame, keys: Sequence[str] = (), n_bins: int = N_BINS) -> DataFrame:
    """Per key: the smoothed histogram as an array, the window size and the rows out of range.

    Input is (keys, bin, n) with one row per bin, so a group holds ``n_bins`` + 1 entries at most.
    """
    packed = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", F.col("n").cast("double")))).alias("_m"),
        F.sum("n").alias("window_size"))
    return packed.select(
        *keys,
        F.transform(F.sequence(F.lit(1), F.lit(n_bins)),
                    lambda b: F.coalesce(F.try_element_at("_m", b), F.lit(0.0)) + EPSILON).alias("hist"),
        "window_size",
        F.coalesce(F.try_element_at("_m", F.lit(0)), F.lit(0.0)).cast("bigint").alias("out_of_range"))


def score_histogram(df: DataFrame, score: Column, keys: Sequence[str] = (), n_bins: int = N_BINS) -> DataFrame:
    """Rows (keys, bin 1..n, weight) with smoothing, empty bins included."""
    h = histograms(bin_counts(df, score, keys, n_bins), keys, n_bins)
    return h.select(*keys, F.posexplode("hist").alias("bin", "weight")).withColumn("bin", F.col("bin") + 1)


def _normalised(h: Column) -> Column:
    clipped = F.transform(h, lambda x: F.greatest(x, F.lit(EPSILON)))
    total = F.aggregate(clipped, F.lit(0.0), lambda a, x: a + x)
    return F.transform(clipped, lambda x: x / total)


def symmetric_kl(p: Column, q: Column) -> Column:
    """Mean of the two Kullback-Leibler divergences of two histograms."""
    terms = F.zip_with(_normalised(p), _normalised(q), lambda a, b: (a - b) * F.ln(a / b) / 2)
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


@dataclass
class DriftBaseline:
    """Histogram of the training scores with the settings of the check."""

    hist: list[float]
    n_bins: int = N_BINS
    kl_threshold: float = KL_THRESHOLD
    history: list[str] = field(default_factory=list)

    @classmethod
    def from_scores(cls, df: DataFrame, score: Column, n_bins: int = N_BINS,
                    kl_threshold: float = KL_THRESHOLD) -> DriftBaseline:
        row = histograms(bin_counts(df, score, n_bins=n_bins), n_bins=n_bins).first()
        return cls(list(row["hist"]) if row else [EPSILON] * n_bins, n_bins, kl_threshold)

    def save(self, spark: SparkSession, path: str) -> None:
        row = json.dumps({"baseline_hist": self.hist, "n_bins": self.n_bins, "kl_threshold": self.kl_threshold})
        spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> DriftBaseline:
        row = spark.read.schema("baseline_hist array<double>, n_bins int, kl_threshold double").json(path).first()
        return cls(list(row["baseline_hist"]), row["n_bins"], row["kl_threshold"])

    def check(self, hists: DataFrame, window: str) -> DataFrame:
        """Drift result per window of a ``histograms`` table."""
        base = F.array(*[F.lit(float(x)) for x in self.hist])
        enough = F.col("window_size") >= MIN_WINDOW
        kl = F.when(enough, symmetric_kl(base, F.col("hist"))).otherwise(F.lit(0.0))
        return hists.withColumn("_kl", kl).select(
            F.round("_kl", 6).alias("kl_divergence"), (F.col("_kl") > self.kl_threshold).alias("is_drifting"),
            F.lit(self.kl_threshold).alias("threshold"), "window_size", "out_of_range",
            F.col(window).cast("string").alias("window_label"),
            F.when(~enough, F.lit("insufficient data")).alias("reason"))

    def check_scores(self, df: DataFrame, score: Column, window: str) -> DataFrame:
        return self.check(histograms(bin_counts(df, score, [window], self.n_bins), [window], self.n_bins), window)


def append_history(results: DataFrame, path: str) -> None:
    """Keep drift results as rows of a growing table."""
    results.write.mode("append").parquet(path)


def request_rates(df: DataFrame, keys: Sequence[str], error: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if(error).alias("errors")).withColumn(
        "error_rate", F.col("errors") / F.greatest(F.col("total_requests"), F.lit(1)))


def latency_percentiles(df: DataFrame, keys: Sequence[str], latency: str, error: Column) -> DataFrame:
    """p50 / p95 / p99, error rate and total per key."""
    return request_rates(df, keys, error).join(quantile_columns(df, keys, latency, PERCENTILES), list(keys), "left").select(
        *keys, *PERCENTILES, "error_rate", "total_requests")


def rolling_latency(df: DataFrame, service: str, order: str, tie: str, latency: str,
                    rows: int = ROLLING_ROWS, block: int = 200_000, error: Column | None = None) -> DataFrame:
    """Percentiles over the last ``rows`` requests of the service, at every request; with ``error``
    also their error rate and the number of requests so far.

    Requests are numbered per service and cut in blocks; each block also gets the ``rows`` - 1
    requests before it. So a block is exact by itself and a busy service spreads over many tasks.
    """
    if block < rows:
        raise ValueError("a block must hold a whole window")
    lead = rows - 1
    counted = error is not None
    failed = F.coalesce(error, F.lit(False)) if counted else F.lit(False)
    numbered = positions(df.withColumn("_error", failed.cast("double")), [service], order, tie, "_pos")
    own = F.floor(F.col("_pos") / block).cast("bigint")
    shared = F.when(F.pmod(F.col("_pos"), F.lit(block)) >= block - lead, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.select(service, tie, latency, "_error", "_pos", F.explode(shared).alias("_block"))
    names, probs = list(PERCENTILES), list(PERCENTILES.values())

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_pos")
        window = pdf[latency].rolling(rows, min_periods=1)
        out = pdf[[service, tie]].assign(**{n: window.quantile(p) for n, p in zip(names, probs)})
        if counted:
            out = out.assign(error_rate=pdf["_error"].rolling(rows, min_periods=1).mean(), total_requests=pdf["_pos"] + 1)
        return out[(pdf["_pos"] // block) == pdf["_block"]]

    types = dict(df.dtypes)
    ddl = f"{service} {types[service]}, {tie} {types[tie]}, " + ", ".join(f"{n} double" for n in names)
    ddl += ", error_rate double, total_requests bigint" if counted else ""
    return spread.groupBy(service, "_block").applyInPandas(per_block, ddl)


def request_summary(df: DataFrame, route: str, latency: str, error: Column, routes: Sequence[str]) -> DataFrame:
    """Totals, requests per named route, mean latency (2 decimals) and error rate (4 decimals)."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return df.agg(
        F.count(F.lit(1)).alias("total_requests"),
        *[F.count_if(F.col(route) == r).alias(f"{r}_requests") for r in routes],
        F.round(F.coalesce(F.sum(latency), F.lit(0.0)) / total, 2).alias("avg_latency_ms"),
        F.round(F.count_if(error) / total, 4).alias("error_rate"))


def prediction_tally(df: DataFrame, window: Sequence[str], prediction: str) -> DataFrame:
    """How often each prediction occurs per window; blank predictions are not kept."""
    return df.where(F.col(prediction) != "").groupBy(*window, prediction).agg(F.count(F.lit(1)).alias("n"))
