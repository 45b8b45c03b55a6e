"""Rank and variance tests per feature: Kruskal-Wallis, Levene, Anderson-Darling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.functions.tails import chi2_tail, f_tail, log_normal_cdf
from flowtally.operators.ordered import cumulative_counts, exact_quantiles, mid_ranks
from flowtally.operators.profile import long_form
from flowtally.operators.sized import small_side


def kruskal_wallis(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """H with tie correction and its chi-square tail per feature, largest H first.

    Rows are counted per (feature, value, group) first; mid-ranks come from those counts, so no
    row is ever ranked by itself.
    """
    long = long_form(df, features, [group])
    ranked = mid_ranks(long, ["feature"], "value", group)
    m, c = F.col("m").cast("double"), F.col("c").cast("double")
    sums = (
        ranked.groupBy("feature", group).agg(
            F.sum("m").alias("n_g"), F.sum(m * F.col("mid_rank")).alias("r_g"), F.sum(m * (c * c - 1)).alias("t_g"))
        .groupBy("feature").agg(F.sum("n_g").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("t_g").alias("t"),
                                F.sum(F.col("r_g") * F.col("r_g") / F.col("n_g")).alias("s"))
    )
    n = F.col("n").cast("double")
    correction = 1 - F.col("t") / (n * n * n - n)
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / correction
    tested = sums.where(F.col("k") >= 2).select(
        "feature", F.when(correction > 0, h).alias("h"), (F.col("k") - 1).cast("double").alias("dof"))
    return tested.select("feature", "h", chi2_tail("h", "dof").alias("p_value")).orderBy(F.desc("h"), "feature")


def levene(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Levene's W around group medians with its F tail, per feature.

    Groups that are empty, all zero or without spread are left out; a feature needs two groups.
    """
    long = long_form(df, features, [group]).where(F.col("value").isNotNull() & F.col(group).isNotNull())
    shape = long.groupBy("feature", group).agg(
        F.max(F.abs("value")).alias("top"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    valid = shape.where((F.col("top") > 0) & (F.col("hi") > F.col("lo"))).select("feature", group)
    medians = exact_quantiles(long, ["feature", group], "value", [0.5]).select(
        "feature", group, F.col("quantile").alias("median"))
    centres, _ = small_side(medians.join(valid, ["feature", group], "left_semi"))
    spread = (
        long.join(centres, ["feature", group])
        .withColumn("z", F.abs(F.col("value") - F.col("median")))
        .groupBy("feature", group)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("zbar"), (F.var_pop("z") * F.count(F.lit(1))).alias("within"))
    )
    whole = Window.partitionBy("feature")  # one row per group in each
    centred = spread.withColumn("zall", F.sum(F.col("n") * F.col("zbar")).over(whole) / F.sum("n").over(whole))
    between = centred.groupBy("feature").agg(
        F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("k"), F.sum("within").alias("within_all"),
        F.sum(F.col("n") * (F.col("zbar") - F.col("zall")) * (F.col("zbar") - F.col("zall"))).alias("between"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n_all") - F.col("k")).cast("double")
    w = F.when(F.col("within_all") > 0, d2 / d1 * F.col("between") / F.col("within_all"))
    out = between.where("k >= 2").select("feature", w.alias("w"), d1.alias("d1"), d2.alias("d2"))
    return out.select("feature", "w", f_tail("w", "d1", "d2").alias("p_value"))


def homogeneous_variance(tested: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Features whose group variances do not differ at the given level."""
    return tested.where(F.col("p_value") > alpha)


def critical_value_5pct(n):
    """5 % critical value of the normality statistic for ``n`` values."""
    return 0.787 / (1 + 4 / n - 25 / (n * n))


def anderson_darling(df: DataFrame, features: Sequence[str], critical=critical_value_5pct) -> DataFrame:
    """A² against a fitted normal per feature, its 5 % critical value and the verdict.

    Equal values are handled together: with ``a`` values below and ``c`` equal ones the
    weights 2i-1 of the tie add up to (a+c)² - a², and those of the upper tail to
    (N-a)² - (N-a-c)².
    """
    long = long_form(df, features).where("value is not null")
    fit, _ = small_side(long.groupBy("feature").agg(
        F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"), F.min("value").alias("lo"), F.max("value").alias("hi"),
    ).where("lo < hi").drop("lo", "hi"))
    counts = cumulative_counts(long, ["feature"], "value", {"c": F.count(F.lit(1))}).join(fit, "feature")
    a, c, n = (F.col(x).cast("double") for x in ("c_below", "c", "c_total"))
    w = (F.col("value") - F.col("mu")) / F.col("sd")
    terms = counts.select(
        "feature", n.alias("n"),
        ((c * (2 * a + c)) * log_normal_cdf(w) + (c * (2 * (n - a) - c)) * log_normal_cdf(-w)).alias("term"))
    out = terms.groupBy("feature", "n").agg(F.sum("term").alias("s"))
    a2 = -F.col("n") - F.col("s") / F.col("n")
    return out.select("feature", "n", a2.alias("a2"), critical(F.col("n")).alias("critical")).withColumn(
        "is_normal", F.col("a2") < F.col("critical"))


def normality_tally(tested: DataFrame) -> DataFrame:
    return tested.agg(F.count_if("is_normal").alias("n_normal"), F.count_if(~F.col("is_normal")).alias("n_not_normal"))
