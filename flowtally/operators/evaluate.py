"""Classifier and detector metrics as aggregates over (label, prediction, scores)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.numeric import safe_ratio
from flowtally.operators.clean import lookup
from flowtally.operators.ordered import cumulative_counts


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    """Rows per (label, prediction); with ``weight`` the rows are counts already."""
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    return df.groupBy(label, prediction).agg(rows.alias("n"))


def display_name(cls: Column, names: dict[int, str], prefix: str = "Class_") -> Column:
    """Name of a class id, ``Class_<id>`` where it has none."""
    default = F.concat(F.lit(prefix), cls.cast("string"))
    return F.coalesce(lookup(names, cls.cast("int")), default) if names else default


def class_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                 classes: Sequence[int] = (), weight: str | None = None) -> DataFrame:
    """Support, predicted and hit counts per class seen in truth or prediction, or listed."""
    cells = confusion(df, label, prediction, weight)
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(F.lit(0))
    none = F.lit(0).cast("bigint")
    sides = cells.select(F.inline(F.array(
        F.struct(F.col(label).cast("int").alias("cls"), F.col("n").alias("support"), none.alias("predicted"), hit.alias("tp")),
        F.struct(F.col(prediction).cast("int").alias("cls"), none.alias("support"), F.col("n").alias("predicted"), none.alias("tp")))))
    if classes:
        listed = df.sparkSession.createDataFrame([(int(c), 0, 0, 0) for c in classes],
                                                 "cls int, support bigint, predicted bigint, tp bigint")
        sides = sides.unionByName(listed)
    return sides.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])


def _with_scores(counts: DataFrame) -> DataFrame:
    scored = counts.withColumn("precision", safe_ratio(F.col("tp"), F.col("predicted"))).withColumn(
        "recall", safe_ratio(F.col("tp"), F.col("support")))
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", safe_ratio(2 * p * r, p + r))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          classes: Sequence[int] = (), names: dict[int, str] | None = None,
                          weight: str | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class, then the micro, macro and weighted rows.
    A zero denominator gives 0."""
    per_class = _with_scores(class_counts(df, label, prediction, classes, weight))
    if classes:
        per_class = per_class.where(F.col("cls").isin([int(c) for c in classes]))
    scores = ("precision", "recall", "f1")
    rows = per_class.select(display_name(F.col("cls"), names or {}).alias("name"), *scores, "support")
    totals = per_class.agg(
        F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support"),
        *[F.avg(s).alias(f"macro_{s}") for s in scores],
        *[F.sum(F.col(s) * F.col("support")).alias(f"sum_{s}") for s in scores])
    micro = _with_scores(totals)

    def entry(name: str, values: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("name"), *[v.alias(s) for s, v in zip(scores, values)],
                        F.col("support").alias("support"))

    summary = micro.select(F.inline(F.array(
        entry("micro avg", [F.col(s) for s in scores]),
        entry("macro avg", [F.col(f"macro_{s}") for s in scores]),
        entry("weighted avg", [safe_ratio(F.col(f"sum_{s}"), F.col("support")) for s in scores]))))
    return rows.unionByName(summary)


def macro_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _with_scores(class_counts(df, label, prediction)).agg(F.avg("f1").alias("f1_macro"))


def one_vs_rest(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """Rows (cls, score, positive): one per row and class."""
    return df.select(F.col(label).alias("_y"), F.posexplode(probabilities).alias("cls", "score")).select(
        "cls", "score", (F.col("_y") == F.col("cls")).cast("int").alias("positive"))


def _curve(scored: DataFrame, keys: Sequence[str], score: str, positive: str) -> DataFrame:
    """Counts per distinct score: positives and rows at it, below it and in all."""
    return cumulative_counts(scored, keys, score, {
        "n": F.count(F.lit(1)), "p": F.sum(F.col(positive).cast("bigint"))})


def _area() -> Column:
    """Rank form of the area under the ROC curve, equal scores counting half. Null unless both
    outcomes occur."""
    below = (F.col("n_below") - F.col("p_below")).cast("double")
    here = (F.col("n") - F.col("p")).cast("double")
    pos, neg = F.max("p_total").cast("double"), F.max(F.col("n_total") - F.col("p_total")).cast("double")
    return F.when((pos > 0) & (neg > 0), F.sum(F.col("p") * (below + here / 2)) / (pos * F.nullif(neg, F.lit(0.0))))


def _flagged() -> Column:
    """Rows flagged when everything from this score up is flagged."""
    return (F.col("n_total") - F.col("n_below")).cast("double")


def _hits() -> Column:
    """Positives among the flagged rows."""
    return (F.col("p_total") - F.col("p_below")).cast("double")


def _mean_precision() -> Column:
    """Precision at every distinct score, weighted by the recall gained there. Null without positives."""
    share = F.try_divide(F.col("p"), F.col("p_total"))
    return F.sum(share * _hits() / _flagged())


def roc_auc(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", positive: str = "positive") -> DataFrame:
    """Area under the ROC curve per group; groups need both outcomes."""
    c = _curve(scored, keys, score, positive)
    return c.groupBy(*keys).agg(_area().alias("roc_auc")).where("roc_auc IS NOT NULL")


def average_precision(scored: DataFrame, keys: Sequence[str] = (), score: str = "score",
                      positive: str = "positive") -> DataFrame:
    c = _curve(scored, keys, score, positive)
    return c.groupBy(*keys).agg(_mean_precision().alias("avg_precision")).where("avg_precision IS NOT NULL")


def macro_ovr(df: DataFrame, label: str = "label", probabilities: str = "probabilities") -> DataFrame:
    """Mean one-vs-rest ROC area and average precision over the classes that have them; both
    come from the same counts."""
    c = _curve(one_vs_rest(df, label, probabilities), ["cls"], "score", "positive")
    per_class = c.groupBy("cls").agg(_area().alias("a"), _mean_precision().alias("p"))
    return per_class.agg(F.coalesce(F.avg("a"), F.lit(0.0)).alias("roc_auc_macro"),
                         F.coalesce(F.avg("p"), F.lit(0.0)).alias("auc_pr_macro"))


def _with_f1(curve: DataFrame, score: str, eps: float) -> DataFrame:
    points = curve.withColumns({"precision": _hits() / _flagged(), "recall": F.try_divide(_hits(), F.col("p_total"))})
    p, r = F.col("precision"), F.col("recall")
    return points.withColumns({"threshold": F.col(score), "f1": 2 * p * r / (p + r + eps)})


def pr_curve(scored: DataFrame, score: str = "score", positive: str = "positive", eps: float = 1e-8) -> DataFrame:
    """Precision, recall and F1 at every distinct score."""
    return _with_f1(_curve(scored, [], score, positive), score, eps).select("threshold", "precision", "recall", "f1")


def _best() -> list[Column]:
    """Largest F1 and its threshold, the lowest one of equals (0.5 without a curve)."""
    top = F.max(F.when(F.col("f1").isNotNull(), F.struct("f1", (-F.col("threshold")).alias("low"))))
    return [F.coalesce(top["f1"], F.lit(0.0)).alias("best_f1"), F.coalesce(-top["low"], F.lit(0.5)).alias("best_threshold")]


def best_f1(scored: DataFrame, score: str = "score", positive: str = "positive", eps: float = 1e-8) -> DataFrame:
    return _with_f1(_curve(scored, [], score, positive), score, eps).agg(*_best())


def evaluate_detector(scored: DataFrame, score: str = "score", positive: str = "positive", eps: float = 1e-8) -> DataFrame:
    """One row: ROC area, best F1 and its threshold, from one set of counts."""
    return _with_f1(_curve(scored, [], score, positive), score, eps).agg(_area().alias("roc_auc"), *_best())


def fold_summary(scores: DataFrame, column: str = "score") -> DataFrame:
    """Mean and population deviation of fold scores."""
    return scores.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))
