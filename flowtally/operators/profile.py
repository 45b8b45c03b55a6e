"""Column profiles: missing, infinite, constant and identical columns, spread, correlation.

Every profile is one or two scans with partial aggregation. Wide sums give one row with one
entry per (column, measure), and the entries are then turned into rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.functions.numeric import finite_or_null
from flowtally.operators.ordered import quantile_columns

def _floating(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c.isNull() | F.isnan(c) if name in _floating(df) else c.isNull()


def _as_rows(one_row: DataFrame, entries: list[dict[str, str | Column]]) -> DataFrame:
    """Explode a one-row aggregate: each entry maps output names to columns of that row."""
    structs = [F.struct(*[(v if isinstance(v, Column) else F.col(v)).alias(k) for k, v in e.items()]) for e in entries]
    return one_row.select(F.inline(F.array(*structs)))


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep…, feature, value) with doubles; NaN and infinities as null."""
    values = [finite_or_null(F.col(n).cast("double")).alias(n) for n in features]
    return df.select(*keep, *values).unpivot(list(keep), list(features), "feature", "value")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, nulls left out, most frequent first."""
    return (df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), column))


def table_shape(df: DataFrame, label: str) -> DataFrame:
    """Rows, columns and distinct labels."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"),
                  F.count_distinct(label).alias("n_classes"))


def rows_per_file(df: DataFrame) -> DataFrame:
    """Row count of every file a table is read from."""
    return df.select(F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def label_share(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of all rows per label, two decimals."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", F.round(F.col("n") / total * 100, 2).alias("pct"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column, only columns that have any."""
    names = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(_missing(df, c)).alias(f"m_{c}") for c in names])
    rows = _as_rows(agg, [{"feature": F.lit(c), "n_missing": f"m_{c}",
                           "pct_missing": F.col(f"m_{c}") * 100 / F.col("_rows")} for c in names])
    return rows.where("n_missing > 0")


def high_missing(df: DataFrame, threshold_pct: float = 10.0) -> DataFrame:
    return missing_profile(df).where(F.col("pct_missing") > threshold_pct)


def row_missing_pct(df: DataFrame, out: str = "pct_missing") -> DataFrame:
    share = sum((_missing(df, c).cast("int") for c in df.columns), F.lit(0)) * 100 / F.lit(len(df.columns))
    return df.select(share.alias(out))


def row_missing_profile(df: DataFrame) -> DataFrame:
    """Spread of the missing share over rows, and the number of rows with any gap.

    The share takes one value more than there are columns at most, so the rows are counted per
    value and the spread comes from the counts.
    """
    x, c = F.col("pct_missing"), F.col("_c")
    counted = row_missing_pct(df).groupBy("pct_missing").agg(F.count(F.lit(1)).alias("_c"))
    out = counted.agg(
        F.sum("_c").alias("n"), F.sum(x * c).alias("_s"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.percentile(x, F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]), c).alias("_q"),
        F.sum(F.when(x > 0, c).otherwise(F.lit(0))).alias("rows_with_missing"),
        F.sum(x * x * c).alias("_s2"))
    mean = F.col("_s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("_s2") - F.col("n") * mean * mean, F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0)))
    return out.select("n", mean.alias("mean"), spread.alias("std"), "min", F.col("_q")[0].alias("p25"),
                      F.col("_q")[1].alias("p50"), F.col("_q")[2].alias("p75"), "max", "rows_with_missing")


def infinite_profile(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c in _floating(df)]
    agg = df.agg(*[F.count_if(F.abs(F.col(c)) == float("inf")).alias(f"i_{c}") for c in names])
    return _as_rows(agg, [{"feature": F.lit(c), "n_infinite": f"i_{c}"} for c in names]).where("n_infinite > 0")


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with a single distinct value (null counts as a value)."""
    rows = []
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in df.columns:
        seen = F.when(~_missing(df, c), F.col(c))
        aggs += [F.min(seen).alias(f"lo_{c}"), F.max(seen).alias(f"hi_{c}"), F.count(seen).alias(f"n_{c}")]
        one_value = (F.col(f"n_{c}") == F.col("_rows")) & (F.col(f"lo_{c}") == F.col(f"hi_{c}"))
        rows.append({"feature": F.lit(c),
                     "constant": F.coalesce(one_value, F.lit(False)) | ((F.col(f"n_{c}") == 0) & (F.col("_rows") > 0))})
    return _as_rows(df.agg(*aggs), rows).where("constant").select("feature")


def identical_columns(df: DataFrame) -> DataFrame:
    """Rows (kept, duplicate): columns equal to an earlier column in every row, types included.

    One scan folds a hash per column; columns with equal folds are then compared row by row
    in a second scan, so a hash collision cannot give a wrong answer.
    """
    types = dict(df.dtypes)
    hashed = {c: F.xxhash64(F.col(c)) for c in df.columns}
    prints = df.agg(*[F.bit_xor(h).alias(f"x_{c}") for c, h in hashed.items()],
                    *[F.sum(h.cast("decimal(20,0)")).alias(f"s_{c}") for c, h in hashed.items()],
                    *[F.count(c).alias(f"n_{c}") for c in df.columns]).first()
    groups: dict[tuple, list[str]] = {}
    for c in df.columns:
        groups.setdefault((types[c], prints[f"x_{c}"], prints[f"s_{c}"], prints[f"n_{c}"]), []).append(c)
    pairs = [p for g in groups.values() if len(g) > 1 for p in combinations(g, 2)]
    schema = "kept string, duplicate string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    same = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    found, gone = [], set()
    for i, (a, b) in enumerate(pairs):
        if same[f"p{i}"] == 0 and a not in gone and b not in gone:
            found.append((a, b))
            gone.add(b)
    return df.sparkSession.createDataFrame(found, schema)


def duplicate_row_count(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier row."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates"))


def describe(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles per feature."""
    long = long_form(df, features)
    spread = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = quantile_columns(long, ["feature"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return spread.join(quartiles, "feature", "left").select(
        "feature", "n", "mean", "std", "min", "p25", "p50", "p75", "max")


def outlier_pct(df: DataFrame, features: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Share of rows outside the quartile fences; the denominator is all rows, nulls included."""
    long = long_form(df, features)
    fences = quantile_columns(long, ["feature"], "value", {"q1": 0.25, "q3": 0.75})
    gap = F.col("q3") - F.col("q1")
    # one row per feature, so its size is that of the schema
    judged = long.join(F.broadcast(fences), "feature", "left")
    outside = (F.col("value") < F.col("q1") - reach * gap) | (F.col("value") > F.col("q3") + reach * gap)
    return judged.groupBy("feature").agg((F.count_if(outside) / F.count(F.lit(1)) * 100).alias("outlier_pct"))


def high_outliers(df: DataFrame, features: Sequence[str], threshold_pct: float = 10.0) -> DataFrame:
    return (outlier_pct(df, features).where(F.col("outlier_pct") > threshold_pct)
            .orderBy(F.desc("outlier_pct"), "feature"))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson r of every feature pair (upper triangle), over the rows where both are present.

    A constant member of a pair has no r (null). One scan finds means and constants; in the
    second each task multiplies its block of rows into sums for all pairs and emits one row per
    pair, so the work of many features is a matrix product and not thousands of aggregates.
    """
    features = list(features)
    clean = df.select(*[finite_or_null(F.col(c).cast("double")).alias(c) for c in features])
    ends = clean.agg(*[F.min(c).alias(f"lo_{c}") for c in features],
                     *[F.max(c).alias(f"hi_{c}") for c in features],
                     *[F.avg(c).alias(f"mean_{c}") for c in features]).first()
    means = np.array([ends[f"mean_{c}"] or 0.0 for c in features])
    upper = np.triu_indices(len(features), 1)
    moving = [c for c in features if ends[f"lo_{c}"] is not None and ends[f"lo_{c}"] < ends[f"hi_{c}"]]

    def partial(batches):
        sums = None
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64") - means
            seen = ~np.isnan(x)
            x, m = np.where(seen, x, 0.0), seen.astype("float64")
            # over the rows where both i and j are present
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, (x * x).T @ m, m.T @ (x * x)])
            sums = part if sums is None else sums + part
        if sums is not None:
            n, sx, sy, sxy, sxx, syy = (s[upper] for s in sums)
            yield pd.DataFrame({"i": upper[0], "j": upper[1], "n": n, "sx": sx, "sy": sy,
                                "sxy": sxy, "sxx": sxx, "syy": syy})

    parts = clean.mapInPandas(partial, "i int, j int, n double, sx double, sy double, sxy double, sxx double, syy double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")])
    names = F.array(*[F.lit(c) for c in features])
    n = F.nullif(F.col("n"), F.lit(0.0))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    var_x, var_y = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    out = s.select(
        F.get(names, F.col("i")).alias("feature_a"), F.get(names, F.col("j")).alias("feature_b"),
        # a spread this far below the squares is rounding of a constant
        F.when((var_x > 1e-13 * F.col("sxx")) & (var_y > 1e-13 * F.col("syy")), cov / (F.sqrt(var_x) * F.sqrt(var_y))).alias("r"))
    return out.withColumn("r", F.when(F.col("feature_a").isin(moving) & F.col("feature_b").isin(moving), F.col("r")))


def high_correlations(corr: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs beyond the threshold in absolute value."""
    return corr.where(F.abs("r") > threshold)


def multicollinear(corr: DataFrame, threshold: float = 0.85, cut: float = 0.95) -> DataFrame:
    """Of the high pairs, those whose signed r reaches ``cut``."""
    return high_correlations(corr, threshold).where(F.col("r") >= cut)


def null_loss(df: DataFrame, label: str) -> DataFrame:
    """Rows per label before and after removal of rows with any null: left join and difference."""
    before = value_counts(df, label).withColumnRenamed("n", "n_before")
    after = value_counts(df.na.drop("any"), label).withColumnRenamed("n", "n_after")
    lost = F.col("n_before") - F.col("n_after")
    return before.join(after, label, "left").select(
        label, "n_before", "n_after", lost.alias("abs_difference"),
        F.round(lost * 100 / F.col("n_before"), 2).alias("pct_difference"))


