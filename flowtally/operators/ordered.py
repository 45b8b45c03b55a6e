"""Order statistics of groups of any size.

A window ordered over a whole group runs in one task, and one class may hold most of the rows. Ranks and running sums
come from range parts instead (``ranged``): equal values are counted together first, the counts are dealt by ranges of
(group, value) into sorted parts, one total per part goes into running sums, and these offsets come back.

Quantiles need no order at all: a mergeable sketch of each group brackets the wanted ranks, and what lies below and
inside a bracket is counted exactly. A bracket that is still large is bracketed again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.functions.numeric import is_finite
from flowtally.operators.ranged import PART, beside_parts, dealt_by_part, part_offsets, parts_for, places, ranged, running_sums
from flowtally.operators.sized import small_side
from flowtally.session import settled

#: Rows of a bracket whose values are ordered in one task.
MAX_BRACKET = 1_000_000
#: Size of a sketch, how far a bracket reaches beyond the wanted rank as a share of the rows, and steps of its ends.
SKETCH_SIZE = 1024
MARGIN = 0.01
GRID = 256
#: Brackets that are sent to every task.
SENT_BRACKETS = 200_000
SALTS = 64


def _usable(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    keep = is_finite(F.col(value).cast("double"))
    for k in keys:
        keep = keep & F.col(k).isNotNull()
    return df.where(keep)


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """One row per (keys, distinct value) with each aggregate of ``sums`` (additive ones),
    ``<name>_below`` (the same over all smaller values) and ``<name>_total``.

    Rows with a null key or a null, NaN or infinite value are left out.
    """
    base, by = _keyed(_usable(df, keys, value), keys)
    counted = base.groupBy(*by, value).agg(*[agg.alias(name) for name, agg in sums.items()])
    told = running_sums(counted, by, [value], {n: n for n in sums}, parts)
    return told.select(*keys, value, *sums, *[f"{n}_below" for n in sums], *[f"{n}_total" for n in sums])


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str, detail: str, parts: int | None = None) -> DataFrame:
    """Rows (keys, value, detail, m, c, mid_rank): ``m`` rows with this value and detail, ``c``
    rows with this value, and the mean rank of those ``c`` rows in the group."""
    base, by = _keyed(_usable(df, [*keys, detail], value), keys)
    counts = settled(base.groupBy(*by, value, detail).agg(F.count(F.lit(1)).alias("m")), "counts")
    parts = parts or parts_for(counts)
    rows = ranged(counts, [*by, value], parts)  # rows of a value share a part
    told = dealt_by_part(beside_parts(rows, by, part_offsets(rows, by, {"m": F.sum("m")})), by, parts)
    up_to = Window.partitionBy(*by, PART).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = told.withColumn("_upto", F.col("m_before") + F.sum("m").over(up_to)).withColumn(
        "c", F.sum("m").over(Window.partitionBy(*by, PART, value)))
    return counted.select(*keys, value, detail, "m", "c", (F.col("_upto") - (F.col("c") - 1) / 2).alias("mid_rank"))


def _sketch(rows: str = "true") -> list[Column]:
    """Rows that meet a condition, their ends and a sketch of their values."""
    return [F.expr(f"{agg} FILTER (WHERE {rows})").alias(name) for name, agg in (
        ("_rows", "count(1)"), ("_min", "min(_v)"), ("_max", "max(_v)"), ("_sketch", f"kll_sketch_agg_double(_v, {SKETCH_SIZE})"))]


def _bracket(rank: Column) -> dict[str, Column]:
    """Two values that should enclose a rank, and about how many rows lie between, from a sketch of ``_rows`` rows."""
    grid = F.call_function("kll_sketch_get_quantile_double", F.col("_sketch"), F.array(*[F.lit(i / GRID) for i in range(GRID + 1)]))
    low, high = F.floor(rank) / F.col("_rows") - MARGIN, (F.ceil(rank) + 1) / F.col("_rows") + MARGIN
    lower, upper = F.floor(low * GRID).cast("int"), F.ceil(high * GRID).cast("int")
    return {"_grid": grid, "_lo": F.when(lower <= 0, F.col("_min")).otherwise(F.get("_grid", F.least(lower, F.lit(GRID)))),
            "_hi": F.when(upper >= GRID, F.col("_max")).otherwise(F.get("_grid", F.greatest(upper, F.lit(0)))),
            "_about": F.col("_rows") * (2 * MARGIN + 2 / GRID) + 2}


def _with_bracket(sketches: DataFrame, rank: Column) -> DataFrame:
    columns = _bracket(rank)
    return sketches.withColumn("_grid", columns.pop("_grid")).withColumns(columns)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], max_bracket: int | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (keys, prob, quantile, n).

    One read sketches the groups. A second one counts the rows below each bracket and each value inside, so that a rank
    is found exactly; raw rows are not shuffled. Brackets of more than ``max_bracket`` rows are bracketed again first, a
    read for each time. A rank that its bracket missed is counted over the whole group.
    """
    most = MAX_BRACKET if max_bracket is None else max_bracket
    base, by = _keyed(_usable(df, keys, value), keys)
    base = base.select(*by, F.col(value).cast("double").alias("_v"))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("prob"), ((F.col("_rows") - 1) * float(p)).alias("rank")) for p in probs])
    asked = base.groupBy(*by).agg(*_sketch()).withColumn("_r", F.explode(ranks)).select("*", "_r.prob", "_r.rank")
    kept = [*by, "prob", "rank", "n"]
    wanted = settled(_with_bracket(asked.withColumn("n", F.col("_rows")), F.col("rank")).select(*kept, "_lo", "_hi", "_about"), "brackets")

    def beside(brackets: DataFrame) -> DataFrame:
        """Rows beside the brackets of their group that they are not above."""
        side, _ = small_side(brackets, SENT_BRACKETS)
        return base.join(side, by).where(F.col("_v") <= F.col("_hi"))

    large = (F.col("_about") > most) & (F.col("_hi") > F.col("_lo"))
    while not wanted.where(large).isEmpty():
        told = beside(wanted.where(large)).groupBy(*kept, "_lo", "_hi").agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), *_sketch("_v >= _lo"))
        found = _with_bracket(told.withColumnsRenamed({"_lo": "_old_lo", "_hi": "_old_hi"}), F.col("rank") - F.col("_below"))
        inside = (F.floor("rank") >= F.col("_below")) & (F.ceil("rank") < F.col("_below") + F.col("_rows"))
        narrower = (F.col("_lo") > F.col("_old_lo")) | (F.col("_hi") < F.col("_old_hi"))
        again = found.select(*kept, F.when(inside, F.col("_lo")).otherwise(float("-inf")).alias("_lo"), F.when(inside, F.col("_hi")).otherwise(float("inf")).alias("_hi"),
                             F.when(inside & narrower, F.col("_about")).otherwise(0.0).alias("_about"))
        wanted = settled(wanted.where(~large).unionByName(again), "brackets")

    def ends(brackets: DataFrame) -> DataFrame:
        """The values at the ranks beside the wanted one; null where the bracket missed them."""
        counts = beside(brackets).groupBy(*kept, F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        before = Window.partitionBy(*by, "prob").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        at = counts.withColumn("_a", F.coalesce(F.sum("_c").over(before), F.lit(0)))

        def holds(rank: Column) -> Column:
            return F.when((rank >= F.col("_a")) & (rank < F.col("_a") + F.col("_c")), F.col("_v"))

        return at.groupBy(*kept).agg(F.max(holds(F.floor("rank"))).alias("_low"), F.max(holds(F.ceil("rank"))).alias("_high"))

    out = settled(ends(wanted), "ranks")
    missed = out.where(F.col("_low").isNull() | F.col("_high").isNull())
    if not missed.isEmpty():
        whole = missed.select(*kept, F.lit(float("-inf")).alias("_lo"), F.lit(float("inf")).alias("_hi"))
        out = out.where(F.col("_low").isNotNull() & F.col("_high").isNotNull()).unionByName(ends(whole))
    return out.select(*keys, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("rank") - F.floor("rank"))).alias("quantile"), "n")


def counted_quantiles(counts: DataFrame, keys: Sequence[str], value: str, n: str, named: dict[str, float], parts: int | None = None) -> DataFrame:
    """Exact quantiles per group, one column each, from rows (keys, value, n) that say how often a value comes; no task
    holds the values of a group."""
    base, by = _keyed(_usable(counts, keys, value), keys)
    told = running_sums(base.select(*by, value, F.col(n).alias("_n")), by, [value], {"_n": "_n"}, parts)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_n_below")) & (rank < F.col("_n_below") + F.col("_n")), F.col(value).cast("double")))

    columns = []
    for name, p in named.items():
        rank = (F.col("_n_total") - 1) * float(p)
        share = F.max(rank - F.floor(rank))  # one rank in a group
        columns.append((at(F.floor(rank)) + (at(F.ceil(rank)) - at(F.floor(rank))) * share).alias(name))
    return told.groupBy(*by).agg(*columns).select(*keys, *named)


def quantile_columns(df: DataFrame, keys: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` with one output column per named probability."""
    long, by = _keyed(exact_quantiles(df, keys, value, list(named.values())), keys)
    wide = long.groupBy(*by).agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name) for name, p in named.items()])
    return wide.select(*keys, *named)


def positions(df: DataFrame, keys: Sequence[str], order: str, tie: str, out: str = "pos", parts: int | None = None) -> DataFrame:
    """Exact zero-based position of every row in its group, by (``order``, ``tie``)."""
    return places(df, list(keys), [order, tie], out, "_n_all", parts).drop("_n_all")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt_by: Column,
          out: str = "rank") -> DataFrame:
    """First ``n`` rows of every group by ``order``, ranked from 1.

    Each group is cut in ``SALTS`` random parts that keep their own first ``n``, so a task
    never sees more than a part of a large group.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_rn", F.row_number().over(part)).where(F.col("_rn") <= n)
        .withColumn(out, F.row_number().over(final)).where(F.col(out) <= n)
        .drop("_rn", "_salt")
    )
