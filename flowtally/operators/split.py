"""Reproducible splits, samples, folds and caps, all driven by a fixed hash of a key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from flowtally.functions.numeric import mixed_hash
from flowtally.operators.ordered import top_n
from flowtally.operators.ranged import places
from flowtally.operators.sized import small_side
from flowtally.session import settled

SLICES = 65_536
#: Bits of the hash that one count decides, highest first; the hash has 32.
DIGITS = (16, 16)


def _radix_cut(df: DataFrame, strata: Sequence[str], key: str, seed: int, size: Column) -> Pinned:
    """Per stratum the last row inside a cut after ``size`` rows in (hash, key) order: its hash and key, ``need`` (how
    many of the rows with that hash and key are inside) and ``copies`` (how many there are).

    A radix select: rows are counted by the upper bits of their hash, then those in the bucket with the cut by the
    next bits, until one hash is left. Only counts are ordered, and no more than there are buckets; the keys of one
    hash are counted last. Nothing depends on how the rows are dealt.
    """
    by = list(strata)
    rows, left, cut = df.select(*by, key, mixed_hash(F.col(key), seed).alias("_h")), 32, None
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    for digit in (*DIGITS, 0):
        left -= digit
        inside = rows if cut is None else _beside(rows, cut, by, F.shiftright("_h", left + digit) == F.col("_prefix"), "inner")
        place = F.shiftright("_h", left) if digit else F.col(key)
        held = [] if cut is None else ["_need", "_prefix"]  # one value for a stratum
        counts = inside.groupBy(*by, place.alias("_place")).agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in held])
        if cut is None:
            counts = counts.withColumn("n", F.sum("_rows").over(before)).withColumn("_need", size.cast("bigint")).drop("n")
        upto = counts.withColumn("_upto", F.sum("_rows").over(before.orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        here = upto.where((F.col("_upto") >= F.col("_need")) & (F.col("_upto") - F.col("_rows") < F.col("_need")))
        need = F.col("_need") - (F.col("_upto") - F.col("_rows"))
        if digit:
            cut = _pinned(here.select(*by, F.col("_place").alias("_prefix"), need.alias("_need")))
    return _pinned(here.select(*by, F.col("_prefix").alias("_last_h"), F.col("_place").alias("_last_key"), need.alias("_need"), F.col("_rows").alias("_copies")))


Pinned = tuple[DataFrame, list[Row] | None]


def _pinned(small: DataFrame) -> Pinned:
    """A row per stratum: fetched once if they are few, written if they are many."""
    side, rows = small_side(small)
    return (settled(small, "cut"), None) if rows is None else (side, rows)


def _exact_cut(df: DataFrame, strata: Sequence[str], key: str, seed: int, size: Column, out: str) -> DataFrame:
    """Flag the first ``size`` rows of each stratum in (hash, key) order: a comparison with the last row inside, so no
    row of the table is moved."""
    by = list(strata)
    last = _radix_cut(df, strata, key, seed, size)
    base = df.withColumn("_h", mixed_hash(F.col(key), seed))
    inside = (F.col("_h") < F.col("_last_h")) | ((F.col("_h") == F.col("_last_h")) & (F.col(key) <= F.col("_last_key")))
    return _beside(base, last, by, F.lit(True), "left").select(*df.columns, F.coalesce(inside, F.lit(False)).alias(out))


def content_split(df: DataFrame, fraction: float = 0.8, seed: int = 42, out: str = "is_train") -> DataFrame:
    """``exact_split`` for a table without a key: by a hash of all columns, so that the split follows from the rows and
    the seed alone, however files and parts are cut. Exact where rows repeat, too: of equal rows at the cut as many
    as are needed stay inside. ``df`` should be stored, since it is read several times."""
    whole = df.withColumn("_key", F.xxhash64(*df.columns))
    _, found = _radix_cut(whole, [], "_key", seed, F.floor(F.col("n") * fraction))
    if not found:  # nothing is inside
        return df.withColumn(out, F.lit(False))
    last = found[0]
    h = mixed_hash(F.col("_key"), seed)
    at, below = (h == last["_last_h"]) & (F.col("_key") == last["_last_key"]), (h < last["_last_h"]) | ((h == last["_last_h"]) & (F.col("_key") < last["_last_key"]))
    if last["_need"] == last["_copies"]:
        return whole.withColumn(out, below | at).drop("_key")
    edge = places(whole.where(at).withColumn("_row", F.monotonically_increasing_id()), [], ["_row"], "_pos", "_all")
    return whole.where(~at).withColumn(out, below).drop("_key").unionByName(edge.withColumn(out, F.col("_pos") < last["_need"]).select(*df.columns, out))


def _beside(df: DataFrame, small: Pinned, by: list[str], more: Column, how: str) -> DataFrame:
    """Put the values that ``small`` holds for a stratum beside its rows; without strata there
    is one row of them at most, and they become constants."""
    side, rows = small
    values = [c for c in side.columns if c not in by]
    if not by:
        types = dict(side.dtypes)
        held = rows[0].asDict() if rows else dict.fromkeys(values)
        wide = df.withColumns({c: F.lit(held[c]).cast(types[c]) for c in values})
        return wide.where(more) if how == "inner" else wide
    side = side.select(*[F.col(b).alias(f"_k_{b}") for b in by], *values)
    same = [F.col(b).eqNullSafe(F.col(f"_k_{b}")) for b in by]
    return df.join(side, reduce(and_, [*same, more]), how)


def exact_split(df: DataFrame, key: str, fraction: float = 0.8, seed: int = 42, out: str = "is_train") -> DataFrame:
    """Seeded shuffle and cut at exactly ``int(n * fraction)`` rows.

    The key should be unique. Rows that share a key stay on one side, so with repeated keys the
    cut is off by the copies of the last key.
    """
    return _exact_cut(df, [], key, seed, F.floor(F.col("n") * fraction), out)


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.7, seed: int = 42,
                     out: str = "is_train") -> DataFrame:
    """The same cut within every label, at ``round(n_label * fraction)`` rows."""
    return _exact_cut(df, [label], key, seed, F.floor(F.col("n") * fraction + 0.5), out)


def quick_split(df: DataFrame, key: str, fraction: float = 0.8, seed: int = 42, out: str = "is_train") -> DataFrame:
    """Hash threshold: a narrow projection, the share is right on average only."""
    return df.withColumn(out, mixed_hash(F.col(key), seed) < F.lit(int(fraction * 4294967296)))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in seeded random order."""
    return df.orderBy(mixed_hash(F.col(key), seed), key).limit(n)


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def stratified_fold(df: DataFrame, strata: Sequence[str], key: str, folds: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number in turn within each stratum, in (hash, key) order: its folds differ by one row at most.

    Rows are numbered within slices of the hash space, and counts per (stratum, slice) tell where
    each slice begins, so a stratum with most of the rows is ordered in many tasks. Rows with equal
    keys are numbered in any order.
    """
    h = mixed_hash(F.col(key), seed)
    sliced = df.withColumn("_h", h).withColumn("_slice", F.floor(F.col("_h") / F.lit(4294967296 // SLICES)).cast("int"))
    by, named = list(strata), [f"_by_{c}" for c in strata]
    before = Window.partitionBy(*named).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = (sliced.groupBy(*[F.col(c).alias(n) for c, n in zip(by, named)], F.col("_slice").alias("_s")).agg(F.count(F.lit(1)).alias("_rows"))
              .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows"))
    within = F.row_number().over(Window.partitionBy(*by, "_slice").orderBy("_h", key))
    same = F.col("_slice") == F.col("_s")
    for c, n in zip(by, named):
        same = same & F.col(c).eqNullSafe(F.col(n))
    numbered = sliced.withColumn("_n", within).join(counts, same)
    return numbered.withColumn(out, F.pmod(F.col("_offset") + F.col("_n") - 1, F.lit(folds)).cast("int")).select(*df.columns, out)


def with_fold(df: DataFrame, key: str, folds: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number by hash. The hash does not look at the label, so each fold has each
    label's share, up to chance."""
    return df.withColumn(out, F.pmod(F.floor(mixed_hash(F.col(key), seed) / 1024), F.lit(folds)).cast("int"))


def cap_per_group(df: DataFrame, group: str, key: str, n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group in key order, ranked (a report size, applied before other filters); equal keys go
    by a hash of the row.

    Only groups, keys and hashes are ranked; a row then finds its rank by these three. Of rows that agree in all
    columns, as many as the cap has left.
    """
    narrow = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), F.xxhash64(*df.columns).alias("_h"))
    copies = narrow.groupBy("_g", "_k", "_h").agg(F.count(F.lit(1)).alias("_copies"))
    first = top_n(copies, ["_g"], [F.col("_k").asc(), F.col("_h")], n, F.struct("_k", "_h"), out="_place")
    before = Window.partitionBy("_g").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)  # n rows of a group at most
    kept = settled(first.withColumn("_before", F.coalesce(F.sum("_copies").over(before), F.lit(0))).where(F.col("_before") < n), "capped")
    side, _ = small_side(kept.drop("_place"))
    found = df.withColumn("_own", F.xxhash64(*df.columns)).join(
        side, F.col(group).eqNullSafe(F.col("_g")) & F.col(key).eqNullSafe(F.col("_k")) & (F.col("_own") == F.col("_h")))
    alone = found.where("_copies = 1").withColumn(out, (F.col("_before") + 1).cast("int"))
    # copies of one row: one of them with all its ranks, no more than the cap has left
    again = found.where("_copies > 1").dropDuplicates(["_g", "_k", "_h"]).withColumn(
        out, F.explode(F.sequence((F.col("_before") + 1).cast("int"), F.least(F.col("_before") + F.col("_copies"), F.lit(n)).cast("int"))))
    return alone.select(*df.columns, out).unionByName(again.select(*df.columns, out))
