"""Places and running sums by range parts: one order over a whole table or over groups of any size.

Rows are dealt by ranges of the order into sorted parts and written; a row's place in its part is then a column. One
total per (group, part) goes into running sums, and these offsets go back to the rows. No task orders a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.operators.sized import small_side
from flowtally.session import settled

PART, AT = "_part", "_at"
_PLACES = (1 << 33) - 1
#: Rows of a part on average: more rows make more parts, so a task sorts about as many at any size.
PART_ROWS = 500_000


def parts_for(stored: DataFrame) -> int:
    """Range parts for a stored table: one for each shuffle partition, more where they would pass ``PART_ROWS`` rows."""
    return max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored.count() // PART_ROWS + 1)


def ranged(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` in sorted range parts, written, with ``_part`` (its range) and ``_at`` (the place in it). Rows that agree
    in all of ``order`` share a part, so ``order`` ends in a tie-breaker where many may agree. Nulls come first."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(f"`{c}`") for c in order]
    # the id's upper bits are the part, the lower 33 the place in it
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return settled(dealt.withColumn(PART, F.shiftright("_id", 33).cast("int")).withColumn(AT, F.col("_id").bitwiseAND(F.lit(_PLACES))).drop("_id"), "ranged")


def part_offsets(rows: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per (``by``, part) of ``ranged`` rows: ``_first`` (the least place), each of ``sums`` over the parts before
    (``<name>_before``) and over the whole group (``<name>_total``). A group has one row for each of its parts here."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, PART).agg(F.min(AT).alias("_first"), *[agg.alias(f"{n}_part") for n, agg in sums.items()])
    return totals.select(*by, PART, "_first", *[F.coalesce(F.sum(f"{n}_part").over(before), F.lit(0)).alias(f"{n}_before") for n in sums],
                         *[F.sum(f"{n}_part").over(group).alias(f"{n}_total") for n in sums])


def beside_parts(rows: DataFrame, by: Sequence[str], offsets: DataFrame) -> DataFrame:
    """``rows`` with the offsets of their (``by``, part): sent to all tasks if they are few, else joined by both."""
    side, _ = small_side(offsets)
    same = F.col(PART) == F.col("_p")
    side = side.withColumnRenamed(PART, "_p")
    for c in by:
        side = side.withColumnRenamed(c, f"_by_{c}")
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"`_by_{c}`"))
    return rows.join(side, same).drop("_p", *[f"_by_{c}" for c in by])


def dealt_by_part(rows: DataFrame, by: Sequence[str], parts: int) -> DataFrame:
    """``rows`` of ``parts`` range parts ahead of a window over (``by``, part): a task gets about one part. Dealt by hash,
    several parts would meet in a task."""
    return rows.repartitionByRange(parts, PART, *by)


def places(df: DataFrame, by: Sequence[str], order: Sequence[str], pos: str = "pos", total: str = "n", parts: int | None = None) -> DataFrame:
    """Every row with its exact place (from 0) in its group by ``order``, and the group's number of rows."""
    rows = ranged(df, [*by, *order], parts)
    found = beside_parts(rows, by, part_offsets(rows, by, {"_rows": F.count(F.lit(1))}))
    return found.select(*df.columns, (F.col(AT) - F.col("_first") + F.col("_rows_before")).alias(pos), F.col("_rows_total").alias(total))


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """Every row with, for each name of ``sums``, ``<name>_below`` (the sum of its column over the rows before, in its
    group and ``order``) and ``<name>_total``. ``order`` should tell rows apart."""
    stored = settled(df, "sums")
    parts = parts or parts_for(stored)
    rows = ranged(stored, [*by, *order], parts)
    found = dealt_by_part(beside_parts(rows, by, part_offsets(rows, by, {n: F.sum(c) for n, c in sums.items()})), by, parts)
    inside = Window.partitionBy(*by, PART).orderBy(AT).rowsBetween(Window.unboundedPreceding, -1)
    return found.select(*df.columns, *[(F.col(f"{n}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{n}_below") for n, c in sums.items()],
                        *[F.col(f"{n}_total") for n in sums])
