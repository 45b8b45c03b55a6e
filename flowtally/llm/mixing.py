"""Mix sources to target weights: hash-threshold histograms, refined at the boundary bucket only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtally.llm.common import WORD, fixed_hash, free_name
from flowtally.operators.sized import small_side
from flowtally.session import settled

HASH_BITS = 60
STEP_BITS = 10
ALL = 1 << HASH_BITS


def text_size(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def with_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of the sources.

    ``sizes`` has one row per source: source, source_size. Sources in code point order, null last, weigh
    ``weights`` in turn and share ``share`` times all sizes; a target stops at ``most`` times its source's
    size and the excess goes to the others by weight, until none is above. Filling sources in the order of
    their cap per weight gives that end state in one pass. A source without words has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("cap_per_weight", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(most))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    whole = Window.partitionBy()
    return (
        sizes.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("cap_per_weight", cap / F.col("weight"))
        .withColumn("rest", F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("open", cap * F.col("weights_left") > F.col("rest") * F.col("weight"))
        .withColumn("rest_open", F.max(F.when(F.col("open"), F.col("rest"))).over(whole))
        .withColumn("left_open", F.max(F.when(F.col("open"), F.col("weights_left"))).over(whole))
        .withColumn("target", F.when(F.col("open"), F.col("weight") * F.col("rest_open") / F.col("left_open")).otherwise(cap))
        .select("source", "source_size", "target"))


def thresholds(narrow: DataFrame, targets: DataFrame, copies: int = 2) -> DataFrame:
    """For each source the hash bounds below which a document is taken once, twice, ...

    ``narrow``: source, size, h. Each pass sums sizes by (source, copy, bucket of 10 hash bits) within the
    bucket that the budget ends in, and goes down into that bucket; rows are never sorted. It ends when each
    boundary bucket holds one hash; documents with that hash come in if that brings the sum closer to the
    budget. Result: source, source_size, target, bounds (array of longs, one for each copy).
    """
    layer = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("layer")
    state = settled(
        targets.select("source", "source_size", "target", layer)
        .withColumn("budget", F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - F.col("layer") * F.col("source_size"))))
        .withColumn("base", F.lit(0).cast("long"))
        .withColumn("bucket", F.lit(0).cast("long"))
        .withColumn("bound", F.when(F.col("budget") >= F.col("source_size"), F.lit(ALL)).when(F.col("budget") <= 0, F.lit(0)).cast("long")), "mix")
    shift = HASH_BITS
    while shift > 0:
        side, _ = small_side(state.where("bound IS NULL").select(F.col("source").alias("s"), "layer", "budget", "base", "bucket"))
        above, shift = shift, shift - STEP_BITS
        hist = (
            narrow.where("size > 0")
            .join(side, narrow["source"].eqNullSafe(F.col("s")) & (F.shiftright("h", above) == F.col("bucket")))
            .groupBy("s", "layer", "budget", "base", F.shiftright("h", shift).alias("part"))
            .agg(F.sum("size").alias("part_size"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        run = Window.partitionBy("s", "layer").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        ends = (
            hist.withColumn("reach", F.col("base") + F.sum("part_size").over(run))
            .where(F.col("reach") > F.col("budget"))
            .groupBy("s", "layer").agg(F.min(F.struct("part", "reach", "part_size", "lo", "hi")).alias("e")))
        under = F.col("e.reach") - F.col("e.part_size")
        single = F.col("e.lo") == F.col("e.hi")
        nearer = F.col("e.reach") - F.col("budget") < F.col("budget") - under
        ends = ends.withColumnRenamed("layer", "y")
        state = settled(
            state.join(ends, state["source"].eqNullSafe(F.col("s")) & (state["layer"] == F.col("y")), "left")
            .select("source", "source_size", "target", "layer", "budget",
                    F.coalesce(F.when(F.col("e").isNotNull(), under), "base").alias("base"),
                    F.coalesce("e.part", "bucket").alias("bucket"),
                    F.when(F.col("bound").isNotNull(), F.col("bound"))
                    .when(F.col("e").isNull(), F.lit(ALL))
                    .when(single, F.when(nearer, F.col("e.lo") + 1).otherwise(F.col("e.lo"))).alias("bound")), "mix")
        if state.where("bound IS NULL").isEmpty():
            break
    return state.groupBy("source", "source_size", "target").agg(F.transform(F.sort_array(F.collect_list(F.struct("layer", "bound"))), lambda x: x["bound"]).alias("bounds"))


def sized_rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc id, source, size and place on the hash line of every row; the place is a function of the row alone."""
    key = fixed_hash(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col), bits=HASH_BITS)
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size"), key.alias("h"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
             weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(rows, bounds): the sized rows, and the hash bounds of each source.

    Nulls: a null text has size 0, null sources are one source, null ids are hashed by their text. Rows equal
    in id, source and text share a hash and are taken together. An empty table gives two empty tables.
    """
    rows = settled(sized_rows(docs, id_col, text_col, source_col, seed), "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, thresholds(rows, with_targets(sums, weights, share, most), max(1, -int(-most // 1)))


def _copies(h: Column, bounds: Column) -> Column:
    return F.aggregate(bounds, F.lit(0).cast("long"), lambda n, b: n + F.when(h < b, 1).otherwise(0))


def mix_report(docs: DataFrame, **names) -> DataFrame:
    """id, size, source_size, target, taken (words the mix takes of the row, repeats counted), one row per row."""
    rows, bounds = plan_mix(docs, **names)
    side, _ = small_side(bounds.withColumnRenamed("source", "s"))
    return rows.join(side, rows["source"].eqNullSafe(F.col("s"))).select(
        "id", "size", "source_size", "target", (F.col("size") * _copies(F.col("h"), F.col("bounds"))).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **shares) -> DataFrame:
    """The mix itself: all columns of ``docs``, each row as often as the mix takes it. The texts are not shuffled."""
    _, bounds = plan_mix(docs, id_col, text_col, source_col, seed, **shares)
    side, _ = small_side(bounds.select(F.struct(F.col("source").alias("s"), F.col("bounds").alias("b")).alias(m := free_name(docs, "mix"))))
    h = fixed_hash(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col), bits=HASH_BITS)
    n = free_name(docs, "mix_copy")
    return (docs.join(side, F.col(source_col).eqNullSafe(F.col(f"{m}.s")))
            .withColumn(n, F.explode(F.array_repeat(F.lit(1), _copies(h, F.col(f"{m}.b")).cast("int"))))
            .select(*[docs[c] for c in docs.columns]))
