"""Line dedup: ranks of line runs by prefix doubling; later copies of repeated runs are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.llm.common import WORD, free_name, row_key
from flowtally.session import settled

#: Words that a repeated run of lines needs.
MIN_WORDS = 8


def worded_lines(text: Column) -> Column:
    """The lines of a text that hold a word, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key, i (number among the lines with words), words, h1, h2 (128 bits of the line)."""
    text = F.col(text_col)
    line = F.transform(worded_lines(text), lambda x: F.struct(F.regexp_count(x, F.lit(WORD)).alias("words"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))
    return (docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), text).alias("key"), F.posexplode(line).alias("i", "x"))
            .select("id", "key", "i", "x.*"))


def ranked(runs: DataFrame, *cols: str) -> DataFrame:
    """cols and rank: the places, in sorted order, of the values that come more than once. Counting comes before
    sorting, so that a value with very many rows is one row here."""
    repeated = runs.groupBy(*cols).agg(F.count("*").alias("copies")).where("copies > 1").select(*cols)
    return settled(repeated.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("rank", F.monotonically_increasing_id()), "ranks")


def _needed(ids: list[int], words: list[int], least: int) -> set[tuple[int, int]]:
    """(first line, number of lines) of the shortest runs of consecutive lines with ``least`` words, for every
    first and every last line: each longer run is a union of these."""
    out, n = set(), len(ids)
    begin = 0
    while begin < n:
        end = begin
        while end + 1 < n and ids[end + 1] == ids[end] + 1:
            end += 1
        to, held = begin, 0
        for a in range(begin, end + 1):
            while held < least and to <= end:
                held += words[to]
                to += 1
            if held < least:
                break
            out.add((ids[a], to - a))
            held -= words[a]
        at, held = end, 0
        for b in range(end, begin - 1, -1):
            while held < least and at >= begin:
                held += words[at]
                at -= 1
            if held < least:
                break
            out.add((ids[at + 1], b - at))
            held -= words[b]
        begin = end + 1
    return out


def _runs(lines: DataFrame, least: int) -> DataFrame:
    """id, key, s, n of the shortest sufficient runs within each document's repeated lines."""
    one = lines.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("i", "words"))).alias("x")).select("id", "key", "x.i", "x.words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, s, n = [], [], []
            for r, (i, w) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                for first, count in sorted(_needed(i, w, least)):
                    rows.append(r)
                    s.append(first)
                    n.append(count)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(s, pa.int32()), pa.array(n, pa.int32())], ["id", "key", "s", "n"])

    return one.mapInArrow(run, f"id {lines.schema['id'].dataType.simpleString()}, key long, s int, n int")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id, key, runs: for each document with deletions the (s, n) of runs of lines that stand earlier in the corpus.

    The corpus is the sequence of all lines with words, documents in the order of their ids. Rank 2^k of a
    position is the place of its next 2^k lines among all such runs, so the ranks are the suffix array cut at
    2^k lines; rank 2^(k+1) is the place of the pair of ranks at the position and 2^k lines on. Lines and runs
    that come once are dropped at each step, and doubling ends with the longest run that ``min_words`` can ask
    for. A run of n lines is known by two overlapping ranks, and the positions that agree in them are the
    interval of suffixes with a common prefix of n lines: its first position is the original, the others are
    later copies. Overlapping runs join to the maximal ones.
    """
    lines = line_table(docs, id_col, text_col)
    names = ranked(lines, "h1", "h2")
    at = settled(lines.join(names, ["h1", "h2"]).select("id", "key", "i", "words", "rank").dropDuplicates(["id", "key", "i"]), "lines")
    runs = settled(_runs(at, min_words), "runs")
    longest = runs.agg(F.max("n").alias("n")).first()["n"] or 0
    here = at.select("id", "key", F.col("i"), "rank")
    classes = []
    reach = 1
    while reach <= longest:
        wanted = runs.where((F.col("n") >= reach) & (F.col("n") < 2 * reach))
        first = here.select(F.col("id").alias("id_"), F.col("key").alias("key_"), F.col("i").alias("s_"), F.col("rank").alias("a"))
        last = here.select(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("i").alias("_e"), F.col("rank").alias("b"))
        found = wanted.join(first, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("s") == F.col("s_")))
        if reach > 1:
            found = found.join(last, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")) & (F.col("s") + F.col("n") - reach == F.col("_e")))
        else:
            found = found.withColumn("b", F.col("a"))
        classes.append(found.select("id", "key", "s", "n", "a", "b"))
        if 2 * reach <= longest:
            ahead = here.select(F.col("id").alias("id_"), F.col("key").alias("key_"), (F.col("i") - reach).alias("i_"), F.col("rank").alias("then"))
            pairs = settled(here.join(ahead, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("i") == F.col("i_")))
                            .select("id", "key", "i", F.col("rank").alias("now"), "then"), "pairs")
            here = settled(pairs.join(ranked(pairs, "now", "then"), ["now", "then"]).select("id", "key", "i", "rank"), "ranks")
        reach *= 2
    if not classes:
        return runs.select("id", "key", F.array(F.struct("s", "n")).alias("runs")).limit(0)
    known = classes[0]
    for c in classes[1:]:
        known = known.unionByName(c)
    known = settled(known, "runs")
    origin = known.groupBy("n", "a", "b").agg(F.min(F.struct("id", "key", "s")).alias("origin"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    later = known.join(origin, ["n", "a", "b"]).where(~F.struct("id", "key", "s").eqNullSafe(F.col("origin")))
    return later.groupBy("id", "key").agg(F.collect_set(F.struct("s", "n")).alias("runs"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, into: str = "dedup") -> DataFrame:
    """``docs`` with the later copies of repeated runs of lines taken out of ``text_col``, and a struct column
    ``into``: n_lines (lines with words), n_removed.

    A run counts from ``min_words`` words on, whatever its number of lines. Lines without words stay. Order is
    that of the ids (null first), then of a hash of id and text. Rows equal in id and text are one document
    given twice and get the same result. Null texts stay null; an empty table stays empty.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words)
    side = runs.select(F.struct(F.col("id"), F.col("key"), F.col("runs")).alias(r := free_name(docs, "found")))
    key = row_key(F.col(id_col), F.col(text_col))
    kept = docs.withColumn(k := free_name(docs, "key"), key)
    joined = kept.join(side, (F.col(k) == F.col(f"{r}.key")) & F.col(id_col).eqNullSafe(F.col(f"{r}.id")), "left")
    lines, gone, flags = (free_name(joined, x) for x in ("lines", "gone", "flags"))
    joined = joined.withColumn(lines, F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"))
    joined = joined.withColumn(gone, F.coalesce(F.array_distinct(F.flatten(F.transform(f"{r}.runs", lambda x: F.sequence(x["s"], x["s"] + x["n"] - 1)))), F.array().cast("array<int>")))
    joined = joined.withColumn(flags, F.filter(F.transform(F.col(lines), lambda x, i: F.when(x.rlike(WORD), i)), lambda x: x.isNotNull()))
    out = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.transform(F.col(gone), lambda n: F.get(F.col(flags), n)))
    text = F.when(F.size(gone) > 0, F.array_join(F.transform(out, lambda i: F.get(F.col(lines), i)), "\n")).otherwise(F.col(text_col))
    stats = F.struct(F.size(flags).alias("n_lines"), F.size(gone).alias("n_removed")).alias(free_name(docs, into))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns], stats)
