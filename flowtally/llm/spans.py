"""Substring dedup: every run of consecutive sentences is hashed, runs join globally, later copies go."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.llm.common import free_name, row_key

#: Words that a run of sentences holds at least.
MIN_WORDS = 20
#: A sentence goes up to its end marks or line breaks; the pieces make up the whole text.
SENTENCE = regex.compile(r"[^.!?\n]+[.!?\n]*+|[.!?\n]++")


def cut_sentences(text: str) -> tuple[list[str], list[int]]:
    """All pieces of a text, and the numbers of those that hold words."""
    pieces = SENTENCE.findall(text)
    return pieces, [i for i, p in enumerate(pieces) if p.encode().split()]


def span_hashes(text: str, least: int, both_ends: bool = False) -> list[tuple[int, int, bytes]]:
    """(first, count, 128-bit hash) of each run: from every sentence on, the fewest that hold ``least`` words; with
    ``both_ends`` also the fewest up to every sentence, so that each longer run is a union of these.
    Words are compared without case of A-Z and without the white space between them."""
    sizes, sums = [], []
    for piece in SENTENCE.findall(text):
        words = piece.encode().lower().split()
        if words:
            sizes.append(len(words))
            sums.append(xxhash.xxh3_128_digest(b" ".join(words)))
    runs = []
    to = held = 0
    n = len(sizes)
    for a in range(n):
        while held < least and to < n:
            held += sizes[to]
            to += 1
        if held < least:
            break
        runs.append((a, to))
        held -= sizes[a]
    if both_ends:
        known = set(runs)
        at, held = n, 0
        for b in range(n, 0, -1):
            while held < least and at > 0:
                at -= 1
                held += sizes[at]
            if held < least:
                break
            if (at, b) not in known:
                runs.append((at, b))
            held -= sizes[b - 1]
    return [(a, b - a, xxhash.xxh3_128_digest(b"".join(sums[a:b]))) for a, b in runs]


def _span_rows(batches: Iterator[pa.RecordBatch], least: int, both_ends: bool) -> Iterator[pa.RecordBatch]:
    """id, key, s, n, h1, h2, later. Within a batch only the first of equal runs keeps its hash; the others are
    later copies already and go out under a hash of their own place, so that a frequent run is not gathered."""
    for batch in batches:
        row, first, count, digests = [], [], [], []
        for r, value in enumerate(batch.column(2)):
            for s, n, h in span_hashes(value.as_py() or "", least, both_ends):
                row.append(r)
                first.append(s)
                count.append(n)
                digests.append(h)
        at = np.array(row, np.int64)
        s, n = np.array(first, np.int32), np.array(count, np.int32)
        h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2).copy()
        keys = batch.column(1).to_numpy(zero_copy_only=False)
        order_of = pc.rank(batch.column(0), null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((s, keys[at], order_of[at], h[:, 1], h[:, 0]))
        same = np.zeros(len(at), dtype=bool)
        a, b = order[:-1], order[1:]
        same[b] = (h[a] == h[b]).all(1)
        # a repeated row is no copy of itself: the place of the first of equal runs decides
        lead = np.maximum.accumulate(np.where(same[order], -1, np.arange(len(at))))
        origin = np.empty(len(at), np.int64)
        origin[order] = order[lead] if len(at) else order
        later = same & ~((order_of[at] == order_of[at][origin]) & (keys[at] == keys[at][origin]) & (s == s[origin]))
        if later.any():
            place = np.stack([keys[at[later]], s[later].astype(np.int64)], 1)
            h[later] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in place), np.int64).reshape(-1, 2)
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(s), pa.array(n), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(later)],
            ["id", "key", "s", "n", "h1", "h2", "later"])


def later_spans(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, both_ends: bool = False) -> DataFrame:
    """id, key, spans: for each document the (s, n) of its runs of sentences that stand earlier in the corpus."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, key long, s int, n int, h1 long, h2 long, later boolean"
    rows = (docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
            .mapInArrow(lambda batches: _span_rows(batches, min_words, both_ends), schema))
    order = Window.partitionBy("h1", "h2").orderBy("id", "key", "s")
    return (rows.withColumn("place", F.rank().over(order)).where("later OR place > 1")
            .groupBy("id", "key").agg(F.collect_set(F.struct("s", "n")).alias("spans")))


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, both_ends: bool = False) -> DataFrame:
    """id, text (without the sentences that a later copy of a run covers), n_sentences, n_removed; one row a row.

    A run is the fewest consecutive sentences, from each sentence on, that hold ``min_words`` words, so its
    length in sentences follows their length. With ``both_ends`` the fewest up to each sentence count too, which
    also cover the tail of a repeated passage. The first copy is that of the smallest id (null first), then of a
    hash of id and text, then of the first place; all others are later copies, also within one text. Rows equal
    in id and text are one document given twice and get the same result. Null and empty texts give an empty
    text; an empty table stays empty.
    """
    found = later_spans(docs, id_col, text_col, min_words, both_ends).select(F.struct("id", "key", "spans").alias("found"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("key"))
    joined = rows.join(found, (F.col("key") == F.col("found.key")) & F.col("id").eqNullSafe(F.col("found.id")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, gone = [], [], []
            for value, spans in zip(b.column(1), b.column(2)):
                text, spans = value.as_py() or "", spans.as_py() or []
                pieces, worded = cut_sentences(text)
                out = {worded[i] for x in spans for i in range(x["s"], x["s"] + x["n"])}
                texts.append("".join(p for i, p in enumerate(pieces) if i not in out) if out else text)
                sizes.append(len(worded))
                gone.append(len(out))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], [id_col, "text", "n_sentences", "n_removed"])

    return joined.select("id", "text", "found.spans").mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, text string, n_sentences long, n_removed long")
