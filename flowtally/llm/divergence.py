"""Divergence of sources: terms frequent in a language, recounted per source through minimal perfect hashes."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.session import settled

#: Terms of a hash, about; bytes of hashes that are broadcast at once; terms that a task counts before it hands them on.
SHARD_TERMS = 100_000
SENT_BYTES = 64 << 20
HELD_TERMS = 300_000
#: Counters that a task holds before it hands them on, and cells of a matrix of sources and terms.
HELD_SLOTS = 4_000_000
CELLS = 1 << 18
#: Smoothing, parts of one, ranks of the report on terms.
ADDED = 5
ONE = 1_000_000_000
TOP = 50

_TABLE = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of letters A-Z and of everything beyond ASCII, A-Z lower-cased, in a UTF-8 text."""
    return text.translate(_TABLE).split()


# a minimal perfect hash ----------------------------------------------------------------------------------------------


def _mixed(lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """64 bits of the two halves of a key's hash, another mix at each level."""
    x = lo ^ (hi * np.uint64((0x9E3779B97F4A7C15 * (2 * level + 1)) & (1 << 64) - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").reshape(-1, 2).astype(np.uint64)
    return raw[:, 0], raw[:, 1]


class PerfectHash:
    """Gives each of n keys a slot of its own in 0..n-1, and -1 to any other key.

    Levels of bits, two for each key left: keys alone on their bit take it, the others go to the next level; a slot
    is the number of bits set before. The keys lie in the order of their slots, and a key is compared with the one
    stored at its slot. Keys that no level parts stand in a small table behind the others.
    """

    LEVELS = 48

    def __init__(self, keys: list[bytes]):
        lo, hi = key_hashes(keys)
        left, levels, slots, used = np.arange(len(keys)), [], np.full(len(keys), -1, np.int64), 0
        for level in range(self.LEVELS):
            if not len(left):
                break
            size = max(64, 2 * len(left))
            at = (_mixed(lo[left], hi[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(np.pad(alone, (0, -size % 64)), bitorder="little").view("<u8")
            before = used + np.concatenate([[0], np.cumsum(np.bitwise_count(words))])
            levels.append((size, words, before))
            mine = alone[at]
            slots[left[mine]] = self._slot(levels[-1], at[mine])
            used, left = int(before[-1]), left[~mine]
        self.levels = levels
        self.rest = {keys[i]: used + k for k, i in enumerate(left.tolist())}
        for i in left.tolist():
            slots[i] = self.rest[keys[i]]
        order = np.argsort(slots)
        stored = [keys[i] for i in order.tolist()]
        self.ends = np.concatenate([[0], np.cumsum([len(k) for k in stored], dtype=np.int64)])
        self.blob = b"".join(stored)

    def __len__(self) -> int:
        return len(self.ends) - 1

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> PerfectHash:
        made = cls.__new__(cls)
        vars(made).update(pickle.loads(data))
        return made

    @staticmethod
    def _slot(level: tuple, at: np.ndarray) -> np.ndarray:
        _, words, before = level
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def key(self, slot: int) -> bytes:
        return self.blob[self.ends[slot]:self.ends[slot + 1]]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Slots of the keys; -1 for one that is not stored."""
        lo, hi = key_hashes(keys) if keys else (np.zeros(0, np.uint64),) * 2
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for number, level in enumerate(self.levels):
            at = (_mixed(lo[left], hi[left], number) % np.uint64(level[0])).astype(np.int64)
            hit = (level[1][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[left[hit]] = self._slot(level, at[hit])
            left = left[~hit]
        for i in left.tolist():
            out[i] = self.rest.get(keys[i], -1)
        blob, ends = self.blob, self.ends.tolist()
        return np.array([s if s >= 0 and blob[ends[s]:ends[s + 1]] == k else -1 for s, k in zip(out.tolist(), keys)], np.int64)


# the audit -----------------------------------------------------------------------------------------------------------


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def frequent_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, term of the terms in at least ``least`` documents of the language, counted exactly: a task adds up what
    its documents hold and hands on sums, at most ``HELD_TERMS`` terms at a time."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        n = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = held.setdefault(lang, Counter())
                n -= len(counts)
                counts.update(set(terms(text.as_buffer().to_pybytes())))
                n += len(counts)
                if n > HELD_TERMS:
                    yield from flushed(held)
                    held, n = {}, 0
        yield from flushed(held)

    def flushed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            names, sums = pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())
            for i in range(0, len(names), 50_000):
                part = names.slice(i, 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, sums.slice(i, 50_000)], ["lang", "term", "n"])

    counted = _plain(docs).select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")


def perfect_hashes(vocabulary: DataFrame) -> DataFrame:
    """lang, shard, n, size, hash of the terms, dealt by a hash of the term to shards of about ``SHARD_TERMS``."""
    vocabulary = settled(vocabulary, "vocabulary")
    sizes = vocabulary.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / SHARD_TERMS).cast("long").alias("shards"))
    dealt = vocabulary.join(sizes, "lang").withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")))

    def build(key, table):
        lang, shard, shards = (k.as_py() for k in key)
        made = PerfectHash([t.encode() for t in sorted(table.column("term").to_pylist())])
        data = made.packed()
        return pa.table({"lang": [lang], "shard": pa.array([shard], pa.int64()), "shards": pa.array([shards], pa.int64()), "n": pa.array([len(made)], pa.int64()),
                         "size": pa.array([len(data)], pa.int64()), "hash": pa.array([data], pa.binary())})

    return settled(dealt.groupBy("lang", "shard", "shards").applyInArrow(build, "lang string, shard long, shards long, n long, size long, hash binary"), "hashes")


def recount(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """lang, source, shard, slot, n (above 0): how often each stored term comes in each (lang, source).

    Hashes are broadcast together up to ``SENT_BYTES``; more of them take further passes over the documents. A task
    has one row of counters per group and hash, and hands them on when it holds ``HELD_SLOTS`` of them.
    """
    spark, plain = docs.sparkSession, _plain(docs)
    listed = sorted((r.lang, r.shard, r.size) for r in hashes.select("lang", "shard", "size").toLocalIterator())  # a row per 100,000 terms
    passes, held = [[]], 0
    for lang, shard, size in listed:
        if passes[-1] and held + size > SENT_BYTES:
            passes.append([])
            held = 0
        passes[-1].append((lang, shard))
        held += size
    out = None
    for wanted in passes:
        first, last = (wanted[0], wanted[-1]) if wanted else (("", -1), ("", -1))
        here = hashes.where((F.struct("lang", "shard") >= F.struct(F.lit(first[0]), F.lit(first[1]).cast("long"))) & (F.struct("lang", "shard") <= F.struct(F.lit(last[0]), F.lit(last[1]).cast("long"))))
        found: dict[str, dict[int, bytes]] = {}
        for r in here.select("lang", "shard", "hash").collect():  # at most SENT_BYTES, or one hash
            found.setdefault(r.lang, {})[r.shard] = bytes(r.hash)
        sent = spark.sparkContext.broadcast(found)
        part = plain.where(F.col("lang").isin(sorted(found))).mapInArrow(_counter(sent), "lang string, source string, shard long, slot long, n long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("lang", "source", "shard", "slot").agg(F.sum("n").alias("n"))


def _counter(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = {lang: {shard: PerfectHash.unpacked(data) for shard, data in found.items()} for lang, found in sent.value.items()}
        slots: dict[tuple[str, str, int], np.ndarray] = {}
        n = 0
        for batch in batches:
            seen: dict[tuple[str, str], Counter] = {}
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                seen.setdefault((lang, source), Counter()).update(terms(text.as_buffer().to_pybytes()))
            for (lang, source), counts in seen.items():
                keys, sums = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                for shard, made in hashes[lang].items():
                    at = made.find(keys)
                    row = slots.get((lang, source, shard))
                    if row is None:
                        row = slots[lang, source, shard] = np.zeros(len(made), np.int64)
                        n += len(made)
                    row[at[at >= 0]] += sums[at >= 0]  # a slot comes once: keys are distinct
                if n > HELD_SLOTS:
                    yield from flushed(slots)
                    slots, n = {}, 0
        yield from flushed(slots)

    def flushed(slots) -> Iterator[pa.RecordBatch]:
        for (lang, source, shard), row in slots.items():
            for i in range(0, len(row), 50_000):
                at = i + np.flatnonzero(row[i:i + 50_000])
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(np.full(len(at), shard)), pa.array(at), pa.array(row[at])],
                                                     ["lang", "source", "shard", "slot", "n"])
    return count


def _share(n: str, total: str, v: str) -> str:
    """1 + floor(10^9 (n + 5) / (total + 5 v)), in whole numbers of any size."""
    return f"1 + (CAST({ONE} AS DECIMAL(20,0)) * CAST({n} + {ADDED} AS DECIMAL(18,0))) div CAST({total} + {ADDED} * {v} AS DECIMAL(20,0))"


def _distances(width: int):
    """Per (lang, shard, chunk): sums of differences between each two sources over the chunk's terms."""
    def run(key, table):
        lang, _, chunk = (k.as_py() for k in key)
        every = table.column("slot").is_null()  # what a source has of any term here; the others replace it
        rows, found = table.filter(every).sort_by("source"), table.filter(pc.invert(every))
        names = rows.column("source").to_pylist()
        shares = np.repeat(rows.column("p").to_numpy()[:, None], rows.column("terms")[0].as_py(), axis=1)
        at = pc.index_in(found.column("source"), value_set=pa.array(names, pa.string())).to_numpy()
        shares[at, found.column("slot").to_numpy() - chunk * width] = found.column("p").to_numpy()
        parts = []
        for i in range(len(names) - 1):
            parts.append(np.abs(shares[i + 1:] - shares[i]).sum(axis=1))
        a = [names[i] for i in range(len(names)) for _ in range(i + 1, len(names))]
        b = [name for i in range(len(names)) for name in names[i + 1:]]
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
                         "value": pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())})
    return run


def audit_sources(docs: DataFrame, least: int = 30) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the summed differences of term shares between a source and
    each other one of the language, all ranks. Part ``term``: the terms that a source has more of than the language
    as a whole, the 50 with the largest difference. Null columns count as empty; rows count as often as they come;
    a source without terms, and a language without frequent ones, give their pairs. No rows give none.

    The report on pairs has a row for each two sources of a language, which is what is asked for; their shares meet in
    blocks of terms with about 262,144 cells. Everything else is in step with the text.
    """
    hashes = perfect_hashes(frequent_terms(docs, least))
    counts = settled(recount(docs, hashes), "counts")
    occurring = settled(_plain(docs).groupBy("lang", "source").agg(F.lit(1).alias("one")), "groups")
    kept = hashes.groupBy("lang").agg(F.sum("n").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = settled(occurring.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v")), "groups")

    most = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 1
    width = max(1, CELLS // most)
    pieces = hashes.select("lang", "shard", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {width}"))).alias("chunk"))
    blank = (pieces.join(groups.where("v > 0"), "lang")
             .select("lang", "shard", "chunk", "source", F.lit(None).cast("long").alias("slot"), F.expr(_share("0L", "total", "v")).alias("p"), F.least(F.lit(width), F.col("n") - F.col("chunk") * width).alias("terms")))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", F.expr(_share("n", "total", "v")))
    filled = shares.select("lang", "shard", F.expr(f"slot div {width}").alias("chunk"), "source", "slot", "p", F.lit(0).cast("long").alias("terms"))
    half = blank.unionByName(filled).groupBy("lang", "shard", "chunk").applyInArrow(_distances(width), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    none = groups.where("v = 0").select("lang", "source")
    zero = none.join(none.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    both = (half.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
            .unionByName(half.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")).unionByName(zero))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    whole = counts.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n_all"))
    sums = groups.groupBy("lang").agg(F.sum("total").alias("total_all"), F.first("v").alias("v_all"))
    expected = whole.join(sums, "lang").select("lang", "shard", "slot", F.expr(_share("n_all", "total_all", "v_all")).alias("q")).join(_names(hashes), ["lang", "shard", "slot"])
    more = (shares.join(expected, ["lang", "shard", "slot"]).where("p > q")
            .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")))
    top = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.unionByName(top).withColumn("rank", F.col("rank").cast("int"))


def _names(hashes: DataFrame) -> DataFrame:
    """lang, shard, slot, term of every stored term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, shard, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                made = PerfectHash.unpacked(data)
                for i in range(0, len(made), 50_000):
                    at = range(i, min(i + 50_000, len(made)))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([shard] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([made.key(s).decode() for s in at], pa.string())],
                                                     ["lang", "shard", "slot", "term"])

    return hashes.select("lang", "shard", "hash").mapInArrow(run, "lang string, shard long, slot long, term string")
