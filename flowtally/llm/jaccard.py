"""N-gram Jaccard join: sets of word shingles, partition signatures within bands of size, exact checks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtally.llm.common import free_name, row_key
from flowtally.llm.components import components
from flowtally.session import settled

WORDS = 5
#: Least similarity as a ratio of whole numbers.
LEAST = (3, 4)
#: Sets below this size sign single shingles; bands above are four times as wide as the one before.
SMALL = 24
BAND = 4
#: Partitions for each element of the largest set of a band.
SHARE = 2 / 3
#: A shingle in more than this share of a batch's sets counts as common. It changes the order, never the links.
COMMON = 0.001
#: Signatures that one task groups at once, on average.
GROUP_ROWS = 500_000
#: Words and sets that a worker remembers, and rows that it takes at once.
MEMORY = 100_000
ROWS = 4_000
SET_ROWS = 400
#: Sets up to this number are named to every task (16 bytes each); more are joined by a shuffle of the texts.
NAMED = 500_000
#: Bits of a sketch that are folded into one of its brief forms: for pairs of stars, which whole sketches are asked about next, and
#: for the groups of parts, whose near pairs are counted and should be few (a quarter lets pairs through from 0.65 on, half from 0.71).
FOLD = 4
FOLD_OF_PARTS = 2
#: Bytes of sketches that one comparison of a group goes through at once.
TILE_BYTES = 1 << 24
#: Near pairs of a part's groups that are handed on to be tested at once: this many, or this share of its sets. Where there
#: are more, those that would join components go first; what these leave apart is gone through again, with WIDER times as many.
MANY_PAIRS = (64, 0.125)
WIDER = 8
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
STEPS = ODD * np.arange(1, len(ODD) + 1, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < MEMORY:
            self[word] = h
        return h


def shingle_set(text: str | None, seen: dict, size: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``size`` words, A-Z lower-cased; a shorter text is one run."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, n)
    total = np.zeros(n - size + 1, np.uint64)
    for j in range(size):
        total += mixed(h[j:n - size + 1 + j] + STEPS[j % len(ODD)]) * ODD[j % len(ODD)]
    return np.unique(mixed(total))


def set_name(shingles: np.ndarray) -> int:
    """Names a set by 64 bits of its content."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def band_of(size: int) -> int:
    band, end = 0, SMALL
    while size >= end:
        band, end = band + 1, end * BAND
    return band


def band_partitions(band: int, finer: dict[int, int]) -> int:
    """Partitions of a band, a power of two."""
    most = SMALL * BAND ** band
    return (1 << int(np.ceil(np.log2(SHARE * most)))) << finer.get(band, 0)


def bands_for(size: int) -> list[int]:
    """A pair meets in the band of its larger set: a set signs for its own band and for that of the largest
    set that can be similar to it."""
    return sorted({band_of(size), band_of(size * LEAST[1] // LEAST[0])})


def most_apart(size: int) -> int:
    """How many elements a set of this size and a similar set differ in at most, on both sides together."""
    num, den = LEAST
    other = size * den // num
    return (size + other) * (den - num) // (den + num)


def finer_needed(shingles: np.ndarray, band: int) -> int:
    """Doublings of the band's partitions until more of them hold elements than may differ."""
    k, f = most_apart(len(shingles)), 0
    while band and len(np.unique(shingles >> np.uint64(64 - int(np.log2(band_partitions(band, {band: f})))))) <= k:
        f += 1
    return f


def signatures(shingles: np.ndarray, common: np.ndarray, finer: dict[int, int]) -> np.ndarray:
    """The signatures of a set.

    The domain of shingles is cut into n parts, by the leading bits of the hashes. Similar sets differ in at
    most k elements, so in at most k parts; ordered alike, each one's first k + 1 filled parts hold one that
    agrees in all elements. Parts with a shingle that is not common come first. Small sets have parts of one
    shingle each.
    """
    s = len(shingles)
    if not s:
        return np.zeros(0, np.uint64)
    k = most_apart(s)
    usual = np.isin(shingles, common, assume_unique=True) if len(common) else np.zeros(s, bool)
    out = []
    for band in bands_for(s):
        if band == 0:
            sums, ordinary, place = mixed(shingles), usual, None
        else:
            bits = int(np.log2(band_partitions(band, finer)))
            part = shingles >> np.uint64(64 - bits)
            starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            sums = np.add.reduceat(mixed(shingles ^ ODD[1]), starts)
            ordinary = np.logical_and.reduceat(usual, starts)
            place = part[starts]
        order = np.concatenate([np.flatnonzero(~ordinary), np.flatnonzero(ordinary)])[:k + 1]
        tag = np.uint64(xxhash.xxh3_64_intdigest(str(band).encode()))
        out.append(mixed(sums[order] + tag + (place[order] * ODD[2] if place is not None else np.uint64(0))))
    return np.concatenate(out)


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _sets(batch: pa.RecordBatch, column: int, seen: dict) -> list[np.ndarray]:
    return [shingle_set(v.as_py(), seen) for v in batch.column(column)]


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (id, key, n, name), then rows for shingles common in the batch (n null, key the
    count, name the shingle) and for bands that need more partitions (n = -1 - band, name = doublings)."""
    seen = _Hashes()
    names = ["id", "key", "n", "name"]
    for batch in _pieces(batches, ROWS):
        sets = _sets(batch, 2, seen)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_name(s) for s in sets], pa.int64())], names)
        distinct = {set_name(s): s for s in sets if len(s)}
        extra_key, extra_n, extra_name = [], [], []
        if len(distinct) >= 20:
            values, counts = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
            often = counts >= max(4, COMMON * len(distinct))
            for v, c in zip(values[often], counts[often]):
                extra_key.append(int(c))
                extra_n.append(None)
                extra_name.append(int(v) - (1 << 63))
        for s in distinct.values():
            for band in bands_for(len(s)):
                if f := finer_needed(s, band):
                    extra_key.append(None)
                    extra_n.append(-1 - band)
                    extra_name.append(f)
        if extra_n:
            none = pa.nulls(len(extra_n), batch.column(0).type)
            yield pa.RecordBatch.from_arrays([none, pa.array(extra_key, pa.int64()), pa.array(extra_n, pa.int64()), pa.array(extra_name, pa.int64())], names)


def _signed(batches: Iterator[pa.RecordBatch], common: np.ndarray, finer: dict[int, int], parts: int) -> Iterator[pa.RecordBatch]:
    """part, sigs, names: the signatures of a batch's distinct sets as packed numbers, dealt out by signature."""
    seen, done = _Hashes(), set()
    for batch in _pieces(batches, ROWS):
        sigs, names = [], []
        for s in _sets(batch, 0, seen):
            name = set_name(s)
            if not len(s) or name in done:
                continue
            if len(done) >= MEMORY:
                done.clear()
            done.add(name)
            own = signatures(s, common, finer)
            sigs.append(own)
            names.append(np.full(len(own), name, np.int64))
        if not sigs:
            continue
        sig, name = np.concatenate(sigs), np.concatenate(names)
        part = (sig % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sig, name, part = sig[order], name[order], part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(starts[1:], len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[starts]), pa.array([sig[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([name[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
            ["part", "sigs", "names"])


def _grouped(table: pa.Table) -> pa.Table:
    """Rows (kind, a, b) of one part: kind 0 links each group's first set to the others; kind 1 lists the members b of groups a of three sets or more, groups with equal members once."""
    sig = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["sigs"]])
    name = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["names"]])
    order = np.lexsort((name, sig))
    sig, name = sig[order], name[order]
    fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])])
    sig, name = sig[fresh], name[fresh]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    sizes = np.diff(np.append(starts, len(sig)))
    many = sizes > 1
    starts, sizes = starts[many], sizes[many]
    rows = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    member, first = name[rows], np.repeat(name[starts], sizes)
    links = member != first
    pairs = np.unique(np.stack([first[links], member[links]], 1), axis=0)
    held: dict[int, np.ndarray] = {}
    for a, n in zip(starts, sizes):
        if n > 2:
            own = name[a:a + n]
            held.setdefault(set_name(own.view(np.uint64)), own)
    groups = np.concatenate([np.full(len(v), g, np.int64) for g, v in held.items()] or [np.zeros(0, np.int64)])
    members = np.concatenate(list(held.values()) or [np.zeros(0, np.int64)])
    return pa.table({
        "kind": pa.array(np.concatenate([np.zeros(len(pairs), np.int32), np.ones(len(groups), np.int32)])),
        "a": pa.array(np.concatenate([pairs[:, 0], groups])), "b": pa.array(np.concatenate([pairs[:, 1], members]))})


def sketch(shingles: np.ndarray) -> bytes:
    """One bit of parity for each of four to eight times as many hash classes as there are elements: two sets
    differ in at least as many elements as their bits do, and in hardly more if they are similar."""
    bits = max(256, 4 << int(np.ceil(np.log2(max(1, len(shingles))))))
    count = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(count.astype(np.uint8)).tobytes()


def may_match(n: int, m: int, x: bytes, y: bytes) -> bool:
    """False only if two sets of these sizes and sketches can't be similar."""
    num, den = LEAST
    if n * den < m * num or m * den < n * num:
        return False
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) > len(q):
        p, q = q, p
    if len(q) > len(p):  # fold the longer one: its classes are parts of the shorter one's
        q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0)
    return int(np.bitwise_count(p ^ q).sum()) * (num + den) <= (n + m) * (den - num)


def matches(x: np.ndarray, y: np.ndarray) -> bool:
    num, den = LEAST
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Hashes()
    for batch in _pieces(batches, SET_ROWS):
        sets = _sets(batch, 1, seen)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], ["name", "n", "sketch"])


def brief(sketch: bytes, fold: int = FOLD) -> bytes:
    """A sketch of fewer hash classes: what it tells apart differs, but it keeps similar sets together as the whole one does."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint8).reshape(fold, -1), axis=0).tobytes()


def _briefed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, ROWS):
        forms = [pa.array([brief(x, fold) for x in batch.column(2).to_pylist()], pa.binary()) for fold in (FOLD, FOLD_OF_PARTS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *forms], ["name", "n", "brief", "half"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Hashes()
    for batch in _pieces(batches, SET_ROWS):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in _sets(batch, 1, seen)], pa.binary())], ["name", "shingles"])


class _Corpus:
    """What is known of the sets: their names, and for each the key of one text that holds it."""

    def __init__(self, texts: DataFrame, profile: DataFrame):
        self.texts = texts
        self.names = profile.where("n > 0").select("name", "key")

    def of(self, wanted: DataFrame, what, schema: str) -> DataFrame:
        """``what`` of the wanted sets (column name), one row for each, from their texts."""
        holders = settled(self.names.join(wanted, "name", "left_semi").groupBy("name").agg(F.min("key").alias("key")), "holders")
        side = F.broadcast(holders) if holders.count() <= NAMED else holders
        return settled(self.texts.join(side, "key").select("name", "text").mapInArrow(what, schema).dropDuplicates(["name"]), "sets")


def _kept(batches: Iterator[pa.RecordBatch], test) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, SET_ROWS):
        keep = [test(row) for row in zip(*(c.to_pylist() for c in batch.columns[2:]))]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _side(table: DataFrame, x: str, *cols: str) -> DataFrame:
    return table.select(F.col("name").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cols])


def _close(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and sketches (whole or brief) allow."""
    near = (pairs.join(_side(sketches, "a", "n", "sketch"), "a").join(_side(sketches, "b", "n", "sketch"), "b").where(f"{LEAST[1]} * n_a >= {LEAST[0]} * n_b AND {LEAST[1]} * n_b >= {LEAST[0]} * n_a")
            .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
            .mapInArrow(partial(_kept, test=lambda r: may_match(*r)), "a long, b long"))
    return settled(near, "pairs")


def _linked(pairs: DataFrame, sketches: DataFrame, corpus: _Corpus) -> DataFrame:
    """The pairs (a, b) that are similar: bounds on sizes and whole sketches first, then the sets themselves. Only what the
    pairs name is moved: ``pairs`` should be stored, and few by brief sketches."""
    wanted = settled(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "wanted")
    near = _close(pairs, sketches.join(F.broadcast(wanted) if wanted.count() <= NAMED else wanted, "name", "left_semi"))
    sets = corpus.of(near.select(F.explode(F.array("a", "b")).alias("name")).distinct(), _spelled, "name long, shingles binary")
    full = near.join(_side(sets, "a", "shingles"), "a").join(_side(sets, "b", "shingles"), "b").select("a", "b", "shingles_a", "shingles_b")
    return settled(full.mapInArrow(partial(_kept, test=lambda r: matches(np.frombuffer(r[0], np.uint64), np.frombuffer(r[1], np.uint64))), "a long, b long"), "links")


def _near_pairs(names: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketches: list[bytes]) -> Iterator[np.ndarray]:
    """Pairs of a group's sets that lie in different components and that sizes and sketches allow. Only what
    passes is kept; the tests themselves run on whole tiles."""
    num, den = LEAST
    widths = np.array([len(x) for x in sketches])
    packed = {int(w): np.frombuffer(b"".join(sketches[i] for i in np.flatnonzero(widths == w)), np.uint64).reshape(-1, w // 8) for w in np.unique(widths)}
    at = {w: np.flatnonzero(widths == w) for w in packed}
    for v in sorted(packed):
        for w in (x for x in sorted(packed) if x >= v):
            short, long = packed[v], packed[w]
            if w > v:
                long = np.bitwise_xor.reduce(long.reshape(len(long), -1, v // 8), axis=1)
            i, j = at[v], at[w]
            step = max(1, TILE_BYTES // (len(j) * v))
            for lo in range(0, len(i), step):
                a = i[lo:lo + step]
                apart = np.bitwise_count(short[lo:lo + step, None, :] ^ long[None, :, :]).sum(axis=2, dtype=np.int64)
                n, m = sizes[a][:, None], sizes[j][None, :]
                fits = (apart * (num + den) <= (n + m) * (den - num)) & (n * den >= m * num) & (m * den >= n * num) & (labels[a][:, None] != labels[j][None, :])
                if v == w:
                    fits &= a[:, None] < j[None, :]
                x, y = np.nonzero(fits)
                if len(x):
                    yield np.stack([names[a[x]], names[j[y]]], 1)


def _groups_of(members: pa.Table, sets: pa.Table) -> tuple[pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """A part's sets in the order of their names, and for each group the places of its members there and their labels."""
    sets = sets.sort_by("name")
    order = np.argsort(members["g"].to_numpy(), kind="stable")
    group, label = members["g"].to_numpy()[order], members["label"].to_numpy()[order]
    at = np.searchsorted(sets["name"].to_numpy(), members["node"].to_numpy()[order])
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
    return sets, ((at[a:b], label[a:b]) for a, b in zip(starts, np.append(starts[1:], len(group))))


def _crossed(key: tuple, members: pa.Table, sets: pa.Table, most: int | None = None) -> pa.Table:
    """The pairs of :func:`_near_pairs` for all groups of one part; where they are many for its sets, only its number."""
    sets, groups = _groups_of(members, sets)
    name, size, sketches = sets["name"].to_numpy(), sets["n"].to_numpy(), sets["sketch"].to_pylist()
    most = max(MANY_PAIRS[0], int(MANY_PAIRS[1] * len(name))) if most is None else most
    pairs, seen = np.zeros((0, 2), np.int64), 0
    for at, label in groups:
        for more in _near_pairs(name[at], label, size[at], [sketches[i] for i in at]):
            pairs = np.concatenate([pairs, np.sort(more, axis=1)])
            if len(pairs) > max(most, 2 * seen):
                pairs = np.unique(pairs, axis=0)
                seen = len(pairs)
                if seen > most:
                    return pa.table({"a": pa.nulls(1, pa.int64()), "b": pa.nulls(1, pa.int64()), "part": pa.array([key[0].as_py()], pa.int64())})
    pairs = np.unique(pairs, axis=0)
    return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "part": pa.nulls(len(pairs), pa.int64())})


def _joined(members: pa.Table, sets: pa.Table) -> pa.Table:
    """Near pairs (a, b) that would join all components of one part's groups that near pairs may join, each of them with
    another one by one pair: fewer rows than sets. They are still to be tested."""
    sets, groups = _groups_of(members, sets)
    name, size, sketches = sets["name"].to_numpy(), sets["n"].to_numpy(), sets["sketch"].to_pylist()
    above: dict[int, int] = {}
    links = []

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = x = above.get(up, up)
        return x

    for at, label in groups:
        own = dict(zip(name[at].tolist(), label.tolist()))
        for more in _near_pairs(name[at], label, size[at], [sketches[i] for i in at]):
            for x, y in np.sort(more, axis=1).tolist():
                p, q = root(own[x]), root(own[y])
                if p != q:
                    above[p] = q
                    links.append((x, y))
    found = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})


def _sifted(key: tuple, members: pa.Table, sets: pa.Table, wider: int) -> pa.Table:
    """A part's near pairs while they are few; else those that join, and its number. ``wider``: times that it was told before."""
    most = None if not wider else WIDER ** wider * max(MANY_PAIRS[0], sets.num_rows)
    pairs = _crossed(key, members, sets, most)
    if pairs["part"].null_count == len(pairs):
        return pairs
    joins = _joined(members, sets)
    return pa.concat_tables([pairs, joins.append_column("part", pa.nulls(len(joins), pa.int64()))])


def _sifter(wider: int):
    def task(key: tuple, members: pa.Table, sets: pa.Table) -> pa.Table:
        return _sifted(key, members, sets, wider)
    return task


def _of_several(member: DataFrame) -> DataFrame:
    """The groups whose sets lie in several components: their number of members and least set."""
    return (member.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"), F.min("node").alias("first"))
            .where("lo <> hi").select("g", "m", "first"))


def set_components(spark: SparkSession, texts: DataFrame, profile: DataFrame) -> DataFrame:
    """node, label of every set with a similar other set. ``texts``: key, text; ``profile``: what :func:`_profile` gives.

    Candidates are the groups of sets with one signature. Links within a component add nothing, so each group
    is first tested as a star around one set. A group that still holds several components is then gone through
    with sizes and sketches, across components only; what these allow is tested, so no link is lost. Pairs and
    groups are many and most of them far apart, so they meet brief sketches, and only what these allow whole ones.
    """
    total = profile.where("n > 0").agg(F.sum("n").alias("n"), F.count("*").alias("sets")).first()
    size = total["n"] or 0
    # of shingles in COMMON / 2 of all sets there are at most the mean size of a set times 2 / COMMON
    often = profile.where("n IS NULL").groupBy("name").agg(F.sum("key").alias("sets")).where(F.col("sets") >= COMMON / 2 * total["sets"])
    common = np.sort(often.select("name").toArrow()["name"].to_numpy().astype(np.int64).view(np.uint64) + np.uint64(1 << 63))
    finer = {-1 - r["n"]: r["f"] for r in profile.where("n < 0").groupBy("n").agg(F.max("name").alias("f")).collect()}
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, int(0.5 * size // GROUP_ROWS) + 1)
    sent = spark.sparkContext.broadcast((common, finer))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _signed(batches, *sent.value, parts)

    found = settled(texts.select("text").mapInArrow(signed, "part long, sigs binary, names binary").groupBy("part").applyInArrow(_grouped, "kind int, a long, b long"), "groups")
    stars = settled(found.where("kind = 0").select("a", "b").distinct(), "pairs")

    corpus = _Corpus(texts, profile)
    sketches = corpus.of(stars.select(F.explode(F.array("a", "b")).alias("name")).distinct(), _sketched, "name long, n long, sketch binary")
    briefs = settled(sketches.mapInArrow(_briefed, "name long, n long, brief binary, half binary"), "briefs")
    labels = settled(components(_linked(_close(stars, briefs.select("name", "n", F.col("brief").alias("sketch"))), sketches, corpus)), "labels")

    groups = found.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("node")).distinct()
    member = settled(groups.join(labels, "node", "left").select("g", "node", F.coalesce("label", "node").alias("label")), "groups")
    several = settled(_of_several(member), "groups")
    rows = several.agg(F.sum("m")).first()[0] or 0
    if not rows:
        return labels
    # groups with one first set tend to hold the same pairs: they go to eight parts at most, which give a pair once each
    part = F.pmod(F.xxhash64("first", F.pmod("g", F.lit(8))), F.lit(max(least, rows // (GROUP_ROWS // 16) + 1)))
    dealt = settled(member.join(several.select("g", "first"), "g").select(part.alias("part"), "g", "node", "label"), "dealt")

    tested, wider = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), 0
    while True:
        # a set's brief sketch goes to a part once, however many groups name it
        named = dealt.select(F.col("part").alias("for_part"), F.col("node").alias("name")).distinct().join(briefs.select("name", "n", F.col("half").alias("sketch")), "name")
        crossed = settled(dealt.groupBy("part").cogroup(named.groupBy("for_part")).applyInArrow(_sifter(wider), "a long, b long, part long"), "pairs")
        fresh = settled(crossed.where("part IS NULL").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
        links = _linked(fresh, sketches, corpus)
        if not links.isEmpty():
            labels = settled(components(links, labels), "labels")
        many = crossed.where("part IS NOT NULL").select("part")
        if many.isEmpty():
            return labels
        # what the joining pairs left apart: tested pairs that fail keep their components apart, so more are told each time
        again = dealt.join(many, "part", "left_semi").drop("label").join(labels, "node", "left").select("part", "g", "node", F.coalesce("label", "node").alias("label"))
        again = settled(again, "dealt")
        dealt = settled(again.join(_of_several(again).select("g"), "g", "left_semi"), "dealt")
        if dealt.isEmpty():
            return labels
        tested, wider = tested.unionByName(fresh), wider + 1


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, n_shingles, component_id of every row, where documents link whose sets of five-word shingles have
    a Jaccard similarity of 3/4 or more; component_id is the smallest id that links reach.

    Texts with fewer than five words are one shingle; null and wordless texts have none and link with nothing.
    Rows equal in id and text are told apart by nothing and get the same result; null ids never name a
    component while it has another id. An empty table gives an empty result. Shingles and sets are compared by
    64-bit hashes.
    """
    texts = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    profile = settled(texts.mapInArrow(_profile, f"id {kind}, key long, n long, name long"), "profile")
    rows = profile.where("n >= 0")
    labels = set_components(docs.sparkSession, texts.select("key", "text"), profile)
    named = rows.join(labels.withColumnRenamed("node", "name"), "name", "left").select("id", "key", "n", F.coalesce("label", "name").alias("label"))
    named = settled(named, "named")
    lowest = named.where("n > 0").groupBy("label").agg(F.min("id").alias("lowest"))
    return (named.where("n > 0").join(lowest, "label").select("id", "key", F.col("n").alias("n_shingles"), F.col("lowest").alias("component_id"))
            .unionByName(named.where("n = 0").select("id", "key", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of similar documents, columns as they are: the one with the smallest id (then the
    smallest hash of id and text, once if it is repeated). Documents without words link with nothing and stay."""
    found = near_components(docs, id_col, text_col)
    firsts = (found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first"))
              .select(F.struct("first.id", "first.key").alias(c := free_name(docs, "first"))))
    empty = found.where("n_shingles = 0").select(F.struct("id", "key").alias(c)).distinct()
    keyed = docs.withColumn(k := free_name(docs, "key"), row_key(F.col(id_col), F.col(text_col)))
    kept = keyed.join(firsts, (F.col(k) == F.col(f"{c}.key")) & F.col(id_col).eqNullSafe(F.col(f"{c}.id")), "left_semi")
    once = kept.dropDuplicates([k])
    return once.unionByName(keyed.join(empty, (F.col(k) == F.col(f"{c}.key")) & F.col(id_col).eqNullSafe(F.col(f"{c}.id")), "left_semi")).drop(k)
