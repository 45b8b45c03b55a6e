"""A Merkle tree over a table, source by source: aligned subtrees stored in van Emde Boas order, proofs and checks from them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.operators.ranged import places
from flowtally.session import settled

#: Children of a node, as a power of two, and levels above the leaves of a stored subtree.
BITS = 4
FANOUT = 1 << BITS
HEIGHT = 3
#: Digits of a digest in hex.
HEX = 64


# layout of one aligned subtree ---------------------------------------------------------------------------------------


def n_nodes(height: int, n: int) -> int:
    """Nodes of a tree of ``n`` leaves and ``height`` levels above them; the last run of each level may be short."""
    return sum(-(-n // (1 << BITS * level)) for level in range(height + 1))


def _halves(height: int) -> tuple[int, int]:
    """Heights of the lower trees and of the upper one when the levels are split in half."""
    low = (height + 1) // 2 - 1
    return low, height - low - 1


def address(height: int, n: int, level: int, index: int) -> int:
    """Where a node lies in van Emde Boas order: the upper half of the levels as one tree, then the trees of the
    lower half from left to right, each laid out likewise. Only the last tree of a row can be short, so places are
    multiples of one size."""
    if height == 0:
        return 0
    low, top = _halves(height)
    above = -(-n // (1 << BITS * (low + 1)))
    if level > low:
        return address(top, above, level - low - 1, index)
    span = 1 << BITS * low
    tree = index >> BITS * (low - level)
    return n_nodes(top, above) + tree * n_nodes(low, span) + address(low, min(span, n - tree * span), level, index - (tree << BITS * (low - level)))


#: Layouts that a worker remembers.
_KNOWN: dict[tuple[int, int], list[np.ndarray]] = {}


def addresses(height: int, n: int) -> list[np.ndarray]:
    """``address`` of all nodes, level by level."""
    if (height, n) not in _KNOWN:
        if len(_KNOWN) >= 256:
            _KNOWN.clear()
        _KNOWN[height, n] = _addresses(height, n)
    return _KNOWN[height, n]


def _addresses(height: int, n: int) -> list[np.ndarray]:
    if height == 0:
        return [np.zeros(1, np.int64)]
    low, top = _halves(height)
    above, span = -(-n // (1 << BITS * (low + 1))), 1 << BITS * low
    start, size, trees = n_nodes(top, above), n_nodes(low, span), -(-n // span)
    full, last = addresses(low, span), addresses(low, n - (trees - 1) * span)
    begins = start + size * np.arange(trees - 1)
    return [np.concatenate([(begins[:, None] + full[level]).ravel(), start + size * (trees - 1) + last[level]]) for level in range(low + 1)] + addresses(top, above)


class Subtree:
    """The nodes of one aligned subtree."""

    def __init__(self, height: int, n: int, nodes: bytes | None = None):
        self.height, self.n, self.at = height, n, addresses(height, n)
        self.nodes = np.zeros((n_nodes(height, n), 32), np.uint8) if nodes is None else np.frombuffer(nodes, np.uint8).reshape(-1, 32)

    @classmethod
    def grown(cls, leaves: list[bytes], height: int) -> Subtree:
        """From digests of leaves to the root: a parent is the digest of its children's hex text."""
        tree = cls(height, len(leaves))
        tree.nodes[tree.at[0]] = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
        run = FANOUT * HEX
        for level in range(height):
            text = tree.text(level)
            tree.nodes[tree.at[level + 1]] = np.frombuffer(b"".join([hashlib.sha256(text[i:i + run]).digest() for i in range(0, len(text), run)]), np.uint8).reshape(-1, 32)
        return tree

    def text(self, level: int) -> bytes:
        """Hex text of a level's nodes, left to right."""
        return self.nodes[self.at[level]].tobytes().hex().encode()

    @property
    def root(self) -> bytes:
        return self.nodes[self.at[self.height][0]].tobytes()

    def paths(self) -> Iterator[list[bytes]]:
        """For each leaf, from its level up to below the root: hex text of the siblings left and right of its path."""
        levels = [self.text(level) for level in range(self.height)]
        for i in range(self.n):
            path = []
            for level, text in enumerate(levels):
                own = (i >> BITS * level) * HEX
                run = own - own % (FANOUT * HEX)
                path += [text[run:own], text[own + HEX:run + FANOUT * HEX]]
            yield path


def folded(leaf: bytes, path: list[bytes]) -> bytes:
    """The root that a leaf and the siblings along its path give, in hex."""
    node = leaf.hex().encode()
    for left, right in zip(path[::2], path[1::2]):
        node = hashlib.sha256(left + node + right).hexdigest().encode()
    return node


# trees of any size ---------------------------------------------------------------------------------------------------


def digest(*fields: Column) -> Column:
    """SHA-256 (32 bytes) of the fields, each as the number of its bytes, a colon and its text; null as a dash."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256))


def _span() -> int:
    return 1 << BITS * HEIGHT


def _height(n: int) -> int:
    """Levels that lead from ``n`` leaves to one node."""
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def grow(rows: DataFrame) -> list[DataFrame]:
    """Trees over ``rows`` (tree, pos, n, digest): subtrees of up to 4,096 leaves, tier by tier over their roots, until
    each tree has one. A tier has tree, block, n (leaves of the tree at this tier), height, m (leaves of the
    subtree), root, nodes; subtrees of trees that go on have full height."""
    span = _span()

    def build(key, table):
        tree, block = (k.as_py() for k in key)
        order = np.argsort(table.column("pos").to_numpy())
        leaves, n = table.column("digest").take(pa.array(order)).to_pylist(), table.column("n")[0].as_py()
        grown = Subtree.grown(leaves, HEIGHT if n > span else _height(n))
        return pa.Table.from_pylist([{"tree": tree, "block": block, "n": n, "height": grown.height, "m": len(leaves), "root": grown.root, "nodes": grown.nodes.tobytes()}], schema=kinds)

    kinds = pa.schema([("tree", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("height", pa.int32()), ("m", pa.int32()), ("root", pa.binary()), ("nodes", pa.binary())])
    tiers = []
    while True:
        dealt = rows.withColumn("block", F.shiftright("pos", BITS * HEIGHT)).select("tree", "block", "pos", "n", "digest")
        tiers.append(settled(dealt.groupBy("tree", "block").applyInArrow(build, "tree long, block long, n long, height int, m int, root binary, nodes binary"), "merkle"))
        more = tiers[-1].where(F.col("n") > span)
        if more.isEmpty():
            return tiers
        rows = more.select("tree", F.col("block").alias("pos"), F.expr(f"(n + {span - 1}) div {span}").alias("n"), F.col("root").alias("digest"))


def tops(tiers: list[DataFrame]) -> DataFrame:
    """tree, root of every tree."""
    out = tiers[0].where(F.col("n") <= _span()).select("tree", "root")
    for tier in tiers[1:]:
        out = out.unionByName(tier.where(F.col("n") <= _span()).select("tree", "root"))
    return out


def with_tails(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest tier with ``tail``: the siblings from a subtree's root on. ``above`` has tree, top (root of the tree in
    hex) and the tail of that root. Each tier takes its tails from the siblings in the one over it."""
    below = None
    for tier in reversed(tiers):
        known = tier.where(F.col("n") <= _span()).join(above, "tree")
        if below is not None:
            known = known.unionByName(tier.where(F.col("n") > _span()).join(below.select("tree", F.col("leaf").alias("block"), "top", "tail"), ["tree", "block"]))
        below = leaf_tails(known) if tier is not tiers[0] else None
    return known


def leaf_tails(known: DataFrame) -> DataFrame:
    """tree, leaf (its place), digest, top, tail for every leaf of subtrees with tails."""
    span = _span()

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sub = Subtree(row["height"], row["m"], row["nodes"])
                leaves = sub.nodes[sub.at[0]]
                out = [{"tree": row["tree"], "leaf": row["block"] * span + i, "digest": leaves[i].tobytes(), "top": row["top"], "tail": [*path, *row["tail"]]} for i, path in enumerate(sub.paths())]
                for i in range(0, len(out), 512):
                    yield pa.RecordBatch.from_pylist(out[i:i + 512], schema=kinds)

    kinds = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("digest", pa.binary()), ("top", pa.string()), ("tail", pa.list_(pa.binary()))])
    return known.select("tree", "block", "height", "m", "nodes", "top", "tail").mapInArrow(expand, "tree long, leaf long, digest binary, top string, tail array<binary>")


@dataclass
class Manifest:
    """rows: tree, pos, n, id, digest, other of every document; tiers: the subtrees over them, lowest first; over:
    those over the sources' roots; root: the table's root in hex (none for an empty table)."""

    rows: DataFrame
    tiers: list[DataFrame]
    over: list[DataFrame]
    root: str | None


def build_manifest(leaves: DataFrame) -> Manifest:
    """From ``leaves`` (id, source, digest, other): trees per source by id, and one over the sources in the byte order
    of their names; null ids and the null source come first. Rows of a source with one id go by their digest, equal
    ones in any order. ``other`` (a digest or null) is carried along for ``check``.

    Places come from range parts, so a source with most of the rows is dealt to many tasks; no task holds more than
    one subtree of 4,096 leaves. All subtrees are written to the shared folder.
    """
    leaves = settled(leaves.select("id", "source", "digest", "other"), "leaves").withColumn("_row", F.monotonically_increasing_id())
    placed = places(leaves, ["source"], ["id", "digest", "_row"])
    named = places(placed.groupBy("source").agg(F.first("n").alias("size")), [], ["source"], "tree", "n")
    rows = placed.join(named.select(F.col("source").alias("_s"), "tree"), F.col("source").eqNullSafe(F.col("_s"))).select("tree", "pos", "n", "id", "digest", "other")
    tiers = grow(rows)
    subroots = tops(tiers).join(named.select("tree", F.col("n").alias("sources")), "tree")
    over = grow(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("sources").alias("n"), F.col("root").alias("digest")))
    found = tops(over).first()
    return Manifest(rows, tiers, over, found.root.hex() if found else None)


def check(manifest: Manifest) -> DataFrame:
    """Per document: id, leaf, subroot, root, proof_sha256 (of all siblings on the way to the root, from the leaf up,
    left to right), folded_root (from ``other``, else the leaf, and those siblings), verified; digests in hex."""
    spark = manifest.rows.sparkSession
    kinds = pa.schema([("id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
    root, span = manifest.root, _span()
    one = spark.createDataFrame([(0, root, [])], "tree long, top string, tail array<binary>")
    sources = leaf_tails(with_tails(manifest.over, one))
    above = settled(sources.select(F.col("leaf").alias("tree"), F.lower(F.hex("digest")).alias("top"), "tail"), "tails")
    subtrees = with_tails(manifest.tiers, above).select("tree", "block", "height", "m", "nodes", "top", "tail")

    def prove(docs, trees):
        row = trees.to_pylist()[0]
        sub, tail = Subtree(row["height"], row["m"], row["nodes"]), row["tail"]
        rest = b"".join(tail)
        at = [(p % span, i) for i, p in enumerate(docs.column("pos").to_pylist())]
        ids, leaves, others = (docs.column(c).to_pylist() for c in ("id", "digest", "other"))
        out = []
        for path, (_, i) in zip(sub.paths(), sorted(at)):
            back = folded(others[i] or leaves[i], [*path, *tail]).decode()
            out.append((ids[i], leaves[i].hex(), row["top"], root, hashlib.sha256(b"".join(path) + rest).hexdigest(), back, back == root))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)

    dealt = manifest.rows.withColumn("block", F.shiftright("pos", BITS * HEIGHT)).select("tree", "block", "pos", "id", "digest", "other")
    return dealt.groupBy("tree", "block").cogroup(subtrees.groupBy("tree", "block")).applyInArrow(
        prove, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audit_documents(docs: DataFrame) -> DataFrame:
    """Manifest of a table of documents (doc_id, source, lang, n_chars, text), and the check of every document against
    it after some were tampered with: where 5 divides the checksum of the id, the text's A-Z are lower-cased. Null
    fields are leaves' dashes, null ids are never tampered with, other columns take no part."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(F.col("doc_id").cast("long").alias("id"), "source", digest(*fields, F.col("text")).alias("digest"),
                         F.when(hit, digest(*fields, F.translate("text", CAPITALS, SMALL))).alias("other"))
    return check(build_manifest(leaves)).withColumnRenamed("id", "doc_id")
