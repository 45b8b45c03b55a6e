"""Token ids in binary files: blocks of ids as bit or byte planes, each plane compressed, with an index of the blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowtally.llm.bpe import byte_letters
from flowtally.session import fresh_path, settled

MAGIC = b"FTPLANE1"
#: Ids of a block, documents of a block of the document index, bytes of an id.
BLOCK = 1 << 16
DOC_BLOCK = 1 << 13
WIDTH = 4
#: Text bytes that a file is made of, and the fewest that a further file is opened for while cores are idle.
FILE_BYTES = 128 << 20
LEAST_BYTES = 4 << 20
#: Characters of a text that are encoded at once; chunks that a worker remembers, and the longest that it does.
PIECE = 1 << 16
MEMORY = 600_000
SHORT = 48


# planes ------------------------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of a block of ids, lowest first; a plane of zeros is empty."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, WIDTH)
    planes = rows.T if kind == "byte" else np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    """The ids of a block of ``n``."""
    size = n if kind == "byte" else -(-n // 8)
    rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros(size, np.uint8) for p in planes])
    if kind == "byte":
        return np.ascontiguousarray(rows.T).view("<u4").ravel()
    bits = np.unpackbits(rows, axis=1, count=n, bitorder="little").T
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").ravel()


class TokenWriter:
    """Writes one file as documents come, in bounded memory: one block of ids and one of the document index are held.

    The file: a header; blocks of ids (planes one after the other) and blocks of the document index (ids of
    documents, a mask of null ones, tokens of each) as they fill up; the index of both; its length and the magic.
    """

    def __init__(self, out, kind: str = "byte", level: int = 3):
        if kind not in ("byte", "bit"):
            raise ValueError(f"no such planes: {kind}")
        self.out, self.kind, self.pack = out, kind, zstandard.ZstdCompressor(level=level)
        self.at = self.n_docs = self.n_tokens = 0
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.docs: list[tuple[int | None, int]] = []
        self.id_blocks: list[tuple] = []
        self.doc_blocks: list[tuple] = []
        self._put(MAGIC + struct.pack("<BBHI", WIDTH, 1 if kind == "bit" else 8, 0, BLOCK))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, runs: Iterable[np.ndarray]) -> None:
        """A document's ids, run by run."""
        n = 0
        for run in runs:
            n += len(run)
            self.held.append(run)
            self.n_held += len(run)
            if self.n_held >= BLOCK:
                self._blocks()
        self.docs.append((doc_id, n))
        self.n_tokens += n
        self.n_docs += 1
        if len(self.docs) == DOC_BLOCK:
            self._doc_block()

    def _blocks(self, last: bool = False) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        full = len(ids) if last else len(ids) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            part = ids[i:min(i + BLOCK, full)]
            packed = [self.pack.compress(p) if p else b"" for p in to_planes(part, self.kind)]
            self.id_blocks.append((self.at, len(part), *map(len, packed)))
            self._put(b"".join(packed))
        self.held, self.n_held = [ids[full:]], len(ids) - full

    def _doc_block(self) -> None:
        names = np.array([d or 0 for d, _ in self.docs], "<i8")
        data = self.pack.compress(names.tobytes() + np.packbits([d is None for d, _ in self.docs]).tobytes() + np.array([n for _, n in self.docs], "<i8").tobytes())
        self.doc_blocks.append((self.at, len(data), len(self.docs)))
        self._put(data)
        self.docs = []

    def close(self) -> int:
        """Writes what is held and the index; the file's size."""
        self._blocks(last=True)
        if self.docs:
            self._doc_block()
        index = self.pack.compress(json.dumps({"ids": self.id_blocks, "docs": self.doc_blocks, "n_docs": self.n_docs, "n_tokens": self.n_tokens}).encode())
        self._put(index + struct.pack("<QI", len(index), zlib.crc32(index)) + MAGIC)
        self.out.close()
        return self.at


class TokenFile:
    """Reads a file by its index: any range of tokens, or the documents one after the other."""

    def __init__(self, source):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        head, size = self._at(0, 16), source.size()
        tail = self._at(size - 20, 20)
        if head[:8] != MAGIC or tail[12:] != MAGIC:
            raise ValueError("not a token file")
        self.width, kind, _, self.block = struct.unpack("<BBHI", head[8:16])
        self.kind = "bit" if kind == 1 else "byte"
        length, check = struct.unpack("<QI", tail[:12])
        index = self._at(size - 20 - length, length)
        if zlib.crc32(index) != check:
            raise ValueError("the index of a token file is damaged")
        found = json.loads(self.unpack.decompress(index))
        self.id_blocks, self.doc_blocks, self.n_docs, self.n_tokens = found["ids"], found["docs"], found["n_docs"], found["n_tokens"]

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block_ids(self, i: int) -> np.ndarray:
        at, n, *sizes = self.id_blocks[i]
        data, planes, k = self._at(at, sum(sizes)), [], 0
        for size in sizes:
            planes.append(self.unpack.decompress(data[k:k + size]) if size else b"")
            k += size
        return from_planes(planes, n, self.kind)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Tokens ``start`` to ``stop``; only their blocks are read."""
        first = start // self.block
        parts = [self.block_ids(i) for i in range(first, -(-min(stop, self.n_tokens) // self.block))]
        return np.concatenate(parts)[start - first * self.block:stop - first * self.block] if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, int]]:
        """Id and number of tokens of each document."""
        for at, size, n in self.doc_blocks:
            data = self.unpack.decompress(self._at(at, size))
            names = np.frombuffer(data, "<i8", n).tolist()
            nulls = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 8 * n), count=n).tolist()
            counts = np.frombuffer(data, "<i8", n, 8 * n + -(-n // 8)).tolist()
            yield from ((None if null else name, c) for name, null, c in zip(names, nulls, counts))

    def runs(self) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
        """Id, first token in the file and runs of ids of each document."""
        block, i, at, start = np.zeros(0, "<u4"), 0, 0, 0
        for name, n in self.documents():
            parts, need = [], n
            while need:
                if at == len(block):
                    block, i, at = self.block_ids(i), i + 1, 0
                part = block[at:at + need]
                parts.append(part)
                at += len(part)
                need -= len(part)
            yield name, start, parts
            start += n


# encoding ----------------------------------------------------------------------------------------------------------


#: The split pattern of tokenizers whose tokens never hold white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SMALL = re.compile("[a-zß-öø-ÿ]+").fullmatch
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_MARKED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)").fullmatch


class Chunks(dict):
    """Packed ids of what stands between blanks, as the library gives them.

    With a split pattern that never crosses white space and composition that never does either, a text's ids are
    those of its chunks one after the other. Chunks met before come from a bounded memory: when it is full, what has
    not been met again since it was full before is forgotten. Latin words in small letters go to the model straight
    away, large ones by their small form, marks behind a word by themselves.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parsed = json.loads(spec)
        steps = [p["type"] for p in (parsed.get("normalizer") or {}).get("normalizers", [])]
        splits = (parsed.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_chunk = (steps == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in splits] == ["Split", "ByteLevel"] and splits[0].get("pattern") == {"Regex": WORD_PATTERN}
                         and splits[0].get("behavior") == "Removed" and splits[0].get("invert") and not splits[1].get("add_prefix_space")
                         and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or not t["content"].startswith("<|") or " " in t["content"] for t in parsed["added_tokens"]))
        self.letters = byte_letters()
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.model = self.tokenizer.model

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > SHORT:
            return self._library(chunk)
        out = self.old.get(chunk)
        if out is None:
            out = self._first(chunk)
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[chunk] = out
        return out

    def _first(self, chunk: str) -> bytes:
        if _SMALL(chunk):
            word = chunk if chunk.isascii() else "".join([self.letters[b] for b in chunk.encode()])
            return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()
        if _LATIN(chunk):
            return self[chunk.lower()]
        if marked := _MARKED(chunk):
            return self[marked[1]] + self[marked[2]]
        return self._library(chunk)

    def runs(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a whole text, in runs of a bounded piece of it."""
        if not self.by_chunk:
            yield np.frombuffer(self._library(text), self.type)
            return
        if text.isascii() and "<|" not in text:
            text = text.lower()  # as the normalizer does; fewer chunks to remember
        at, n = 0, len(text)
        while at < n:
            end = n if n - at <= PIECE else text.find(" ", at + PIECE)
            end = n if end < 0 else end
            yield np.frombuffer(b"".join(map(self.__getitem__, text[at:end].replace("\n", " ").split(" "))), self.type)
            at = end


def _chunks(sent: dict) -> Chunks:
    """A worker's encoder: built once beside the broadcast file, used by all its tasks."""
    if "ready" not in sent:
        sent["ready"] = Chunks(sent["spec"])
    return sent["ready"]


# jobs --------------------------------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, tokenizer: str | os.PathLike, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte") -> DataFrame:
    """Encodes every whole text (null: empty), puts ``end_id`` behind each document and writes the ids in ascending
    order of the ids of documents: null ids first, rows with one id by a hash of their texts, equal rows as often as
    they come. Returns the files: shard, path, n_docs, n_tokens, n_bytes, start (tokens in the files before).

    Documents are dealt by ranges of ids into sorted parts, about 128 MB of text each; a task encodes its part
    and writes it as it goes. A file's name is of one attempt of a task and only files of attempts that ended are
    listed, so a lost executor leaves at most a file that nothing names. Ids of documents are whole numbers.
    ``folder`` must be one that all executors reach; the cluster's shared folder by default. No rows give no files.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast({"spec": f.read()})
    folder = folder or fresh_path(spark, "tokens")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // FILE_BYTES), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path = None, None
        end = np.array([end_id], "<u4")
        for batch in batches:
            if batch.num_rows and out is None:
                target, base = fs.FileSystem.from_uri(folder)
                target.create_dir(base, recursive=True)
                name = f"shard-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.ids"
                path, out = f"{folder.rstrip('/')}/{name}", TokenWriter(target.open_output_stream(f"{base.rstrip('/')}/{name}"), planes)
            if batch.num_rows:
                encoder = _chunks(sent.value)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    def runs(text=text.as_py() or ""):
                        yield from encoder.runs(text)
                        yield end
                    out.add(doc_id, runs())
        if out is not None:
            size = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path], "n_docs": pa.array([out.n_docs], pa.int64()),
                                              "n_tokens": pa.array([out.n_tokens], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    tie = F.xxhash64("text")
    ordered = keyed.withColumn("tie", tie).repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    files = settled(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long, n_bytes long"), "token-files")
    # one narrow row for each file of about 128 MB of text
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_token_files(files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with ``keep_ids``, ids of every document, read back from ``files``
    (path, start). A task holds one block of ids, one of the document index and one document."""
    count = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target, plain = fs.FileSystem.from_uri(path)
                with target.open_input_file(plain) as source:
                    rows, held = [], 0
                    for doc_id, start, runs in TokenFile(source).runs():
                        n, crc = 0, 0
                        for run in runs:
                            n += len(run)
                            crc = zlib.crc32(np.ascontiguousarray(run), crc)
                        rows.append((doc_id, base + start, n, crc, *([np.concatenate(runs).astype(np.int32)] if keep_ids and runs else [np.zeros(0, np.int32)] * keep_ids)))
                        held += n * keep_ids
                        if len(rows) >= DOC_BLOCK or held >= 1 << 22:
                            yield _rows(rows, keep_ids)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows, keep_ids)

    return files.select("path", "start").repartition(count).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def _rows(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int32())] * keep_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
