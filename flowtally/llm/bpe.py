"""Byte-pair encoding and decoding as streams: a transducer with bounded lookahead, and a byte-to-text machine."""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of a word that are in memory at once, on top of the lookahead.
WINDOW = 256
#: Words whose ids a worker remembers, and the longest that it does.
MEMORY = 400_000
SHORT = 64
#: Characters of a text that are normalised and split at once.
PIECE = 1 << 16


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Merges:
    """A merge list with word ends, and how far right of a token its stability can depend on what follows."""

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], end: str):
        self.end, self.ids = end, vocabulary
        self.rank: dict[tuple[str, str], int] = {}
        self.lookahead = self._sufficient_lookahead([tuple(m) for m in merges])

    def _sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        """A merge (a, b) can only fail to come because a stronger merge (t, c) takes the right edge t of its
        right part first; whether that one comes depends in turn on what lies behind c. Ranks fall at each such
        step, so one pass over the list in rank order gives the longest chain in characters."""
        behind: dict[str, int] = {}
        taken_by: dict[str, int] = {}
        longest = 0
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), i)
            reach = max(taken_by.get(b, 0), behind.get(b, 0))
            behind[a + b] = max(behind.get(a + b, 0), reach)
            taken_by[a] = max(taken_by.get(a, 0), len(b) + reach)
            longest = max(longest, len(b) + reach)
        return longest + max((len(k) for k in self.ids), default=1)

    def merged(self, symbols: list[str]) -> list[str]:
        """The tokens of a run of symbols: the strongest pair first, the leftmost of equals. Only the ranks beside
        a merge are looked up again."""
        rank, never = self.rank.get, 1 << 60
        ranks = [rank(pair, never) for pair in zip(symbols, symbols[1:])]
        while ranks:
            low = min(ranks)
            if low == never:
                break
            i = ranks.index(low)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), never)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), never)
        return symbols

    def stream(self, letters: Iterable[str], window: int = WINDOW) -> Iterator[int]:
        """Ids of one word given letter by letter. Tokens go out once the lookahead behind them has been seen:
        then no later letter changes them, and the rest of the word is encoded as if it began there. At most
        the lookahead and ``window`` letters are held."""
        held: list[str] = []
        size = self.lookahead + window
        for x in letters:
            held.append(x)
            if len(held) > size:
                done = 0
                for token in self.merged(held.copy()):
                    if done + len(token) + self.lookahead > len(held):
                        break
                    done += len(token)
                    yield self.ids[token]
                held = held[done:]
        if held:
            held[-1] += self.end
            for token in self.merged(held):
                yield self.ids[token]


class Encoder:
    """Encodes whole texts with the vocabulary of a tokenizer file: canonical composition, lower case, words by
    the file's pattern, bytes as letters, merges with word ends. Special tokens in a text are tokens."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.merges = Merges(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.letters = byte_letters()
        self.packed = {t: i.to_bytes(4, "little") for t, i in model["vocab"].items()}
        self.known = _Words(self)

    def word(self, word: str) -> bytes:
        letters = self.letters
        symbols = [letters[b] for b in word.encode("utf-8", "replace")]
        if len(symbols) <= self.merges.lookahead:
            symbols[-1] += self.merges.end
            return b"".join([self.packed[t] for t in self.merges.merged(symbols)])
        return b"".join([i.to_bytes(4, "little") for i in self.merges.stream(symbols)])

    def _plain(self, text: str) -> Iterator[bytes]:
        for part in _pieces(text, PIECE):
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            yield b"".join(map(self.known.__getitem__, self.pattern.findall(part)))

    def encode(self, text: str) -> Iterator[bytes]:
        """Runs of ids as little-endian 32-bit numbers."""
        at = 0
        for m in self.marks.finditer(text):
            yield from self._plain(text[at:m.start()])
            yield self.special[m.group()].to_bytes(4, "little")
            at = m.end()
        yield from self._plain(text[at:] if at else text)


class _Words(dict):
    """Ids of the words met so far, up to a bounded number of short ones."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = self.encoder.word(word)
        if len(word) <= SHORT:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = ids
        return ids


def _pieces(text: str, size: int) -> Iterator[str]:
    """A text in parts that end before a blank, so that no word, accent or contraction is cut."""
    at, n = 0, len(text)
    while n - at > size:
        cut = at + size
        while cut < n and text[cut] not in " \t\n\r":
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


class Decoder:
    """Ids to text, run by run.

    ``tokens``: each token's letters with a blank between tokens, as files without a decoder are read.
    ``text``: the bytes behind the letters; a word end is a blank. Bytes go through a UTF-8 machine that holds
    at most the three first bytes of an unfinished character; what can't be a character becomes U+FFFD.
    """

    def __init__(self, spec: dict, style: str = "tokens"):
        if style not in ("tokens", "text"):
            raise ValueError(f"no such style: {style}")
        self.style = style
        end = spec["model"].get("end_of_word_suffix") or ""
        names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        special = {t["id"] for t in spec["added_tokens"]}
        back = {c: b for b, c in enumerate(byte_letters())}
        self.table: list[bytes] = []
        for i in range(max(names, default=-1) + 1):
            name = names.get(i, "")
            if style == "tokens":
                self.table.append(name.encode())
            else:
                ends = bool(end) and name.endswith(end) and i not in special
                stem = name[:-len(end)] if ends else name
                raw = stem.encode() if i in special else bytes(back[c] for c in stem)
                self.table.append(raw + b" " * ends)

    def decode(self, runs: Iterable[bytes]) -> Iterator[bytes]:
        """UTF-8 of the text, run by run."""
        first, machine = True, Utf8Machine()
        for run in runs:
            ids = np.frombuffer(run, "<u4").tolist()
            if not ids:
                continue
            parts = map(self.table.__getitem__, ids)
            if self.style == "tokens":
                yield (b"" if first else b" ") + b" ".join(parts)
                first = False
            else:
                yield machine.feed(b"".join(parts))
        yield machine.close()


class Utf8Machine:
    """Bytes in, whole characters out; its state is the start of one character."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def _open(tail: bytes) -> int:
        """How many bytes at the end of ``tail`` may be the start of a character that goes on."""
        for n in range(1, min(3, len(tail)) + 1):
            lead = tail[-n]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                return n if n < need else 0
            if lead < 0x80:
                return 0
        return 0

    def feed(self, data: bytes) -> bytes:
        data = self.held + data
        keep = self._open(data[-3:])
        data, self.held = (data[:-keep], data[-keep:]) if keep else (data, b"")
        return data.decode("utf-8", "replace").encode()

    def close(self) -> bytes:
        data, self.held = self.held, b""
        return data.decode("utf-8", "replace").encode()


_READY: dict[str, tuple[Encoder, Decoder]] = {}


def _ready(spec: str, style: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a worker: built once, used by all its tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest() + style
    if key not in _READY:
        parsed = json.loads(spec)
        _READY[key] = Encoder(parsed), Decoder(parsed, style)
    return _READY[key]


def encode_texts(docs: DataFrame, tokenizer: str | os.PathLike, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, style: str = "tokens") -> DataFrame:
    """id, n_tokens, ids (array, only with ``keep_ids``), ids_sha256, decoded_sha256 of every whole text; null counts
    as empty. ``tokenizer``: a tokenizer file the driver can read; it is sent to the workers once. One row for
    each row, whatever repeats. Ids go on to the decoder run by run, so that a long text needs memory for its
    text and one piece of ids, or for its ids too if they are kept."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = ", ids array<int>" if keep_ids else ""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoder, decoder = _ready(sent.value, style)
            count, ids_hash, text_hash, all_ids = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                n, h, g = 0, hashlib.sha256(), hashlib.sha256()
                runs = []

                def passed(source=encoder.encode(text)):
                    nonlocal n
                    for ids in source:
                        n += len(ids) // 4
                        h.update(ids)
                        if keep_ids:
                            runs.append(ids)
                        yield ids

                for piece in decoder.decode(passed()):
                    g.update(piece)
                count.append(n)
                ids_hash.append(h.hexdigest())
                text_hash.append(g.hexdigest())
                if keep_ids:
                    all_ids.append(np.frombuffer(b"".join(runs), "<i4"))
            columns = [batch.column(0), pa.array(count, pa.int64())]
            names = [id_col, "n_tokens"]
            if keep_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], [*names, "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_tokens long{kept}, ids_sha256 string, decoded_sha256 string")


def decode_ids(encoded: DataFrame, tokenizer: str | os.PathLike, id_col: str = "doc_id", ids_col: str = "ids", style: str = "text") -> DataFrame:
    """id and text of every row of ids; null ids give an empty text."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, decoder = _ready(sent.value, style)
            texts = [b"".join(decoder.decode([np.asarray(v.as_py() or [], "<u4").tobytes()])).decode() for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")
