"""Token files against the tokenizers library, byte for byte, and on odd tables."""

import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowtally.llm import tokenfiles
from flowtally.llm.queries import END_ID, op12_token_files, tokenizer_path
from tests.llm.conftest import SAMPLE


def library(texts):
    t = Tokenizer.from_file(tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, END_ID] for x in texts]


def as_written(ids, kind, docs=None):
    out = io.BytesIO()
    out.close, size = lambda: None, 0
    w = tokenfiles.TokenWriter(out, kind)
    for i, run in enumerate(docs if docs is not None else [ids]):
        w.add(None if i % 5 == 3 else i, [np.array(run, "<u4")])
    assert w.close() == len(out.getvalue())
    return tokenfiles.TokenFile(pa.BufferReader(out.getvalue()))


@pytest.mark.parametrize("kind", ["byte", "bit"])
@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), max_size=30))
def test_planes_round_trip(kind, docs):
    f = as_written(None, kind, docs)
    assert [(n, s, [x for r in runs for x in r.tolist()]) for n, s, runs in f.runs()] == [
        (None if i % 5 == 3 else i, sum(map(len, docs[:i])), d) for i, d in enumerate(docs)]


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_ranges_read_only_their_blocks(kind):
    ids = np.random.default_rng(5).integers(0, 49408, 3 * tokenfiles.BLOCK + 77).astype("<u4")
    f = as_written(ids, kind)
    assert len(f.id_blocks) == 4
    seen = []
    f.block_ids = lambda i, g=f.block_ids: (seen.append(i), g(i))[1]
    a, b = tokenfiles.BLOCK + 5, 2 * tokenfiles.BLOCK + 9
    assert (f.ids(a, b) == ids[a:b]).all() and seen == [1, 2]
    planes = f.id_blocks[0][2:]
    assert planes[2:] == [0, 0] if kind == "byte" else not any(planes[16:])  # ids below 2^16: upper planes are empty
    assert f.ids(len(ids), len(ids) + 5).tolist() == []


def test_damaged_index_is_refused():
    out = bytearray(np.zeros(64, np.uint8).tobytes())
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(pa.BufferReader(bytes(out)))


ODD = ["Don't STOP, it's <|endoftext|>. x", "É́é ÄÖÜ straße İstanbul ΑΣ Σ.", "a b\x1cc d", "1234 5.6,7! ...!? '.s", "日本語テキスト 한국어 ﬁ Å", "ẞ ǅ " + "x" * 70_000,
       " ".join(["word"] * 30_000), "\t\n\r\x0b ", "naïve, Œuvre; ŒUVRE!", "''s 's' 're.", "<|startoftext|><|endoftext|>,", "́abc ̸", "😀👩‍👩‍👧 ok."]


def test_chunks_are_the_librarys(sample_docs):
    texts = ODD + [r.text for r in sample_docs.select("text").collect()]
    with open(tokenizer_path(), encoding="utf-8") as f:
        chunks = tokenfiles.Chunks(f.read())
    assert chunks.by_chunk
    assert [[x for run in chunks.runs(t) for x in run.tolist()] + [END_ID] for t in texts] == library(texts)


def test_other_tokenizers_encode_whole_texts():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    chunks = tokenfiles.Chunks(spec)
    assert not chunks.by_chunk
    t = Tokenizer.from_str(spec)
    for x in ODD[:6]:
        assert [i for r in chunks.runs(x) for i in r.tolist()] == t.encode(x, add_special_tokens=False).ids


def brute(rows):
    """rows: (doc_id, text), in order."""
    out, start = [], 0
    for (i, _), ids in zip(rows, library([t for _, t in rows])):
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_against_the_library(spark, sample_docs):
    got = [tuple(r) for r in op12_token_files(spark, SAMPLE).orderBy("doc_id").collect()]
    assert got == brute(sorted((r.doc_id, r.text) for r in sample_docs.collect()))


def test_odd_documents_in_many_files(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "LEAST_BYTES", 1 << 12)
    files = tokenfiles.write_token_files(odd_docs, tokenizer_path(), END_ID, planes="bit")
    assert files.count() > 1 and files.agg({"n_docs": "sum"}).first()[0] == odd_docs.count()
    got = sorted(tuple(r) for r in tokenfiles.read_token_files(files).collect() if r.doc_id is not None)
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    nulls = [r for r in rows if r[0] is None]
    shift = sum(n for _, _, n, _ in brute(nulls))  # null ids come first
    want = sorted((i, s + shift, n, c) for i, s, n, c in brute(sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))))
    assert got == want
    kept = tokenfiles.read_token_files(files, keep_ids=True).where("doc_id = 5").collect()
    assert len(kept) == 3 and all(r.ids == library([rows[5][1]])[0] for r in kept)


def test_no_documents(spark, no_docs):
    files = tokenfiles.write_token_files(no_docs, tokenizer_path(), END_ID)
    assert files.count() == 0 and tokenfiles.read_token_files(files, keep_ids=True).count() == 0
