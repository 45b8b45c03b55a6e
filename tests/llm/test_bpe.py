import hashlib
import json
import random

import numpy as np
import pytest

from flowtally.llm import bpe
from flowtally.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def spec():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return json.load(f)


def odd_texts():
    r = random.Random(5)
    letters = "etaoinshrdlu"
    return ["", " ", "I'm he'll <|endoftext|> 123 ΣΑΣ é e\u0301 <|startoftext|>", "a" * 3000, "ab" * 2000, "the" * 900, "".join(r.choice(letters) for _ in range(6000)),
            "日本語のテキスト、カタカナ。", "a\u00a0b\u3000c\x85d", "😀😀 x" * 20, ".,!?" * 300] + ["".join(chr(r.choice([r.randint(32, 126), r.randint(0xA1, 0x24F), r.randint(0x370, 0x3FF), r.randint(0x4E00, 0x9FFF)])) for _ in range(120)) for _ in range(40)]


def test_ids_and_tokens_are_the_librarys(spec, library, sample_docs):
    encoder, decoder = bpe.Encoder(spec), bpe.Decoder(spec)
    for text in odd_texts() + [r["text"] or "" for r in sample_docs.collect()]:
        want = library.encode(text, add_special_tokens=False).ids
        runs = list(encoder.encode(text))
        assert np.frombuffer(b"".join(runs), "<u4").tolist() == want, text[:60]
        assert b"".join(decoder.decode(runs)).decode() == library.decode(want, skip_special_tokens=False)


def test_stream_holds_no_more_than_its_lookahead(spec):
    merges = bpe.Encoder(spec).merges
    r = random.Random(1)
    for alphabet in ("a", "ab", "etaoinshr", "-=", "ha", "0"):
        word = [r.choice(alphabet) for _ in range(4000)]
        whole = merges.merged([*word[:-1], word[-1] + merges.end])
        assert list(merges.stream(iter(word), 8)) == [merges.ids[t] for t in whole]


def test_pieces_join_to_the_text():
    text = "word " * 30 + "y" * 50 + "\n" + "z" * 5
    assert "".join(bpe._pieces(text, 16)) == text
    assert max(map(len, bpe._pieces("ab " * 100, 16))) < 20


def test_utf8_machine_on_any_cut():
    data = "aé日😀".encode() + b"\xff\xe2\x82" + "z".encode() + b"\xf0\x9f"
    for size in (1, 2, 3, 5, 100):
        m = bpe.Utf8Machine()
        out = b"".join(m.feed(data[i:i + size]) for i in range(0, len(data), size)) + m.close()
        assert out.decode() == data.decode("utf-8", "replace")


def test_table_of_texts(spark, odd_docs, no_docs, library):
    got = bpe.encode_texts(odd_docs, tokenizer_path()).collect()
    assert len(got) == odd_docs.count()
    texts = {}
    for r in odd_docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    for r in got:
        want = [library.encode(t, add_special_tokens=False).ids for t in texts[r["doc_id"]]]
        assert r["ids"] in want and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(r["ids"], skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_texts(no_docs, tokenizer_path()).count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame([(1, "the quick brown fox, 42!"), (2, "été à Paris"), (3, None), (4, "")], "doc_id long, text string")
    back = bpe.decode_ids(bpe.encode_texts(df, tokenizer_path()), tokenizer_path())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "the quick brown fox , 4 2 ! ", 2: "été à paris ", 3: "", 4: ""}
