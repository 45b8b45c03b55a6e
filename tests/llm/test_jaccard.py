import random
from collections import Counter

import numpy as np
import pyarrow as pa

from flowtally.llm import jaccard
from flowtally.llm.components import components


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    held = {}
    for n, (_, s) in enumerate(sets):
        c = Counter(m for x in s for m in held.get(x, ()))
        for m, both in c.items():
            if 4 * both >= 3 * (len(s) + len(sets[m][1]) - both):
                a, b = top(n), top(m)
                up[max(a, b)] = min(a, b)
        for x in s:
            held.setdefault(x, []).append(n)
    low = {}
    for n, (i, s) in enumerate(sets):
        if s and i is not None:
            low[top(n)] = min(low.get(top(n), i), i)
    return sorted(((i is None, i or 0, len(s), low.get(top(n)) if s else i) for n, (i, s) in enumerate(sets)), key=str)


def family(r, size, copies, edits):
    """Copies of copies, so that links form chains."""
    words = [f"w{r.randint(0, 10**6)}" for _ in range(size)]
    out = [" ".join(words)]
    for _ in range(copies):
        words = list(words)
        for _ in range(max(1, int(edits * size))):
            k = r.randrange(len(words))
            words[k:k + 1] = r.choice([[], [f"n{r.randint(0, 10**6)}"], [words[k], "more"]])
        out.append(" ".join(words))
    return out


def test_components_by_brute_force(spark):
    r = random.Random(11)
    passage = " ".join(f"shared{k}" for k in range(30))
    texts = [None, "", "one", "ONE", "a b c d", "a b c e", "a b c d e f", "a b c d e f g"]
    for size in (6, 9, 14, 22, 28, 40, 95, 110, 380, 420, 1600):
        for edits in (0.01, 0.03, 0.05, 0.08):
            texts += family(r, size, 4, edits)
    texts += [passage + " " + " ".join(f"u{r.randint(0, 10**6)}" for _ in range(r.randint(5, 60))) for _ in range(120)]
    texts += family(r, 120, 60, 0.02)
    rows = list(enumerate(texts)) + [(3, "ONE"), (None, texts[20]), (None, "of no other text")]
    r.shuffle(rows)
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x["id"] is None, x["id"] or 0, x["n_shingles"], x["component_id"]) for x in got), key=str) == brute(rows)


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(1)
    for size in [*range(1, 40), 60, 95, 96, 130, 300, 383, 384, 1500, 3000]:
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            gone, new = (int(x) for x in r.integers(0, size // 3 + 1, 2))
            b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 2**63, new, dtype=np.uint64)]))
            common = np.sort(r.permutation(a)[:size // 3])
            if len(b) and jaccard.matches(a, b):
                assert set(jaccard.signatures(a, common, {}).tolist()) & set(jaccard.signatures(b, common, {}).tolist()), size
                assert jaccard.may_match(len(a), len(b), jaccard.sketch(a), jaccard.sketch(b))


def test_keep_first(spark, odd_docs, no_docs):
    kept = jaccard.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in kept.collect())
    # 6, 7 and 8 repeat 5 (8 twice over, 11 with two words more), 10 is 9 and a tail; wordless ones stay
    assert got == [(False, i) for i in (0, 1, 2, 3, 4, 5, 9, 12)] + [(True, 0)]
    assert jaccard.keep_first(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 200), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(30)}, 300: 200, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_many_near_pairs_of_a_part_are_joined_inside_it(spark, monkeypatch):
    r = random.Random(5)
    texts = family(r, 120, 60, 0.02) + family(r, 30, 40, 0.04) + [f"w{k} x y z {k} v" for k in range(20)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    monkeypatch.setattr(jaccard, "MANY_PAIRS", (0, 0.0))
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x["id"] is None, x["id"] or 0, x["n_shingles"], x["component_id"]) for x in got), key=str) == brute(rows)


def test_pairs_of_a_group_do_not_grow_with_its_square():
    made = {}
    for m in (200, 400):
        base = np.arange(1, 101, dtype=np.uint64) * np.uint64(2**40 + 12345)
        sets = [np.sort(np.concatenate([base, np.array([7 * k + 1], np.uint64)])) for k in range(m)]
        groups = pa.table({"part": pa.array([3] * m), "g": pa.array([1] * m), "node": pa.array(range(m)), "label": pa.array(range(m))})
        held = pa.table({"name": pa.array(range(m)), "n": pa.array([len(s) for s in sets]), "sketch": pa.array([jaccard.sketch(s) for s in sets], pa.binary()),
                         "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
        assert jaccard._crossed((pa.scalar(3),), groups, held).to_pylist() == [{"a": None, "b": None, "part": 3}]
        made[m] = jaccard._joined(groups, held).num_rows
    assert made == {200: 199, 400: 399}


def test_joining_pairs_need_no_shingles():
    """Parts with many near pairs get names, sizes and sketches, not the sets: these were shuffled to each part."""
    base = np.arange(1, 101, dtype=np.uint64) * np.uint64(2**40 + 12345)
    sets = [np.sort(np.concatenate([base, np.array([7 * k + 1], np.uint64)])) for k in range(200)]
    groups = pa.table({"part": pa.array([3] * 200), "g": pa.array([1] * 200), "node": pa.array(range(200)), "label": pa.array(range(200))})
    held = pa.table({"for_part": pa.array([3] * 200), "name": pa.array(range(200)), "n": pa.array([len(s) for s in sets]), "sketch": pa.array([jaccard.sketch(s) for s in sets], pa.binary())})
    told = jaccard._sifted((pa.scalar(3),), groups, held, 0).to_pylist()
    assert [r["part"] for r in told].count(3) == 1 and len(told) == 200
    assert len({x for r in told if r["part"] is None for x in (r["a"], r["b"])}) == 200
    # told again, a part gives eight times as many if need be, in the end all pairs
    assert len(jaccard._sifted((pa.scalar(3),), groups, held, 1)) == 200
    assert len(jaccard._sifted((pa.scalar(3),), groups, held, 3)) == 200 * 199 // 2


def test_joining_pairs_that_fail_leave_no_link_out(spark, monkeypatch):
    r = random.Random(9)
    passage = " ".join(f"shared{k}" for k in range(30))
    texts = [passage + " " + " ".join(f"u{r.randint(0, 10**6)}" for _ in range(r.randint(9, 14))) for _ in range(40)]
    texts += [t for s in (30, 36) for t in family(r, s, 25, 0.03)]
    texts += [f"{t} {k}" for k, t in enumerate(texts[3:30:3])]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    monkeypatch.setattr(jaccard, "MANY_PAIRS", (0, 0.0))
    monkeypatch.setattr(jaccard, "WIDER", 2)
    monkeypatch.setattr(jaccard, "sketch", lambda shingles: bytes(32))  # lets all pairs of like sizes through
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x["id"] is None, x["id"] or 0, x["n_shingles"], x["component_id"]) for x in got), key=str) == brute(rows)


def test_brief_sketches_keep_similar_sets_and_tell_others_apart():
    r = np.random.default_rng(2)
    for size in [*range(1, 40), 64, 95, 128, 383, 1024, 1500]:
        a, other = (np.unique(r.integers(0, 2**63, size, dtype=np.uint64)) for _ in range(2))
        b = np.unique(np.concatenate([a[size // 9:], r.integers(0, 2**63, size // 9, dtype=np.uint64)]))
        whole, short = zip(*((x, jaccard.brief(x)) for x in map(jaccard.sketch, (a, b, other))))
        assert [len(x) for x in short] == [len(x) // jaccard.FOLD for x in whole]
        if jaccard.matches(a, b):
            assert jaccard.may_match(len(a), len(b), short[0], short[1])
        if size >= 64:
            assert not jaccard.may_match(len(a), len(other), short[0], short[2])


def test_pairs_of_stars_meet_brief_sketches_and_only_what_is_left_whole_ones(spark, monkeypatch):
    """Every pair of a star carried a whole sketch through a shuffle, though nearly all pairs are far apart."""
    r = random.Random(4)
    passage = " ".join(f"shared{k}" for k in range(30))
    texts = family(r, 200, 3, 0.01) + [passage + " " + " ".join(f"u{r.randint(0, 10**6)}" for _ in range(100)) for _ in range(30)]
    rows, met, close = list(enumerate(texts)), [], jaccard._close

    def spy(pairs, sketches):
        kept = close(pairs, sketches)
        met.append((pairs.count(), kept.count(), sketches.count(), max((len(x["sketch"]) for x in sketches.collect()), default=0)))
        return kept

    monkeypatch.setattr(jaccard, "_close", spy)
    got = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x["id"] is None, x["id"] or 0, x["n_shingles"], x["component_id"]) for x in got), key=str) == brute(rows)
    (pairs, left, sets, width), (named, _, whole_sets, whole) = met[:2]
    assert named == left < pairs and whole_sets < sets and width <= 256 // jaccard.FOLD < whole
