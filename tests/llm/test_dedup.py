import re

from flowtally.llm import linededup, spans


def brute_lines(rows, least):
    """Every pair of places, its longest common run of lines with words; later copies go."""
    docs = sorted({(i, t) for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    seqs, corpus = [], []
    for d, (_, t) in enumerate(docs):
        ls = [x for x in (t or "").split("\n") if x.encode().split()]
        seqs.append(ls)
        corpus += [(d, k) for k in range(len(ls))]
    gone = set()
    for x, (d, i) in enumerate(corpus):
        for e, j in corpus[x + 1:]:
            n = words = 0
            while i + n < len(seqs[d]) and j + n < len(seqs[e]) and seqs[d][i + n] == seqs[e][j + n]:
                words += len(seqs[d][i + n].encode().split())
                n += 1
            if words >= least:
                gone |= {(e, j + k) for k in range(n)}
    out = {}
    for d, (i, t) in enumerate(docs):
        k, kept = 0, []
        for line in (t or "").split("\n"):
            worded = bool(line.encode().split())
            if not worded or (d, k) not in gone:
                kept.append(line)
            k += worded
        n = sum(1 for x in gone if x[0] == d)
        out[(i, t)] = ("\n".join(kept) if n else t, n)
    return out


def test_lines_by_brute_force(spark):
    import random
    r = random.Random(2)
    lines = ["", " "] + [" ".join(f"w{r.randint(0, 4)}" for _ in range(n)) for n in (1, 1, 2, 3, 3, 5, 9)]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randint(0, 14)))) for i in range(40)]
    rows += [(40, rows[3][1]), (41, None), (41, None), (42, ""), rows[5]]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_lines(rows, 8)
    left = dict(zip(rows, rows))
    seen = got.collect()
    assert len(seen) == len(rows)
    by_id = {}
    for (i, t), w in want.items():
        by_id.setdefault(i, []).append(w)
    for x in seen:
        assert (x["text"], x["dedup"]["n_removed"]) in by_id[x["doc_id"]], x
    assert sum(x["dedup"]["n_removed"] for x in seen) > 20 and left


def test_lines_of_odd_tables(spark, odd_docs, no_docs):
    got = linededup.dedup_lines(odd_docs)
    assert got.columns == [*odd_docs.columns, "dedup"] and got.count() == odd_docs.count()
    assert linededup.dedup_lines(no_docs).count() == 0
    unique = spark.createDataFrame([(1, "all of these words are found only once"), (2, "and so are these ones")], "doc_id long, text string")
    assert {r["text"] for r in linededup.dedup_lines(unique).collect()} == {r["text"] for r in unique.collect()}


def brute_spans(rows, least):
    docs = sorted({(i, t) for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    first, out = {}, {}
    for d, (i, t) in enumerate(docs):
        pieces = re.findall(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", t or "")
        worded = [k for k, p in enumerate(pieces) if p.encode().split()]
        norm = [tuple(pieces[k].encode().lower().split()) for k in worded]
        gone = set()
        for a in range(len(worded)):
            b = a
            while b < len(worded) and sum(map(len, norm[a:b])) < least:
                b += 1
            if sum(map(len, norm[a:b])) < least:
                break
            if first.setdefault(tuple(norm[a:b]), (d, a)) != (d, a):
                gone |= set(worded[a:b])
        out[(i, t)] = ("".join(p for k, p in enumerate(pieces) if k not in gone), len(worded), len(gone))
    return out


def test_spans_by_brute_force(spark, sample_docs):
    rows = [(r["doc_id"], r["text"]) for r in sample_docs.collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "...\n\n!"), (10**6 + 3, "\u00a0")]
    passage = "This passage of well over fifty words stands in more than one text. It goes on for a while, as such passages do! Does it end soon? No, it has some more to say about nothing in particular, and it says so at length. At last it ends here."
    rows += [(10**6 + 10 + k, f"Own words number {k} begin the text. {passage.upper() if k == 2 else passage} And other words {k} end it.") for k in range(4)]
    rows.append(rows[7])
    got = spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = {i: v for (i, _), v in brute_spans(rows, 20).items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r["text"], r["n_sentences"], r["n_removed"]) == want[r["doc_id"]], r["doc_id"]
    cut = {r["doc_id"]: r["text"] for r in got}
    assert passage in cut[10**6 + 10] and "fifty words" not in cut[10**6 + 11] and "FIFTY" not in cut[10**6 + 12]


def test_spans_of_odd_tables(spark, odd_docs, no_docs):
    got = spans.dedup_spans(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert spans.dedup_spans(no_docs).count() == 0


def brute_passages(rows, least):
    """Every run of sentences with enough words; all but its first copy go."""
    places, out = {}, {i: set() for i, _ in rows}
    for i, t in sorted(rows):
        norm = [tuple(p.encode().lower().split()) for p in re.findall(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", t) if p.encode().split()]
        for a in range(len(norm)):
            for b in range(a + 1, len(norm) + 1):
                if sum(map(len, norm[a:b])) >= least and places.setdefault(tuple(norm[a:b]), (i, a)) != (i, a):
                    out[i] |= set(range(a, b))
    return out


def test_spans_cover_the_tail_of_a_passage(spark):
    import random
    r = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(30)) + ". " + " ".join(f"q{k}" for k in range(6)) + ". "
    pieces = [" ".join(f"w{r.randint(0, 99)}" for _ in range(n)) + ". " for n in (2, 3, 5, 6, 9, 14, 25, 31)]
    rows = [(i, f"own {i} begins. {passage}own {i} ends.") for i in range(3)]
    rows += [(10 + i, "".join(r.choice(pieces) for _ in range(r.randint(1, 12)))) for i in range(30)]
    got = spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), both_ends=True).collect()
    assert {x["doc_id"]: x["n_removed"] for x in got} == {i: len(x) for i, x in brute_passages(rows, 20).items()}
    assert {x["doc_id"]: x["text"] for x in got}[2] == "own 2 begins. own 2 ends."
