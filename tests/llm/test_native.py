"""Mixing, quality rules, licence scans and url filters against plain Python."""
import math
import re
from collections import Counter

from flowtally.llm import licenses, mixing, quality, urlrules
from flowtally.llm.queries import URL_RULES


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_targets_fill_by_weight(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 40, None: 70, "e": 0}
    got = {r["source"]: r["target"] for r in mixing.with_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    want, open_ = {}, set(sizes)
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(want.values())
        level = {s: rest * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] >= 2 * sizes[s]}
        if not over:
            break
        want |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    want |= level
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s]) for s in want)
    assert math.isclose(sum(got.values()), 1.5 * sum(sizes.values()))


def test_mix_comes_near_its_targets_and_agrees_on_reruns(spark, sample_docs):
    got = mixing.mix_report(sample_docs).collect()
    rows = {r["doc_id"]: r for r in sample_docs.collect()}
    assert len(got) == len(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        s = rows[r["id"]]["source"]
        assert r["size"] == len(words(rows[r["id"]]["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    targets = {rows[r["id"]]["source"]: r["target"] for r in got}
    assert all(abs(taken[s] - t) <= largest[s] for s, t in targets.items())
    again = mixing.mix_report(sample_docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mix_of_odd_tables(spark, odd_docs, no_docs):
    got = mixing.mix_report(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    copies = mixing.mix_documents(odd_docs)
    assert copies.columns == odd_docs.columns
    assert sum(len(words(r["text"])) for r in copies.collect()) == sum(r["taken"] for r in got)
    assert mixing.mix_report(no_docs).count() == 0 and mixing.mix_documents(no_docs).count() == 0


def brute_quality(t):
    w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
    spans = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    twice = {p for i in range(len(w) - 7) if spans[tuple(w[i:i + 8])] > 1 for p in range(i, i + 8)}
    s = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", t or "")), n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(twice))
    s["base_failed"] = len(w) < 20 or 100 * len(twice) > 30 * len(w)
    s["kept"] = not (s["base_failed"] or 10 * s["n_symbols"] > len(w) or not 2 * len(w) <= s["word_chars"] <= 20 * len(w) or 2 * s["n_dup_lines"] > len(lines))
    return s


def test_quality_by_brute_force(spark, sample_docs, odd_docs, no_docs):
    for docs in (sample_docs, odd_docs):
        got = quality.judge_quality(docs)
        assert got.columns == [*docs.columns, "quality"]
        rows = got.select("text", "quality").collect()
        assert len(rows) == docs.count()
        for r in rows:
            want = brute_quality(r["text"])
            assert {k: r["quality"][k] for k in want} == want
            assert (r["quality"]["rejected_by"] is None) == want["kept"]
        kept = quality.keep_good(docs)
        assert kept.columns == docs.columns and kept.count() == sum(r["quality"]["kept"] for r in rows)
        assert got.where("quality.kept").count() == kept.count()
    assert quality.judge_quality(no_docs).count() == 0 and quality.keep_good(no_docs).count() == 0


def test_rule_order_has_no_part_in_the_verdict(spark, sample_docs):
    order = quality.rule_order(sample_docs, "text", sample_rows=50)
    rates = [share / cost for _, share, cost in order]
    assert rates == sorted(rates, reverse=True) and {r for r, _, _ in order} == set(quality.RULES)


def test_urls(spark):
    urls = ["https://a.b.example.net/en/x?y", "http://EXAMPLE.NET/en/", "http://example.net/en", "http://notexample.net/en/", "ftp://example.com/de/1#f", "http://example.com/d", "http://x.org/fr/", "http://org/fr/", "http://org", "http://forg/fr/",
            "no url", "", None, "http://", "http:///p", "a://net/://x", "https://m.net?x=/en/", "https://m.net/a?u=http://example.com/de/", "http://net./", "http://.net/", "http://\u00c9.net/"]
    pages = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls + urls[:1] * 3)], "page_id long, url string, judged string")
    rules = [*URL_RULES, ("b.example.net", "/en/x", "block"), ("net", "/en", "allow"), ("com", "/d", "block"), ("EXAMPLE.com", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("org", None, "block"), ("org", "/fr/", "allow")]
    got = urlrules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), strip_rows=3)
    assert got.columns == ["page_id", "url", "judged", "judged_"] and got.count() == pages.count()
    for r in got.collect():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), len(h), h.lower() + p, v) for h, p, v in rules if h and p is not None and path.startswith(p) and (host == h.lower() or host.endswith("." + h.lower()))]
        best = max(fits, default=(0, 0, None, "allow"))
        j = r["judged_"]
        assert (j["host"], j["path"], j["rule"], j["verdict"]) == (host, path, best[2], best[3]), r["url"]
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["judged_"]["verdict"] for r in urlrules.judge_urls(pages, none, default="block").collect()} == {"block"}
    assert urlrules.judge_urls(pages.limit(0), none).count() == 0


def brute_licenses(rows, templates, least):
    terms = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    vocabulary = {w for ts in templates.values() for t in ts for w in terms(t)}
    n, df = len(rows), Counter(w for _, _, t in rows for w in set(terms(t)) & vocabulary)
    weight = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1

    def vector(t):
        c = Counter(terms(t))
        v = {w: k * weight(w) for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    targets = [(name, vector(t)) for name, ts in templates.items() for t in ts]
    own = {}
    for i, p, t in rows:
        lines = (t or "").split("\n")
        units = [("header", "\n".join(lines[k:k + h])) for k, x in enumerate(lines) if re.search(licenses.CUES, x) for h in licenses.HEIGHTS]
        if p is not None and re.search(licenses.FILE_NAMES, p):
            units.append(("file", t or ""))
        best = []
        for kind, u in units:
            v = vector(u)
            best += [(-round(sum(x * t.get(w, 0) for w, x in v.items()), 6), name, kind) for name, t in targets]
        best = [b for b in best if -b[0] >= least]
        own[i, p, t] = min(best, default=None)
    folder = lambda p: p.rpartition("/")[0]
    out = []
    for i, p, t in rows:
        b = own[i, p, t]
        if b:
            out.append((i, b[1], b[2], p))
            continue
        found = None
        d = folder(p) if p is not None else None
        while d is not None and not found:
            held = [(own[x][0], x[1], own[x][1]) for x in own if x[1] is not None and re.search(licenses.FILE_NAMES, x[1]) and own[x] and folder(x[1]) == d]
            found = min(held, default=None)
            d = folder(d) if d else None
        out.append((i, found[2], "inherited", found[1]) if found else (i, None, None, None))
    return sorted(out, key=str)


def test_licenses_by_brute_force(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    rows = [(1, "LICENSE", mit[2]), (2, "a/b/x.py", "# code\n" + gpl[0] + "\nmore of it"), (3, "a/b/y.py", "no words about that"), (4, "a/COPYING.txt", gpl[1]),
            (5, "a/z/deep/er/f.c", None), (6, "top.c", ""), (7, None, "Released under the MIT License."), (8, None, "nothing"), (9, "c/LICENSE", "unknown terms apply to all of this"), (10, "c/d.c", "x"),
            (11, "a/w.c", "Permission to enter is not given to persons without a ticket"), (3, "a/b/y.py", "no words about that"), (12, "/abs/f.c", "y"), (13, "a/b/l.c", "x " * 5000 + "\nLicensed under CC BY-NC 4.0.\n" + "y " * 5000)]
    files = spark.createDataFrame(rows, "id long, path string, text string")
    got = sorted(((r["id"], r["license"], r["found"], r["source"]) for r in licenses.scan_licenses(files).collect()), key=str)
    assert got == brute_licenses(rows, licenses.TEMPLATES, licenses.LEAST)
    assert (3, "GPL-3.0", "inherited", "a/COPYING.txt") in got and (13, "CC-BY-NC-4.0", "header", "a/b/l.c") in got
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_licenses_however_lines_are_wrapped(spark):
    import textwrap
    mpl = licenses.TEMPLATES["MPL-2.0"][0] + " If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    code = "\n".join(f"value{k} = compute(value{k + 1}, other{k % 7}, flag{k % 3})" for k in range(40))
    notices = [("MPL-2.0", mpl)] + [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    rows, want = [], {}
    for k, (name, t) in enumerate(notices):
        for width in (40, 60, 70, 80, 10**6):
            comment = "\n".join(f"# {x}" for x in textwrap.wrap(t, width, break_on_hyphens=False))
            want[len(rows)] = name
            rows.append((len(rows), f"d/{k}_{width}.py", f"{code}\n{comment}\n{code}"))
        want[len(rows)] = name
        rows.append((len(rows), f"d/{k}_long.py", " ".join([code.replace("\n", " "), t, code.replace("\n", " ")])))
    rows.append((len(rows), "e/none.py", "A copyright notice and some redistribution of values, licensed or not.\n" + code))
    got = {r["id"]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {**want, len(rows) - 1: None}


def test_urls_without_a_path(spark):
    urls = ["http://example.com", "http://www.example.com?x=/a", "http://example.com#f", "http://example.com/a/b", "http://example.org", "no url"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame([("example.com", "", "block"), ("example.com", "/a/", "allow"), ("org", "/", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: (r["judged"]["rule"], r["judged"]["verdict"]) for r in urlrules.judge_urls(pages, rules).collect()}
    host_only = ("example.com", "block")
    assert got == {0: host_only, 1: host_only, 2: host_only, 3: ("example.com/a/", "allow"), 4: (None, "allow"), 5: (None, "allow")}
