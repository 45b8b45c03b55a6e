"""SQL twins of the package's queries, for DuckDB."""

from flowtally.llm import licenses

_WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op4_source_mix": rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(chr(31), 'v0', coalesce('v' || doc_id, 'n'), coalesce('v' || source, 'n'), coalesce('v' || text, 'n'))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
p AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS w FROM s),
q AS (SELECT *, 1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER f, 0) AS rest,
             sum(w) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_over
      FROM p WINDOW f AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, 2 * n * left_over > rest * w AS is_open FROM q),
t AS (SELECT source, n, CASE WHEN is_open THEN w * max(CASE WHEN is_open THEN rest END) OVER () / max(CASE WHEN is_open THEN left_over END) OVER ()
                        ELSE 2 * n END AS target FROM o),
c AS (SELECT d.*, t.n, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS reach,
             sum(size) OVER (PARTITION BY d.source, h) AS own
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n::BIGINT AS source_size, target,
       (size * (CASE WHEN target >= n OR reach <= least(n, target) OR (reach - own <= least(n, target) AND reach - least(n, target) < least(n, target) - (reach - own)) THEN 1 ELSE 0 END
              + CASE WHEN target - n >= n OR target > n AND (reach <= target - n OR (reach - own <= target - n AND reach - (target - n) < (target - n) - (reach - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c""",
    "op6_quality_rules": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, regexp_extract_all(x, '{_WORD}') AS ws FROM t),
g AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS span FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
n AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, span) AS c FROM g) WHERE c > 1),
k AS (SELECT r, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM n) GROUP BY r),
l AS (SELECT r, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '{_WORD}')) AS ls FROM w),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w JOIN l USING (r) LEFT JOIN k USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM s""",
    "op10_url_filter": r"""
WITH r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
b AS (SELECT n, max({'a': length(h || p), 'b': length(h), 'c': h || p, 'd': v}) AS m
      FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, m.c AS rule, coalesce(m.d, 'allow') AS verdict FROM u LEFT JOIN b USING (n)""",
    "op1_topk_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= 5""",
    "op3_line_dedup": rf"""
WITH t AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
r AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM t),
w AS (SELECT *, len(regexp_extract_all(line, '{_WORD}')) AS words FROM r),
l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, sum(words) OVER (PARTITION BY doc_id ORDER BY p) AS upto FROM w WHERE words > 0),
f AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 7 AND b.upto - a.upto + a.words >= 8 GROUP BY ALL),
g AS (SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 7 AND b.i AND b.upto - a.upto + a.words >= 8 GROUP BY ALL),
u AS (SELECT doc_id, s, e FROM f UNION SELECT doc_id, s, e FROM g),
x AS (SELECT u.doc_id, s, e, string_agg(line, chr(10) ORDER BY i) AS run FROM u JOIN l ON l.doc_id = u.doc_id AND l.i BETWEEN s AND e GROUP BY ALL),
y AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM x) WHERE k > 1),
z AS (SELECT DISTINCT l.doc_id, l.p FROM y JOIN l ON l.doc_id = y.doc_id AND l.i BETWEEN s AND e),
o AS (SELECT w.doc_id, string_agg(line, chr(10) ORDER BY w.p) FILTER (WHERE z.p IS NULL) AS clean, count(*) FILTER (WHERE words > 0)::INTEGER AS n_lines, count(z.p)::INTEGER AS n_removed
      FROM w LEFT JOIN z ON w.doc_id = z.doc_id AND w.p = z.p GROUP BY w.doc_id)
SELECT doc_id, CASE WHEN n_removed > 0 THEN coalesce(clean, '') ELSE text END AS text, n_lines, n_removed FROM t JOIN o USING (doc_id)""",
    "op7_ngram_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
h AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT h.a, h.b FROM h JOIN n p ON p.doc_id = h.a JOIN n q ON q.doc_id = h.b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
c AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, min(c.b)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id GROUP BY w.doc_id""",
    "op9_span_dedup": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*|[.!?\n]+') AS ps FROM documents),
r AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS p, unnest(ps) AS piece FROM t),
w AS (SELECT *, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM r),
l AS (SELECT doc_id, p, len(ws) AS words, array_to_string(ws, ' ') AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY p) AS upto
      FROM w WHERE len(ws) > 0),
f AS (SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 19 AND b.upto - a.upto + a.words >= 20 GROUP BY ALL),
g AS (SELECT b.doc_id, max(a.i) AS s, b.i AS e FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.i BETWEEN b.i - 19 AND b.i AND b.upto - a.upto + a.words >= 20 GROUP BY ALL),
u AS (SELECT doc_id, s, e FROM f UNION SELECT doc_id, s, e FROM g),
x AS (SELECT u.doc_id, s, e, string_agg(norm, chr(10) ORDER BY i) AS run FROM u JOIN l ON l.doc_id = u.doc_id AND l.i BETWEEN s AND e GROUP BY ALL),
y AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY run ORDER BY doc_id, s) AS k FROM x) WHERE k > 1),
z AS (SELECT DISTINCT l.doc_id, l.p FROM y JOIN l ON l.doc_id = y.doc_id AND l.i BETWEEN s AND e),
o AS (SELECT w.doc_id, string_agg(piece, '' ORDER BY w.p) FILTER (WHERE z.p IS NULL) AS clean, count(*) FILTER (WHERE len(ws) > 0) AS n, count(z.p) AS gone
      FROM w LEFT JOIN z ON w.doc_id = z.doc_id AND w.p = z.p GROUP BY w.doc_id)
SELECT doc_id, CASE WHEN gone > 0 THEN coalesce(clean, '') ELSE x END AS text, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(gone, 0)::BIGINT AS n_removed
FROM t LEFT JOIN o USING (doc_id)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE z AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
v AS (SELECT doc_id, source, text, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
             coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
             xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) % 5 = 0 AS hit
      FROM documents, z),
l AS (SELECT *, row_number() OVER () AS r, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
             CASE WHEN hit THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other,
             dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS sid FROM v),
p AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY sid) AS n FROM l),
up AS (SELECT sid, 0 AS lvl, pos AS i, leaf AS d, n FROM p
       UNION ALL SELECT sid, lvl + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY sid, lvl, i // 16, n),
sr AS (SELECT sid, d, lvl AS height FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, sid AS i, d, (SELECT count(*) FROM sr) AS n FROM sr
        UNION ALL SELECT lvl + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY lvl, i // 16, n),
root AS (SELECT d AS root FROM top WHERE n = 1),
s AS (SELECT sid, lvl, i, coalesce(string_agg(d, '') OVER (PARTITION BY sid, lvl, i // 16 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
             coalesce(string_agg(d, '') OVER (PARTITION BY sid, lvl, i // 16 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
      FROM (SELECT sid, lvl, i, d FROM up WHERE n > 1 UNION ALL SELECT -1, lvl, i, d FROM top WHERE n > 1)),
path AS (SELECT r, s.lvl AS step, lft, rgt FROM p JOIN s ON s.sid = p.sid AND s.i = p.pos >> (4 * s.lvl)
         UNION ALL SELECT r, sr.height + s.lvl, lft, rgt FROM p JOIN sr USING (sid) JOIN s ON s.sid = -1 AND s.i = p.sid >> (4 * s.lvl)),
fold AS (SELECT r, 0 AS step, coalesce(other, leaf) AS cur FROM p
         UNION ALL SELECT r, step + 1, sha256(lft || cur || rgt) FROM fold JOIN path USING (r, step)),
e AS (SELECT r, arg_max(cur, step) AS folded_root FROM fold GROUP BY r),
q AS (SELECT r, sha256(string_agg(lft || rgt, '' ORDER BY step)) AS proof FROM path GROUP BY r)
SELECT doc_id, leaf, sr.d AS subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN sr USING (sid) JOIN e USING (r) LEFT JOIN q USING (r), root""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = o.lang AND c.source = o.source), 0)::HUGEINT AS total, coalesce(v, 0) AS v
      FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (total + 5 * v))::BIGINT AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v))::BIGINT AS q
      FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN (SELECT lang, sum(total)::HUGEINT AS total, any_value(v) AS v FROM g GROUP BY lang) USING (lang)),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(s.p - t.p)) FROM p s JOIN p t USING (lang, term) WHERE s.lang = a.lang AND s.source = a.source AND t.source = b.source), 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INTEGER AS rank FROM x) WHERE part = 'pair' OR rank <= 50""",
}


def _license_sql() -> str:
    def terms(text: str) -> str:
        return f"list_filter(string_split_regex(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')"

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    rows = ", ".join(f"({quoted(f'{name}/{i}')}, {quoted(name)}, {quoted(text)})" for name, texts in licenses.TEMPLATES.items() for i, text in enumerate(texts))
    return f"""
WITH p(template, license, text) AS (VALUES {rows}),
f AS (SELECT doc_id AS id, concat_ws('/', source, (doc_id // 1000)::VARCHAR, CASE WHEN doc_id % 97 <> 0 THEN (doc_id // 100)::VARCHAR END,
        CASE WHEN doc_id % 97 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path, coalesce(text, '') AS text FROM documents),
voc AS (SELECT DISTINCT unnest({terms('text')}) AS term FROM p),
held AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({terms('text')})) AS term FROM f) JOIN voc USING (term) GROUP BY term),
n AS (SELECT count(*)::DOUBLE AS n FROM f),
wt AS (SELECT voc.term, ln((1.0 + n) / (1.0 + coalesce(df, 0))) + 1 AS weight FROM voc LEFT JOIN held USING (term), n),
l AS (SELECT id, string_split(text, chr(10)) AS ls FROM f WHERE regexp_matches(text, '{licenses.CUES}')),
s AS (SELECT id, ls, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
u AS (SELECT id, 'header' AS found, i || '/' || h AS unit, array_to_string(list_slice(ls, i, i + h - 1), chr(10)) AS text
      FROM (SELECT *, unnest({list(licenses.HEIGHTS)}) AS h FROM s WHERE regexp_matches(line, '{licenses.CUES}'))
      UNION ALL SELECT id, 'file', 'all', text FROM f WHERE regexp_matches(path, '{licenses.FILE_NAMES}')),
uv AS (SELECT id, found, unit, term, count(*) * coalesce(any_value(weight), (SELECT ln(1.0 + n) + 1 FROM n)) AS v, bool_or(weight IS NOT NULL) AS known
       FROM (SELECT id, found, unit, unnest({terms('text')}) AS term FROM u) LEFT JOIN wt USING (term) GROUP BY ALL),
un AS (SELECT id, found, unit, sqrt(sum(v * v)) AS norm FROM uv GROUP BY ALL),
tv AS (SELECT template, license, term, count(*) * any_value(weight) AS v FROM (SELECT template, license, unnest({terms('text')}) AS term FROM p) JOIN wt USING (term) GROUP BY ALL),
tn AS (SELECT template, sqrt(sum(v * v)) AS norm FROM tv GROUP BY ALL),
sc AS (SELECT uv.id, uv.found, uv.unit, tv.template, tv.license, round(sum(uv.v / un.norm * (tv.v / tn.norm)), 6) AS score
       FROM uv JOIN un USING (id, found, unit) JOIN tv USING (term) JOIN tn USING (template) WHERE known GROUP BY ALL HAVING score >= {licenses.LEAST}),
b AS (SELECT id, min({{'neg': -score, 'license': license, 'found': found}}) AS best FROM sc GROUP BY id),
j AS (SELECT f.id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, best FROM f LEFT JOIN b USING (id)),
h AS (SELECT dir AS above, min({{'neg': best.neg, 'path': path, 'license': best.license}}) AS holder FROM j
      WHERE best IS NOT NULL AND regexp_matches(path, '{licenses.FILE_NAMES}') GROUP BY dir),
c AS (SELECT dir, k, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') AS above
      FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS k FROM (SELECT DISTINCT dir FROM j WHERE best IS NULL))),
g AS (SELECT dir, arg_max(holder, k) AS holder FROM c JOIN h USING (above) GROUP BY dir)
SELECT j.id AS doc_id, path, coalesce(best.license, holder.license) AS license, -coalesce(best.neg, holder.neg) AS score,
       CASE WHEN best IS NOT NULL THEN best.found WHEN holder IS NOT NULL THEN 'inherited' END AS found, CASE WHEN best IS NOT NULL THEN path ELSE holder.path END AS source
FROM j LEFT JOIN g ON best IS NULL AND j.dir = g.dir"""


SQL["op8_license_scan"] = _license_sql()
