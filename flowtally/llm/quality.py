"""Quality rules as a cascade: rules run in the order of rejection per cost, as measured on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.llm.common import BLANKS, WORD, free_name, word_array

SYMBOLS = "#*$%&|<>"
SPAN = 8
#: Rows that the order of the rules is estimated on. It has no part in any verdict.
SAMPLE_ROWS = 500


@dataclass(frozen=True)
class Rule:
    """``reject`` is an SQL condition on the columns ``needs`` of :func:`with_statistics`."""
    name: str
    reject: str
    needs: tuple[str, ...]


BASE_RULES = (
    Rule("few_words", "n_words < 20", ("n_words",)),
    Rule("repeated_spans", "100 * n_repeat_words > 30 * n_words", ("n_words", "n_repeat_words")),
)
VERDICT_RULES = (
    Rule("symbols", "10 * n_symbols > n_words", ("n_words", "n_symbols")),
    Rule("short_or_long_words", "word_chars < 2 * n_words OR word_chars > 20 * n_words", ("n_words", "word_chars")),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", ("n_lines", "n_dup_lines")),
)
RULES = BASE_RULES + VERDICT_RULES
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def with_statistics(docs: DataFrame, text_col: str, wanted: tuple[str, ...] = STATISTICS, into: str = "stats") -> DataFrame:
    """``docs`` with a struct column ``into`` of the wanted statistics of each whole text (null: empty).

    n_repeat_words counts the words inside windows of eight words that the text holds twice or more: the
    windows' hashes are sorted with their places, equal neighbours mark the repeated places, and their
    distances give the words covered. Everything stays in the row, in n log n steps for n words; a window is
    compared by a 64-bit hash within its own text. Each array that a lambda looks into is exploded from an
    array of one, so that no optimizer rule puts its expression into the lambda: it is built once for a row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    stats, out = [], docs
    names = {}

    def add(stem: str, expr) -> None:
        nonlocal out
        names[stem] = free_name(out, stem)
        out = out.select("*", F.explode(F.array(expr)).alias(names[stem]))

    def col(stem: str) -> Column:
        return F.col(names[stem])

    if "n_words" in wanted or "n_repeat_words" in wanted:
        if "n_repeat_words" in wanted:
            add("q_words", F.transform(word_array(F.col(text_col)), lambda w: F.xxhash64(w)))
            stats.append(F.size(col("q_words")).cast("long").alias("n_words"))
            add("q_spans", F.slice(F.transform(col("q_words"), lambda w, i: F.xxhash64(F.slice(col("q_words"), i + 1, SPAN))), F.lit(1), F.greatest(F.size(col("q_words")) - (SPAN - 1), F.lit(0))))
            placed = F.sort_array(F.transform(col("q_spans"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
            add("q_sorted", F.when(F.size(F.array_distinct(col("q_spans"))) < F.size(col("q_spans")), placed).otherwise(F.slice(placed, 1, 0)))
            add("q_twice", F.sort_array(F.transform(F.filter(col("q_sorted"), lambda x, i: F.coalesce(F.get(col("q_sorted"), i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(col("q_sorted"), i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
            covered = F.transform(col("q_twice"), lambda p, i: F.least(F.lit(SPAN), F.coalesce(F.get(col("q_twice"), i + 1) - p, F.lit(SPAN))))
            stats.append(F.aggregate(covered, F.lit(0).cast("long"), lambda n, x: n + x).alias("n_repeat_words"))
        else:
            stats.append(F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    if "word_chars" in wanted:
        stats.append(F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"))
    if "n_symbols" in wanted:
        stats.append((F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    if "n_lines" in wanted or "n_dup_lines" in wanted:
        add("q_lines", _lines(F.col(text_col)))
        stats.append(F.size(col("q_lines")).cast("long").alias("n_lines"))
        if "n_dup_lines" in wanted:
            stats.append((F.size(col("q_lines")) - F.size(F.array_distinct(col("q_lines")))).cast("long").alias("n_dup_lines"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.struct(*stats).alias(into))


def rule_order(docs: DataFrame, text_col: str, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """The rules by rejections per second, best first, each with its rejected share and its seconds on a
    sample of ``sample_rows`` rows. The order decides what is computed first and never what is kept."""
    sample = docs.select(F.col(text_col).alias("text")).limit(sample_rows).repartition(1).persist()
    found = []
    try:
        n = max(1, sample.count())
        for rule in rules:
            began = time.perf_counter()
            hits = with_statistics(sample, "text", rule.needs).select(F.expr(_on("stats", rule.reject)).alias("r")).where("r").count()
            found.append((rule, hits / n, max(1e-6, time.perf_counter() - began)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda x: (-x[1] / x[2], x[0].name))


def _on(struct: str, condition: str) -> str:
    for n in STATISTICS:
        condition = condition.replace(n, f"`{struct}`.{n}")
    return condition


def judge_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = VERDICT_RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``docs`` with a struct column ``quality``: all statistics, base_failed, rejected_by (the first rule of the
    cascade that rejects, or null) and kept. Null texts count as empty and fail; an empty table stays empty.
    Clashing column names get an underscore at the end."""
    ranked = [r for r, _, _ in rule_order(docs, text_col, rules)]
    stats, judged = free_name(docs, "stats"), free_name(docs, "quality")
    out = with_statistics(docs, text_col, into=stats)
    failed = F.lit(False)
    for r in base:
        failed = failed | F.expr(_on(stats, r.reject))
    chain = F.when(failed, F.lit("base"))
    for r in ranked:
        chain = chain.when(F.expr(_on(stats, r.reject)), F.lit(r.name))
    why = free_name(out, "why")
    out = out.withColumn(why, chain)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns],
                      F.struct(f"{stats}.*", failed.alias("base_failed"), F.col(why).alias("rejected_by"), F.col(why).isNull().alias("kept")).alias(judged))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns as they are. Each rule is a filter of its own behind
    the one before, over the statistics it needs, so a rejected row never reaches the dearer rules."""
    out = docs
    for rule, _, _ in rule_order(docs, text_col, rules):
        name = free_name(docs, "stats")
        out = with_statistics(out, text_col, rule.needs, name).where(F.expr(_on(name, rule.reject)) == F.lit(False)).drop(name)
    return out
