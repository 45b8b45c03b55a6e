"""Text and nested-record columns: chunks, templates, weakness labels, id extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtally.schema import CWE_LABELS

# Chunk length and overlap in tokens, and characters per token.
CHUNK_TOKENS = 512
OVERLAP_TOKENS = 64
CHARS_PER_TOKEN = 4
# Fixed value: identifier pattern.
CVE_PATTERN = r"CVE-\d{4}-\d+"
CONTEXT_JOIN = "\n\n---\n\n"
TRACE_JOIN = " → "

_BLANKS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def ws_trim(text: Column) -> Column:
    """Strip any white space at both ends (``trim`` strips blanks only)."""
    return F.regexp_replace(text, rf"\A{_BLANKS}+|{_BLANKS}+\z", "")


def _trimmed(piece: Column) -> Column:
    """``ws_trim`` of the pieces that need it: looking at both ends is much cheaper than a search through the piece."""
    ends = F.concat(F.substring(piece, 1, 1), F.substring(piece, -1, 1))
    return F.when(ends.rlike(_BLANKS), ws_trim(piece)).otherwise(piece)


def chunks(text: Column, chunk_tokens: int = CHUNK_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """Overlapping pieces of the whole text, trimmed, blank pieces left out."""
    size, step = chunk_tokens * CHARS_PER_TOKEN, (chunk_tokens - overlap_tokens) * CHARS_PER_TOKEN
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    pieces = F.transform(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size))), _trimmed)
    return F.filter(pieces, lambda p: p != "")


def explode_chunks(df: DataFrame, text: str, id_col: str, prefix_sep: str = "_chunk") -> DataFrame:
    """One row per chunk with its number and a stable id; all other columns are kept."""
    return df.select(
        *[c for c in df.columns if c != text],
        F.posexplode(chunks(F.col(text))).alias("chunk_no", "document"),
    ).withColumn("id", F.concat(F.col(id_col).cast("string"), F.lit(prefix_sep), F.col("chunk_no").cast("string")))


def english(descriptions: Column, default: str) -> Column:
    """First English entry of a list of ``{lang, value}``."""
    found = F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))["value"]
    return F.coalesce(found, F.lit(default))


def cvss(metrics: Column) -> Column:
    """``cvssData`` of the first entry of the newest non-empty score list."""
    def first(name: str) -> Column:
        return F.when(F.size(metrics[name]) > 0, F.get(metrics[name], F.lit(0)))
    return F.coalesce(*[first(n) for n in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])["cvssData"]


def weakness_values(weaknesses: Column, english_only: bool) -> Column:
    """All weakness names in document order, as one flat list without nulls."""
    def names(w: Column) -> Column:
        kept = F.filter(w["description"], lambda d: d["lang"] == "en") if english_only else w["description"]
        return F.coalesce(F.transform(kept, lambda d: d["value"]), F.array().cast("array<string>"))
    return F.coalesce(F.flatten(F.transform(weaknesses, names)), F.array().cast("array<string>"))


def primary_cwe(weaknesses: Column) -> Column:
    """First listed weakness that is one of the named labels, else OTHER."""
    known = F.array(*[F.lit(c) for c in CWE_LABELS if c != "OTHER"])
    hits = F.filter(weakness_values(weaknesses, english_only=False), lambda c: F.array_contains(known, c) | (c == "OTHER"))
    return F.coalesce(F.get(F.filter(hits, lambda c: c != "OTHER"), F.lit(0)), F.lit("OTHER"))


def cwe_id(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in CWE_LABELS]), name) - 1).cast("int")


def score_text(score: Column) -> Column:
    """A score the way it prints in a text line: 10.0, 7.5."""
    return score.cast("double").cast("string")


def lines(*parts: Column) -> Column:
    """Join the parts that are not null with line breaks."""
    return F.concat_ws("\n", *parts)


def cve_ids(text: Column) -> Column:
    """All identifiers in a text in order of first occurrence, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CVE_PATTERN), F.lit(0)))


def words(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def padded_tokens(tokens: Column, length: int = 256, pad: str = "[PAD]") -> tuple[Column, Column]:
    """Tokens cut or padded to ``length`` and the matching 1/0 mask."""
    kept = F.slice(tokens, 1, length)
    gap = F.lit(length) - F.size(kept)
    ids = F.concat(kept, F.array_repeat(F.lit(pad), gap))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), gap))
    return ids, mask


def encode_tokens(df: DataFrame, text: str, length: int = 256,
                  tokenizer: Callable[[Column], Column] = words) -> DataFrame:
    """Add ``tokens`` and ``attention_mask``. The tokenizer is any column function from text to
    a list of tokens: the built-in one, or a vectorised UDF around a tokenizer of choice."""
    ready = df.withColumn("_tokens", tokenizer(F.col(text)))
    tokens, mask = padded_tokens(F.col("_tokens"), length)
    return ready.withColumns({"tokens": tokens, "attention_mask": mask}).drop("_tokens")
