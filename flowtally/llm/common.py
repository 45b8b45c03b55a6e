"""Helpers the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words, as a class of single bytes: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def fixed_hash(*cols: Column, bits: int = 60) -> Column:
    """A non-negative hash of the columns that other SQL engines compute alike (md5, first ``bits`` bits).
    Nulls count as the empty string with a mark of their own."""
    parts = [F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), c.cast("string"))) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, bits // 4), 16, 10).cast("long")


def row_key(id_col: Column, text: Column) -> Column:
    """Names a document by its id and text: rows that agree in both are one document given twice."""
    return F.xxhash64(id_col, text, F.lit(7))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name like ``stem`` that ``df`` does not have, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def word_array(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
