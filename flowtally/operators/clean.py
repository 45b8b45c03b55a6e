"""Cleaning of flow tables: renames, casts, labels, null and duplicate removal."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from flowtally.functions.numeric import finite_or_null, is_finite
from flowtally.functions.text import ws_trim
from flowtally.schema import FEATURES, LABEL_GROUPS, LABEL_IDS, RARE_GROUPS, RENAMES

# The dash of a web attack label as the two encodings and common editors leave it.
_DASHES = r"[\x{96}\x{FFFD}\x{2013}\x{2014}]"


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def rename_flow_columns(df: DataFrame) -> DataFrame:
    """Fixed renames; columns without an entry stay. Blanks around a header do not matter."""
    stripped = {raw.strip(): name for raw, name in RENAMES.items()}
    return df.toDF(*[stripped.get(c.strip(), c) for c in df.columns])


def lookup(table: dict, key: Column) -> Column:
    """Literal map lookup; null where there is no entry."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def label_text(label: Column) -> Column:
    return F.regexp_replace(ws_trim(label), _DASHES, "-")


def encode_labels(df: DataFrame, label: str = "label", ids: dict[str, int] = LABEL_IDS,
                  keep_unknown: bool = False) -> DataFrame:
    """``label_str`` (trimmed text) and ``label`` (id, -1 where unknown); unknown rows dropped."""
    out = df.withColumn("label_str", label_text(F.col(label)))
    out = out.withColumn("label", F.coalesce(lookup(ids, F.col("label_str")), F.lit(-1)).cast("int"))
    return out if keep_unknown else out.where("label >= 0")


def unknown_label_audit(df: DataFrame, label: str = "label", ids: dict[str, int] = LABEL_IDS) -> DataFrame:
    """Labels that the encoding drops, with their row counts."""
    coded = encode_labels(df, label, ids, keep_unknown=True).where("label < 0")
    return coded.groupBy("label_str").agg(F.count(F.lit(1)).alias("n"))


def to_number(c: Column) -> Column:
    """Cast to double; text that is not a number gives null, white space around it is allowed."""
    return c.try_cast("double")


def coerce_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = [c for c in (columns or FEATURES) if c in df.columns]
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.withColumns({c: to_number(F.col(c)) if c in text else F.col(c).cast("double") for c in names})


def nullify_infinite(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: finite_or_null(F.col(c)) for c in floats})


def drop_null_features(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=[c for c in FEATURES if c in df.columns])


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def keep_finite(df: DataFrame) -> DataFrame:
    """Rows whose features are all present and finite: what nullifying infinities and dropping
    nulls leaves, as one filter."""
    present = [is_finite(F.col(c)) for c in FEATURES if c in df.columns]
    return df.where(reduce(and_, present)) if present else df


def clean_flows(df: DataFrame) -> DataFrame:
    """Raw flow rows to typed rows with known labels and no gaps; one narrow pass."""
    return keep_finite(coerce_numeric(encode_labels(rename_flow_columns(df))))


def group_labels(df: DataFrame, label: str = "label_str", out: str = "attack_type") -> DataFrame:
    return df.withColumn(out, lookup(LABEL_GROUPS, F.col(label)))


def drop_rare_groups(df: DataFrame, group: str = "attack_type", rare: list[str] = RARE_GROUPS) -> DataFrame:
    return df.where(~F.coalesce(F.col(group).isin(rare), F.lit(False)))


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def feature_types(df: DataFrame, target: str = "attack_type") -> tuple[list[str], list[str]]:
    """Numeric and text columns without the target."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name != target]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name != target]
    return numeric, text


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """One of each set of equal rows. The rows are equal in every column, so any one will do."""
    return df.distinct()


def benign(df: DataFrame) -> DataFrame:
    return df.where("label = 0")


def with_anomaly_truth(df: DataFrame) -> DataFrame:
    return df.withColumn("is_attack", (F.col("label") != 0).cast("int"))
