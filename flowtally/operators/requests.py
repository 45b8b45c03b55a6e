"""Score requests and questions as tables: validation, named vectors, payload parsing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed question length.
QUERY_MIN, QUERY_MAX = 5, 2000

_MAP = "map<string,double>"
_LIST = "array<double>"


def validate_features(features: Column) -> Column:
    """Reason for refusal, or null. An empty map is accepted, a missing one is not."""
    return F.when(features.isNull(), F.lit("features missing"))


def validate_query(query: Column) -> Column:
    return (F.when(query.isNull(), F.lit("query missing"))
            .when(F.length(query) < QUERY_MIN, F.lit("query too short"))
            .when(F.length(query) > QUERY_MAX, F.lit("query too long")))


def split_by_reason(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and refused rows with their reason."""
    judged = df.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def feature_vector(features: Column, names: Sequence[str] | None) -> Column:
    """Values in model order with 0 for absent ones; all values as they come without a name list."""
    if not names:
        return F.map_values(features)
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(n)), F.lit(0.0)) for n in names])


def payload_vector(body: Column, data: Column) -> Column:
    """Vector of a request row: ``body`` else ``data``, as JSON text or bytes, holding
    ``features`` or being them; named values or a plain list."""
    def text(c: Column) -> Column:
        return F.nullif(F.decode(c.cast("binary"), "UTF-8"), F.lit(""))

    raw = F.coalesce(text(body), text(data))
    inner = F.coalesce(F.get_json_object(raw, "$.features"), raw)
    return F.coalesce(F.map_values(F.from_json(F.when(inner.startswith("{"), inner), _MAP)),
                      F.from_json(F.when(inner.startswith("["), inner), _LIST))
