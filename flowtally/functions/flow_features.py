"""Derived flow features as one projection."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from flowtally.functions.numeric import at_least, finite_or_zero
from flowtally.schema import ENGINEERED, FEATURES


def _definitions(have: set[str]) -> dict[str, Column]:
    """The feature expressions that the columns at hand allow, in model order."""
    c = F.col
    packets = c("total_fwd_packets") + c("total_bwd_packets")
    size = c("total_len_fwd_packets") + c("total_len_bwd_packets")
    seconds = c("flow_duration") / 1e6
    out = {
        "pkt_asymmetry": (c("total_fwd_packets") - c("total_bwd_packets")) / at_least(packets, 1),
        "byte_asymmetry": (c("total_len_fwd_packets") - c("total_len_bwd_packets")) / at_least(size, 1),
        "overall_avg_pkt_size": size / at_least(packets, 1),
        "flow_duration_s": seconds,
        "total_pkts_per_s": packets / at_least(seconds, 1e-9),
    }
    for flag in ("syn", "fin", "rst", "ack"):
        name = f"{flag}_flag_count"
        if name in have:
            out[f"{name}_ratio"] = c(name) / at_least(packets, 1)
    if {"flow_iat_mean", "flow_iat_std"} <= have:
        out["iat_cv"] = c("flow_iat_std") / at_least(c("flow_iat_mean"), 1e-9)
    if {"fwd_header_len", "total_len_fwd_packets"} <= have:
        out["fwd_header_ratio"] = c("fwd_header_len") / at_least(c("total_len_fwd_packets"), 1)
    return out


def add_flow_features(df: DataFrame) -> DataFrame:
    """Add the derived columns; null, NaN and infinity become 0 in every feature. Other columns,
    the label among them, keep their nulls."""
    wide = df.withColumns(_definitions(set(df.columns)))
    fills = {}
    wanted = {*FEATURES, *ENGINEERED}
    for f in wide.schema.fields:
        if f.name not in wanted:
            continue
        if f.dataType.typeName() in ("double", "float"):
            fills[f.name] = finite_or_zero(F.col(f.name)).cast(f.dataType)
        elif isinstance(f.dataType, NumericType):
            fills[f.name] = F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType))
    return wide.withColumns(fills)


def model_features(columns: list[str]) -> list[str]:
    """Base features then derived ones, those present only, in fixed order."""
    return [c for c in FEATURES if c in columns] + [c for c in ENGINEERED if c in columns]


def feature_matrix(df: DataFrame, out: str = "features") -> tuple[DataFrame, list[str]]:
    """Add the model vector (values cut to single precision) and return the name list."""
    wide = add_flow_features(df)
    names = model_features(wide.columns)
    single = wide.withColumns({f"_f_{n}": F.col(n).cast("float").cast("double") for n in names})
    vec = VectorAssembler(inputCols=[f"_f_{n}" for n in names], outputCol=out, handleInvalid="keep").transform(single)
    return vec.drop(*[f"_f_{n}" for n in names]), names
