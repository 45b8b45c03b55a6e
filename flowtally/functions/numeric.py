"""Null-aware numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_least(x: Column, floor: float) -> Column:
    """Clip from below; null stays null (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(floor))))


def is_finite(x: Column) -> Column:
    """False or null for null, NaN (which sorts above infinity) and both infinities."""
    return F.abs(x) < F.lit(float("inf"))


def finite_or_null(x: Column) -> Column:
    """Fold NaN and both infinities to null."""
    return F.when(is_finite(x), x)


def finite_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def sigmoid_score(error: Column, threshold: Column | float | None) -> Column:
    """Squash an error against its threshold; the raw error where no threshold is set."""
    if threshold is None:
        return error
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return F.when(t > 0, 1.0 / (1.0 + F.exp(-(error / t - 1.0)))).otherwise(error)


def mixed_hash(key: Column, seed: int) -> Column:
    """A fixed integer mix of a whole-number key, in [0, 2^32).

    Odd multipliers and shifted xors make it a bijection on keys below 2^31. Longer keys are
    folded to 31 bits first, so no product leaves BIGINT; ties go to the key itself.
    """
    k = key.cast("bigint")
    folded = F.pmod(k.bitwiseXOR(F.shiftright(k, 31)), F.lit(2147483648))
    h = F.pmod(folded.bitwiseXOR(F.lit(seed_bits(seed))) * F.lit(2654435761), F.lit(4294967296))
    return F.pmod(h.bitwiseXOR(F.shiftright(h, 15)) * F.lit(1597334677), F.lit(4294967296))


def seed_bits(seed: int) -> int:
    """31 bits that the seed flips in every key."""
    return seed * 1103515245 % 2147483648
