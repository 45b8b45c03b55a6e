"""Tail probabilities for the test statistics. The chi-square and F tails run on one row per feature,
the normal one on whole batches of values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma by series (small x) or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 100000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for coef in (even, odd):
            d = 1 / (1 + coef * d or 1e-300)
            c = 1 + coef / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def _beta_lower(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def _scaled_erfc(x: np.ndarray) -> np.ndarray:
    """exp(x²) erfc(x) for x >= 0, whole arrays at a time: the series of erf for small x, a
    continued fraction from its far end for larger ones."""
    out = np.empty_like(x)
    near = x < 2.5
    y = x[near]
    term = total = y.copy()
    for k in range(1, 60):
        term = term * (2 * y * y) / (2 * k + 1)
        total = total + term
    out[near] = np.exp(y * y) - total * (2 / math.sqrt(math.pi))
    y = x[~near]
    tail = y.copy()
    for k in range(80, 0, -1):
        tail = y + (k / 2) / tail
    out[~near] = 1 / (tail * math.sqrt(math.pi))
    return out


def log_phi(w: np.ndarray) -> np.ndarray:
    """ln of the normal distribution function; nothing underflows, however far the tail."""
    x = np.abs(w) / math.sqrt(2)
    scaled = _scaled_erfc(x)
    return np.where(w < 0, np.log(0.5 * scaled) - x * x, np.log1p(-0.5 * scaled * np.exp(-x * x)))


@F.pandas_udf(DoubleType())
def chi2_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) else _gamma_upper(d / 2, s / 2) for s, d in zip(stat, dof)], dtype="float64")


@F.pandas_udf(DoubleType())
def f_tail(stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) else _beta_lower(m / 2, n / 2, m / (m + n * s))
                      for s, n, m in zip(stat, d1, d2)], dtype="float64")


@F.pandas_udf(DoubleType())
def log_normal_cdf(w: pd.Series) -> pd.Series:
    values = w.to_numpy(dtype="float64", na_value=np.nan)
    return pd.Series(np.where(np.isnan(values), np.nan, log_phi(np.nan_to_num(values, posinf=1e150, neginf=-1e150))))
