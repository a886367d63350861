"""Tail probabilities for test statistics, applied to aggregated rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete beta continued fraction."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 1000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b)
        - math.lgamma(a)
        - math.lgamma(b)
        + a * math.log(x)
        + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_tail(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or math.isnan(t) or not dof or dof <= 0:
        return float("nan")
    return incomplete_beta(dof / 2.0, 0.5, dof / (dof + t * t))


def chi_square_tail(x: float, dof: float) -> float:
    """Upper tail of the chi-square distribution for whole ``dof``."""
    if x is None or math.isnan(x) or dof <= 0:
        return float("nan")
    half = x / 2.0
    odd = int(dof) % 2 == 1
    # Q(s+1) = Q(s) + half**s e**-half / Gamma(s+1), from Q(1/2) or Q(1).
    tail = math.erfc(math.sqrt(half)) if odd else math.exp(-half)
    s = 0.5 if odd else 1.0
    while s < dof / 2.0:
        if half > 0:
            tail += math.exp(s * math.log(half) - half - math.lgamma(s + 1.0))
        s += 1.0
    return tail


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) for a, b in zip(t, dof)])


@F.pandas_udf(T.DoubleType())
def chi_square_p_value(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi_square_tail(a, b) for a, b in zip(x, dof)])
