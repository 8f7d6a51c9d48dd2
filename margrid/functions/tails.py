"""Upper tails of the chi-square, F, t and normal laws for already aggregated statistics.

Each is a pandas UDF over a handful of result rows; the table-sized work is done before it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a+1, continued fraction above."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * scale)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return scale * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or _TINY)
    h = d
    for m in range(1, 10_000):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for step in (even, odd):
            d = 1.0 / (1.0 + step * d or _TINY)
            c = 1.0 + step / c or _TINY
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _chi2(stat: float, dof: float) -> float:
    if pd.isna(stat) or pd.isna(dof) or dof <= 0:
        return float("nan")
    return _gamma_q(dof / 2.0, stat / 2.0)


def _f(stat: float, d1: float, d2: float) -> float:
    if any(pd.isna(v) for v in (stat, d1, d2)):
        return float("nan")
    if stat <= 0:
        return 1.0
    return _beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * stat))


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_chi2(float(s), float(d)) for s, d in zip(stat, dof)])


@F.pandas_udf(T.DoubleType())
def f_sf(stat: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([_f(float(s), float(a), float(b)) for s, a, b in zip(stat, d1, d2)])


@F.pandas_udf(T.DoubleType())
def t_two_sided(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_f(float(s) ** 2, 1.0, float(d)) for s, d in zip(stat, dof)])


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(float(v)) / math.sqrt(2.0)))
