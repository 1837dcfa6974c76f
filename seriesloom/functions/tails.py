"""Tail probabilities as vectorised UDFs over already-aggregated rows.

Spark has no erf / gamma / beta functions. Each UDF sees one row per series, so
the work here is tiny; the heavy statistic stays in native aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma: series below a+1, fraction above."""
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
    b, c = x + 1 - a, 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / (1 + num * d or _TINY)
        c = 1 + num / c or _TINY
        h *= d * c
        num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or _TINY)
        c = 1 + num / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def normal_two_sided_value(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def t_two_sided_value(t: float, df: float) -> float:
    return _beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_sf_value(x: float, df: float) -> float:
    return _gamma_q(df / 2, x / 2)


def t_quantile_value(p: float, df: float) -> float:
    """Inverse t by bisection on the two-sided tail (monotone, no derivatives)."""
    if not 0 < p < 1 or df <= 0:
        return math.nan
    if p == 0.5:
        return 0.0
    target = 2 * min(p, 1 - p)
    lo, hi = 0.0, 1.0
    while t_two_sided_value(hi, df) > target:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided_value(mid, df) > target else (lo, mid)
        if hi - lo < 1e-14 * max(1.0, hi):
            break
    return math.copysign((lo + hi) / 2, p - 0.5)


def normal_quantile_value(p: float) -> float:
    lo, hi = 0.0, 40.0
    target = 2 * min(p, 1 - p)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_two_sided_value(mid) > target else (lo, mid)
    return math.copysign((lo + hi) / 2, p - 0.5)


def _rowwise(fn, *columns: pd.Series) -> pd.Series:
    vals = [np.asarray(c, dtype=float) for c in columns]
    return pd.Series([
        fn(*row) if all(math.isfinite(v) for v in row) else None for row in zip(*vals)
    ], dtype="float64")


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return _rowwise(normal_two_sided_value, z)


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_two_sided_value, t, df)


@pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(chi2_sf_value, x, df)


@pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    # a bisection takes milliseconds and a column holds few different pairs
    known: dict[tuple[float, float], float] = {}

    def once(a: float, b: float) -> float:
        if (a, b) not in known:
            known[a, b] = t_quantile_value(a, b)
        return known[a, b]

    return _rowwise(once, p, df)


def kendall_tail_value(n: float, c: float) -> float:
    """Exact two-sided tail of rank correlation from the distribution of ``c`` discordant pairs among ``n`` untied values."""
    n, c = int(n), int(c)
    if c * 2 == n * (n - 1) // 2:
        return 1.0
    counts = np.zeros(c + 1)
    counts[0] = 1.0
    for k in range(2, n + 1):
        acc = np.cumsum(counts)
        acc[k:] -= np.cumsum(counts)[:-k] if c >= k else 0.0
        counts = acc / k
    return float(min(1.0, 2 * counts.sum()))


@pandas_udf(DoubleType())
def kendall_tail(n: pd.Series, c: pd.Series) -> pd.Series:
    # evaluated beside a condition, also for rows it is not meant for
    return _rowwise(lambda a, b: kendall_tail_value(a, b) if a <= 64 else float("nan"), n, c)
