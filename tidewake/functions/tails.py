"""Tail probabilities as vectorised UDFs (Spark ships none)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(min(max(x, 0.0), 1.0))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + step * d if abs(1.0 + step * d) > tiny else tiny)
        c = 1.0 + step / c if abs(1.0 + step / c) > tiny else tiny
        f *= c * d
        if i and abs(c * d - 1) < 1e-14:
            break
    return front * (f - 1.0)


def t_tail(t: float, df: float) -> float:
    """P(|T| >= |t|) with df degrees of freedom."""
    if not (math.isfinite(t) and df > 0):
        return 0.0 if df > 0 and math.isinf(t) else math.nan
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def hypergeometric_tail(k: int, drawn: int, marked: int, total: int) -> float:
    """P(X >= k) for X marked items among `drawn` of `total`."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    low, high = max(k, drawn + marked - total, 0), min(drawn, marked)
    if low > high:
        return 0.0
    # from the greatest term both ways by ratios of neighbours, in blocks, until terms no longer count
    top = min(max(low, (drawn + 1) * (marked + 1) // (total + 2)), high)
    first = choose(marked, top) + choose(total - marked, drawn - top) - choose(total, drawn)
    out = 1.0
    for step, end in ((1, high), (-1, low)):
        at, term = top, 1.0
        while at != end and term > 1e-17:
            i = at + step * np.arange(min(abs(end - at), 1 << 12))
            up = (marked - i) * (drawn - i) / ((i + 1.0) * (total - marked - drawn + i + 1.0)) if step > 0 else i * (total - marked - drawn + i) / ((marked - i + 1.0) * (drawn - i + 1.0))
            terms = term * np.cumprod(up)
            out += float(terms.sum())
            at, term = at + step * len(i), float(terms[-1])
    return min(1.0, math.exp(first) * out)


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if np.isnan(a) or np.isnan(b) or b <= 0 else t_tail(a, b) for a, b in zip(t.astype(float), df.astype(float))])


@F.pandas_udf(DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series([None if np.isnan(v) else math.erfc(abs(v) / math.sqrt(2)) for v in z.astype(float)])


@F.pandas_udf(DoubleType())
def _fisher_greater(both: pd.Series, a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_tail(int(k), int(x), int(y), int(t)) for k, x, y, t in zip(both, a, b, n)])


@F.pandas_udf(DoubleType())
def _normal_above(z: pd.Series) -> pd.Series:
    return pd.Series([None if np.isnan(v) else math.erfc(v / math.sqrt(2)) / 2 for v in z.astype(float)])


def t_two_sided(t: Column, df: Column) -> Column:
    return _t_two_sided(t, df)


def normal_two_sided(z: Column) -> Column:
    return _normal_two_sided(z)


def normal_above(z: Column) -> Column:
    """P(Z >= z)."""
    return _normal_above(z)


def fisher_greater(both: Column, a: Column, b: Column, n: Column) -> Column:
    """One-sided Fisher p of seeing `both` or more in the overlap of sets of a and b among n."""
    return _fisher_greater(both, a, b, n)
