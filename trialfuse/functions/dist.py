"""Tails and quantiles of t, F and normal distributions: numpy on arrays, and columns of them inside the plan."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_GAMMA = np.vectorize(math.lgamma, otypes=[float])


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, by the modified Lentz recurrence."""
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 2000):
        for even in (True, False):
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 + k * d
            c = 1 + k / c
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h *= d * c
        if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
            break
    return h


def beta_cdf(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function; NaN where an argument is missing."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    a, b, y = np.where(ok, a, 1.0), np.where(ok, b, 1.0), np.where(ok, x, 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_GAMMA(a + b) - _GAMMA(a) - _GAMMA(b) + a * np.log(y) + b * np.log1p(-y))
    low = y < (a + 1) / (a + b + 2)
    inside = np.clip(np.where(low, y, 1 - y), _TINY, 1 - 1e-16)
    part = front * _fraction(np.where(low, a, b), np.where(low, b, a), inside) / np.where(low, a, b)
    out = np.where(low, part, 1 - part)
    return np.where(ok, np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, out)), np.nan)


def t_sf2(t, df) -> np.ndarray:
    """Two-sided p-value."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def t_ppf(q: float, df) -> np.ndarray:
    """Quantile above one half, by bisection."""
    df = np.asarray(df, float)
    lo, hi = np.zeros(df.shape), np.full(df.shape, 1.0)
    tail = 2 * (1 - q)
    for _ in range(1100):
        grow = t_sf2(hi, df) > tail
        if not grow.any():
            break
        hi = np.where(grow, hi * 2, hi)
    for _ in range(120):
        mid = (lo + hi) / 2
        right = t_sf2(mid, df) > tail
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
    return np.where(df > 0, (lo + hi) / 2, np.nan)


def norm_sf2(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf2(t, df))


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f, d1, d2))


@F.pandas_udf(T.DoubleType())
def _t_quantile(q: pd.Series, df: pd.Series) -> pd.Series:
    at = {v: float(t_ppf(float(q.iloc[0]), v)) for v in set(df.dropna())} if len(q) else {}
    return df.map(at).astype(float)


def _or_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def with_t_quantile(df: DataFrame, n: str, q: float = 0.975, name: str = "t_crit") -> DataFrame:
    """name: the t quantile with n - 1 degrees of freedom, null for n < 2; made where the result's rows are."""
    return df.withColumn(name, _or_null(_t_quantile(F.lit(q), F.when(F.col(n) > 1, F.col(n) - 1).cast("double"))))


def with_p_values(df: DataFrame, kind: str, stat: str, df1: str, df2: str | None = None, name: str = "p_value") -> DataFrame:
    """name: p-value of each row of a result table (kind t: two-sided; kind f); null where an argument is. One pass, nothing is collected."""
    d = lambda c: F.col(c).cast("double")
    return df.withColumn(name, _or_null(_t_tail(d(stat), d(df1)) if kind == "t" else _f_tail(d(stat), d(df1), d(df2))))


def jarque_bera_p(n: Column, skew: Column, excess_kurtosis: Column) -> Column:
    """Upper tail of chi-squared with two degrees of freedom at n/6 (s**2 + k**2/4)."""
    jb = n / 6.0 * (skew * skew + excess_kurtosis * excess_kurtosis / 4.0)
    return F.exp(-jb / 2.0)
