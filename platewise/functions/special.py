"""Distribution functions as Arrow-batched UDFs; used on summary rows only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularised incomplete beta by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, steps):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        out = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * h))
    return np.where(swap, 1 - out, out)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    ok = np.isfinite(t) & (df > 0)
    big = df > 1e7
    x = np.where(ok & ~big, df / (df + t * t), 1.0)
    p = np.where(big, _erfc(np.abs(np.where(ok, t, 0.0)) / math.sqrt(2)), beta_inc(np.where(ok & ~big, df / 2, 1.0), 0.5, x))
    return np.where(ok, p, np.where(np.isinf(t), 0.0, np.nan))


def gamma_upper(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.empty(a.shape)
    for i in np.ndindex(a.shape):
        s, z = a[i], x[i]
        if not (s > 0 and z >= 0):
            out[i] = np.nan
            continue
        if z == 0:
            out[i] = 1.0
            continue
        front = math.exp(min(s * math.log(z) - z - math.lgamma(s), 700.0))
        if z < s + 1:
            term = total = 1 / s
            k = s
            while abs(term) > abs(total) * 1e-16:
                k += 1
                term *= z / k
                total += term
            out[i] = 1 - front * total
        else:
            b = z + 1 - s
            c, d = 1e300, 1 / b
            h = d
            for m in range(1, 100_000):
                an = -m * (m - s)
                b += 2
                d = 1 / (an * d + b or 1e-300)
                c = b + an / c or 1e-300
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            out[i] = front * h
    return out


def digamma(x: float) -> float:
    r = 0.0
    while x < 10:
        r -= 1 / x
        x += 1
    f = 1 / (x * x)
    return r + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def trigamma(x: float) -> float:
    r = 0.0
    while x < 10:
        r += 1 / (x * x)
        x += 1
    f = 1 / (x * x)
    return r + 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))


def trigamma_inverse(y: float) -> float:
    """x > 0 with trigamma(x) = y, by bisection on a log scale."""
    lo, hi = 1e-8, 1e8
    for _ in range(200):
        mid = math.sqrt(lo * hi)
        lo, hi = (mid, hi) if trigamma(mid) > y else (lo, mid)
    return math.sqrt(lo * hi)


def hypergeom_upper(a: int, row: int, col: int, n: int) -> float:
    """P(X >= a) for the 2×2 table with these margins; terms further than 40 sd from the mean are below 1e-300."""
    lo, hi = max(0, row + col - n), min(row, col)
    if a <= lo:
        return 1.0
    mean = row * col / n
    sd = math.sqrt(max(mean * (1 - col / n) * (n - row) / max(n - 1, 1), 0.0))
    top = int(min(hi, max(a, mean) + 40 * sd + 40))
    if a > hi:
        return 0.0
    k = np.arange(max(a, int(max(lo, mean - 40 * sd - 40))), top + 1, dtype=float)
    if len(k) == 0:
        return 0.0
    base = math.lgamma(row + 1) + math.lgamma(n - row + 1) + math.lgamma(col + 1) + math.lgamma(n - col + 1) - math.lgamma(n + 1)
    logs = base - _lgamma(k + 1) - _lgamma(row - k + 1) - _lgamma(col - k + 1) - _lgamma(n - row - col + k + 1)
    return float(min(1.0, np.exp(logs).sum()))


def t_pvalue(t, df):
    """Two-sided t-test p-value column."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(t_two_sided(a.to_numpy(float), b.to_numpy(float)))

    return run(F.col(t) if isinstance(t, str) else t, F.col(df) if isinstance(df, str) else df)


def normal_pvalue(z):
    """Two-sided normal p-value column."""

    @F.pandas_udf("double")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series(_erfc(np.abs(a.to_numpy(float)) / math.sqrt(2)))

    return run(F.col(z) if isinstance(z, str) else z)


def chisq_pvalue(x, df):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(gamma_upper(b.to_numpy(float) / 2, a.to_numpy(float) / 2))

    return run(F.col(x) if isinstance(x, str) else x, F.col(df) if isinstance(df, str) else df)


def fisher_greater(a: str, row: str, col: str, n: str):
    """One-sided Fisher p of over-representation."""

    @F.pandas_udf("double")
    def run(x: pd.Series, r: pd.Series, c: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([hypergeom_upper(int(i), int(j), int(k), int(m)) for i, j, k, m in zip(x, r, c, t)], dtype=float)

    return run(F.col(a), F.col(row), F.col(col), F.col(n))
