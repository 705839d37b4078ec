"""Special functions in plain Python, vectorised for Arrow UDFs."""

from __future__ import annotations

from math import ceil, erfc, exp, inf, lgamma, log, log1p, pi, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_sf2(z: float) -> float:
    """Two-sided tail of the standard normal."""
    return erfc(abs(z) / sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def student_t_sf2(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if t * t < inf else 0.0


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of chi-square: series below df + 2, continued fraction above."""
    a, y = df / 2, x / 2
    if y <= 0:
        return 1.0
    front = exp(a * log(y) - y - lgamma(a))
    if y < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-17:
            n += 1
            term *= y / n
            total += term
        return 1 - front * total
    b, c = y + 1 - a, 1e300
    d = out = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def poisson_cdf(k: int, mean: float) -> float:
    """P(X <= k)."""
    if k < 0:
        return 0.0
    return chi2_sf(2 * mean, 2 * (k + 1)) if mean > 0 else 1.0


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series from 16 on, below that by the recurrence."""
    x = np.asarray(x, float)
    up = np.where(x < 16, x + 16, x)
    one = 1 / (up * up)
    series = (1 / 12 - one * (1 / 360 - one * (1 / 1260 - one * (1 / 1680 - one / 1188)))) / up
    out = (up - 0.5) * np.log(up) - up + 0.5 * log(2 * pi) + series
    low = x < 16
    if low.any():
        product = np.prod(x[low][:, None] + np.arange(16), axis=1)
        out[low] -= np.log(product)
    return out


def log_choose(n: np.ndarray, k: float) -> np.ndarray:
    return log_gamma(n + 1) - lgamma(k + 1) - log_gamma(n - k + 1)


def expected_richness(counts: np.ndarray, depth: float) -> float:
    """Expected number of taxa among depth reads drawn without replacement; depth is cut to the whole reads there are."""
    x = np.asarray(counts, float)
    x = x[x > 0]
    total = x.sum()
    m = min(int(depth), int(total))
    if m <= 0 or not len(x):
        return 0.0
    rest = total - x
    possible = rest >= m
    missing = np.exp(log_choose(rest[possible], m) - log_choose(np.array([total]), m)[0]).sum()
    return float(len(x) - missing)


def log_depths(total: float, points: int) -> list[int]:
    """Distinct whole depths, evenly spaced in the logarithm, from 1 to total."""
    n = int(min(points, total))
    if n < 1:
        return []
    return sorted({int(d) for d in np.geomspace(1, total, n)} | {int(total)}) if n > 1 else [1]


def beta_inc_all(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """beta_inc of whole arrays, 0 < x < 1: the continued fraction of all of them at once, on the side where it converges fast."""
    a, b, x = (np.asarray(v, float) for v in np.broadcast_arrays(a, b, x))
    swap = x >= (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
    nonzero = lambda v: np.where(v == 0, 1e-300, v)
    c, d = np.ones_like(x), 1 / nonzero(1 - (a + b) * x / (a + 1))
    out = d.copy()
    for m in range(1, 500):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / nonzero(1 + term * d)
            c = nonzero(1 + term / c)
            out *= c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    part = front * out / a
    return np.where(swap, 1 - part, part)


def correlation_p(rho: np.ndarray, n: np.ndarray) -> np.ndarray:
    """p of correlations rho of n pairs, by Student's t; 1 where it is undefined."""
    rho, n = (np.asarray(v, float) for v in np.broadcast_arrays(rho, n))
    out = np.where(np.isnan(rho) | (n < 3) | (rho == 0), 1.0, 0.0)
    able = (out == 0) & (np.abs(rho) < 1)
    if able.any():
        out[able] = beta_inc_all((n[able] - 2) / 2, np.full(int(able.sum()), 0.5), 1 - rho[able] * rho[able])
    return out


def least_correlation(n: int, alpha: float) -> float:
    """A correlation of n pairs whose p is alpha (or a little more), so that pairs of smaller correlation have a larger one; 2 where none has."""
    if n < 3:
        return 2.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if correlation_p(np.array([middle]), np.array([n]))[0] <= alpha else (middle, high)
    return low * (1 - 1e-9)


@F.pandas_udf(DoubleType())
def t_pvalue(rho: pd.Series, n: pd.Series) -> pd.Series:
    """p of a rank correlation rho of n pairs; 1 where it is undefined."""
    return pd.Series(correlation_p(rho.astype(float).to_numpy(), n.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return z.map(normal_sf2)


@F.pandas_udf(DoubleType())
def chi2_pvalue(h: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(x, d) for x, d in zip(h, df, strict=True)], dtype=float)


def required_rate(confidence: float, min_reads: int) -> float:
    """Least Poisson mean at which min_reads or more are seen with this confidence."""
    low, high = 1e-9, 1e9
    for _ in range(200):
        middle = sqrt(low * high)
        low, high = (low, middle) if 1 - poisson_cdf(min_reads - 1, middle) >= confidence else (middle, high)
    return high


def whole_depth(rate: float, prevalence: float) -> int:
    return ceil(rate / prevalence)
