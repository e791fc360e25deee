"""Statistical functions Spark lacks, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log(n!) minus Stirling's main terms (Loader 2000); exact at small n by shifting."""
    n = np.asarray(n, dtype=float)
    series = lambda m: (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m**2) / m**2) / m**2) / m
    small = n < 16
    m = np.where(small, n + 16, n)
    # log(n!) = log((n+16)!) - log((n+1)...(n+16))
    shifted = series(m)
    log_fact = (m + 0.5) * np.log(m) - m + 0.5 * np.log(2 * np.pi) + shifted
    steps = np.arange(1, 17).reshape(-1, *([1] * n.ndim))
    log_fact = log_fact - np.where(small, np.log(n + steps).sum(axis=0), 0.0)
    safe = np.where(n > 0, n, 1.0)
    direct = log_fact - ((safe + 0.5) * np.log(safe) - safe + 0.5 * np.log(2 * np.pi))
    return np.where(small, direct, shifted)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1.0) / mean), 0.0) + mean - x


def binomial_pmf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Saddle-point form of the binomial probability, for 0 < k < n."""
    q = 1 - p
    log = (_stirling_error(n) - _stirling_error(k) - _stirling_error(n - k)
           - _deviance(k, n * p) - _deviance(n - k, n * q))
    return np.exp(log) * np.sqrt(n / (2 * np.pi * k * (n - k)))


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    live = np.ones(x.shape, dtype=bool)  # elements that have not settled
    for m in range(1, 1_000_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = np.where(live, h * d * c, h)
        live &= np.abs(d * c - 1) >= 1e-15
        if not live.any():
            return h
    raise ArithmeticError("the continued fraction did not settle")


def binomial_cdf_array(k, n, p) -> np.ndarray:
    """P(X <= k) for X ~ Binomial(n, p)."""
    k = np.floor(np.asarray(k, dtype=float))
    n = np.asarray(n, dtype=float)
    p = np.asarray(p, dtype=float)
    out = np.full(k.shape, np.nan)
    out = np.where(k < 0, 0.0, np.where(k >= n, 1.0, out))
    inner = (k >= 0) & (k < n) & (p > 0) & (p < 1)
    out = np.where((k >= 0) & (k < n) & (p <= 0), 1.0, out)
    out = np.where((k >= 0) & (k < n) & (p >= 1), 0.0, out)
    none = inner & (k == 0)
    out = np.where(none, np.exp(np.where(none, n, 0) * np.log1p(-np.where(none, p, 0.5))), out)
    some = inner & (k > 0)
    if some.any():
        ks, ns, ps = k[some], n[some], p[some]
        front = binomial_pmf(ks, ns, ps) * (ns - ks)
        upper = ps < (ks + 2) / (ns + 3)
        a = np.where(upper, ks + 1, ns - ks)
        b = np.where(upper, ns - ks, ks + 1)
        x = np.where(upper, ps, 1 - ps)
        # x^a (1-x)^b / B(a, b) is pmf * (n - k) * p on either side
        area = front * ps / a * _beta_fraction(a, b, x)
        out[some] = np.where(upper, 1 - area, area)
    return np.where(np.isnan(k) | np.isnan(n) | np.isnan(p), np.nan, out)


@F.pandas_udf(T.DoubleType())
def binomial_cdf(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_cdf_array(k.to_numpy(), n.to_numpy(), p.to_numpy()))
