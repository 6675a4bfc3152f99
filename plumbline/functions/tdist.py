"""Two-sided p-values of Student's t without SciPy: log-gamma and the incomplete beta's continued fraction, vectorised."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType

ColumnOrName = Column | str


def beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Lentz's evaluation; converges fast for x < (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            c = 1 + term / np.where(np.abs(c) < tiny, tiny, c)
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-14):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised; the symmetry keeps the fraction on its fast side."""
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    inside = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(inside) + q * np.log1p(-inside)) / p
    value = np.where(y <= 0, 0.0, front * beta_fraction(p, q, inside))
    return np.where(swap, 1 - value, value)


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """p of |t| with df degrees of freedom; NaN where either is not a number or df is not positive."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    ok = np.isfinite(t) & (df > 0)
    safe_t, safe_df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    p = incomplete_beta(safe_df / 2, np.full_like(safe_df, 0.5), safe_df / (safe_df + safe_t**2))
    return np.where(ok, p, np.nan)


def p_values(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(two_sided_p(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))


def t_p_value(t: ColumnOrName, df: ColumnOrName) -> Column:
    """Two-sided p-value as a column; batches go through Arrow."""
    return F.pandas_udf(p_values, "double", PandasUDFType.SCALAR)(t, df)
