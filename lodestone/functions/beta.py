"""Quantiles of the beta and Student distributions, vectorised, for intervals that have no closed form."""
from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def cumulative(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction."""
    x, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(x, a, b))
    turned = x > (a + 1) / (a + b + 2)
    z, p, q = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d, c = 1 / np.where(abs(d) < tiny, tiny, d), np.where(abs(c) < tiny, tiny, c)
            out = out * d * c
        if (abs(d * c - 1) < 1e-15).all():
            break
    got = np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, front * out))
    return np.where(turned, 1 - got, got)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By halving; nan where a parameter is missing or not positive."""
    p, a, b = (np.asarray(v, float) for v in np.broadcast_arrays(p, a, b))
    ok = (a > 0) & (b > 0) & np.isfinite(a + b + p)
    a, b = np.where(ok, a, 1.0), np.where(ok, b, 1.0)
    low, high = np.zeros_like(p), np.ones_like(p)
    for _ in range(60):
        middle = (low + high) / 2
        below = cumulative(middle, a, b) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return np.where(ok, (low + high) / 2, np.nan)


def student_quantile(p: np.ndarray, df: np.ndarray) -> np.ndarray:
    """For p of a half at least."""
    x = beta_quantile(2 * (1 - np.asarray(p, float)), np.asarray(df, float) / 2, 0.5)
    return np.sqrt(np.asarray(df, float) * (1 - x) / x)


def beta_point(p: Column, a: Column, b: Column) -> Column:
    """The p-quantile of Beta(a, b) in each row."""

    @F.pandas_udf("double")
    def point(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(beta_quantile(p.to_numpy(float), a.to_numpy(float), b.to_numpy(float))).replace(np.nan, None)

    return point(p.cast("double"), a.cast("double"), b.cast("double"))


def student_point(p: float, df: Column) -> Column:
    @F.pandas_udf("double")
    def point(df: pd.Series) -> pd.Series:
        return pd.Series(student_quantile(np.full(len(df), p), df.to_numpy(float))).replace(np.nan, None)

    return point(df.cast("double"))
