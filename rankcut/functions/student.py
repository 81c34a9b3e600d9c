"""Student-t probabilities and quantiles as Arrow functions (one row per fitted cell)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, eps = 1e-300, 1e-15
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        for coef in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + coef * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + coef / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < eps:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
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


def two_sided_p(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def upper_quantile(level: float, df: float) -> float:
    """``t`` with P(|T| <= t) = level, by bisection on the monotone tail probability."""
    lo, hi = 0.0, 1.0
    while two_sided_p(hi, df) > 1.0 - level:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if two_sided_p(mid, df) > 1.0 - level else (lo, mid)
    return (lo + hi) / 2.0


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna() & (df > 0)
    out = np.full(len(t), np.nan)
    for i in np.flatnonzero(ok.to_numpy()):
        out[i] = two_sided_p(float(t.iloc[i]), float(df.iloc[i]))
    return pd.Series(out).where(ok.reset_index(drop=True), None)


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series, level: pd.Series) -> pd.Series:
    known: dict[tuple[float, float], float] = {}
    out = []
    for n, p in zip(df, level):
        if pd.isna(n) or n <= 0:
            out.append(None)
            continue
        key = (float(n), float(p))
        if key not in known:
            known[key] = upper_quantile(key[1], key[0])
        out.append(known[key])
    return pd.Series(out, dtype="float64")
