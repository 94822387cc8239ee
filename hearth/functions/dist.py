"""Tail probabilities and quantiles of the F and t distributions as
Arrow-batched pandas UDFs (scipy is not available). They are applied to already
aggregated rows (one per test), never to the fact table.

The regularized incomplete beta function I_x(a, b) is a ratio of two integrals
of ``sin(u)^(2a-1) cos(u)^(2b-1)`` (put t = sin(u)^2 in the beta integral): up to
and beyond ``u = asin(sqrt(x))``. Each is taken by Gauss-Legendre panels over the
part of its range that carries weight, relative to the largest value there, so
both small tails and large parameters keep their digits.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
_NEGLIGIBLE = 60.0  # exp(-60) of the largest value is left out


def _log_weight(u, a: float, b: float):
    with np.errstate(divide="ignore"):
        left = (2 * a - 1) * np.log(np.sin(u)) if a != 0.5 else 0.0 * u
        right = (2 * b - 1) * np.log(np.cos(u)) if b != 0.5 else 0.0 * u
    return left + right


def _log_integral(lo: float, hi: float, a: float, b: float) -> float:
    """Log of the integral of the weight from ``lo`` to ``hi`` (a, b at least 1/2: one peak)."""
    if hi <= lo:
        return -math.inf
    peak = min(max(math.atan2(math.sqrt(max(2 * a - 1, 0.0)), math.sqrt(max(2 * b - 1, 0.0))), lo), hi) if a != b or a != 0.5 else lo
    at = [float(_log_weight(np.float64(p), a, b)) for p in (lo, peak, hi)]
    top = max(at)

    def edge(far: float) -> float:
        """Where the weight has become negligible between the peak and ``far``."""
        if float(_log_weight(np.float64(far), a, b)) > top - _NEGLIGIBLE:
            return far
        near = peak
        for _ in range(80):
            mid = (near + far) / 2
            if float(_log_weight(np.float64(mid), a, b)) > top - _NEGLIGIBLE:
                near = mid
            else:
                far = mid
        return far

    total = 0.0
    for x, y in ((edge(lo), peak), (peak, edge(hi))):
        cuts = np.linspace(x, y, 25)
        half, mid = (cuts[1:] - cuts[:-1]) / 2, (cuts[1:] + cuts[:-1]) / 2
        u = mid[:, None] + half[:, None] * _NODES[None, :]
        total += float((np.exp(_log_weight(u, a, b) - top) * _WEIGHTS[None, :] * half[:, None]).sum())
    return top + math.log(total) if total > 0 else -math.inf


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b) for a, b of 1/2 or more."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    u = math.atan2(math.sqrt(x), math.sqrt(1.0 - x))
    below, above = _log_integral(0.0, u, a, b), _log_integral(u, math.pi / 2, a, b)
    return 1.0 / (1.0 + math.exp(min(above - below, 700.0)))


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for F(d1, d2)."""
    if f is None or d1 is None or d2 is None or any(map(math.isnan, (f, d1, d2))) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def _f_sf_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_sf(float(a), float(b), float(c)) if pd.notna(a) and pd.notna(b) and pd.notna(c) else np.nan
                      for a, b, c in zip(f, d1, d2)])


@F.pandas_udf(T.DoubleType())
def _t_p_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(float(a), float(b)) if pd.notna(a) and pd.notna(b) else np.nan for a, b in zip(t, df)])


@lru_cache(maxsize=4096)
def t_two_sided_quantile(p: float, df: float) -> float:
    """The t whose two-sided tail probability is ``p``, by bisection."""
    if not df >= 1 or not 0 < p < 1:
        return float("nan")
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > p:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def _t_q_udf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_quantile(float(a), float(b)) if pd.notna(b) else None for a, b in zip(p, df)], dtype="float64")


def t_quantile(p: Column, df: Column) -> Column:
    """Two-sided t quantile; NULL below one degree of freedom."""
    q = _t_q_udf(p.cast("double"), df.cast("double"))
    return F.when(df >= 1, q)


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return _f_sf_udf(f.cast("double"), d1.cast("double"), d2.cast("double"))


def t_pvalue(t: Column, df: Column) -> Column:
    return _t_p_udf(t.cast("double"), df.cast("double"))
