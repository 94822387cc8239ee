"""W3 + W25: seasonal-trend decomposition (STL, robust LOESS) per region.

The fact table is first reduced in Spark to one median per (region, quarter);
each region's short quarterly series (a few hundred points at most) is then
decomposed by ``applyInPandas``: the one place where a grouped Python
function is used, because STL is an iterative smoother with no SQL form.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.config import EngineConfig
from hearth.functions.quantile import group_quantiles

STL_SCHEMA = "region string, quarter_id string, real_sqm_price_median double, trend double, seasonal double, residual double"


def _est(y, n, length, deg, xs, nleft, nright, userw, rw):
    """Local weighted (tricube) fit at xs over y[nleft-1:nright] (1-based bounds)."""
    rng = float(n) - 1.0
    h = max(xs - nleft, nright - xs)
    if length > n:
        h += (length - n) // 2
    j = np.arange(nleft, nright + 1, dtype=float)
    r = np.abs(j - xs)
    w = np.zeros_like(j)
    inside = r <= 0.999 * h
    near = r <= 0.001 * h
    w[inside] = (1.0 - (r[inside] / h) ** 3) ** 3 if h > 0 else 1.0
    w[near & inside] = 1.0
    if userw:
        w = w * rw[nleft - 1:nright]
    a = w.sum()
    if a <= 0.0:
        return None
    w = w / a
    if h > 0.0 and deg > 0:
        a = float((w * j).sum())
        b = xs - a
        c = float((w * (j - a) ** 2).sum())
        if np.sqrt(c) > 0.001 * rng:
            w = w * (b / c * (j - a) + 1.0)
    return float((w * y[nleft - 1:nright]).sum())


def _ess(y, length, deg, userw, rw):
    n = len(y)
    out = np.empty(n)
    if n < 2:
        out[:] = y
        return out
    if length >= n:
        for i in range(1, n + 1):
            v = _est(y, n, length, deg, float(i), 1, n, userw, rw)
            out[i - 1] = y[i - 1] if v is None else v
        return out
    nsh = (length + 1) // 2
    nleft, nright = 1, length
    for i in range(1, n + 1):
        if i > nsh and nright != n:
            nleft += 1
            nright += 1
        v = _est(y, n, length, deg, float(i), nleft, nright, userw, rw)
        out[i - 1] = y[i - 1] if v is None else v
    return out


def _ss(y, period, ns, deg, userw, rw):
    n = len(y)
    season = np.empty(n + 2 * period)
    for j in range(period):
        sub = y[j::period]
        k = len(sub)
        srw = rw[j::period]
        work = np.empty(k + 2)
        work[1:k + 1] = _ess(sub, ns, deg, userw, srw)
        v = _est(sub, k, ns, deg, 0.0, 1, min(ns, k), userw, srw)
        work[0] = work[1] if v is None else v
        v = _est(sub, k, ns, deg, float(k + 1), max(1, k - ns + 1), k, userw, srw)
        work[k + 1] = work[k] if v is None else v
        season[j::period] = work
    return season


def _ma(x, length):
    c = np.cumsum(np.concatenate([[0.0], x]))
    return (c[length:] - c[:-length]) / length


def stl_decompose(y: np.ndarray, period: int = 4, seasonal: int = 7, robust: bool = True):
    """Cleveland et al. (1990) STL with the usual defaults (seasonal 7, trend
    and low-pass windows derived from the period, degree 1, jump 1; robust:
    2 inner and 15 outer iterations). Returns (trend, seasonal, residual)."""
    y = np.asarray(y, dtype=float)
    n = len(y)
    trend_len = int(np.ceil(1.5 * period / (1.0 - 1.5 / seasonal)))
    trend_len += trend_len % 2 == 0
    low_len = period + 1
    low_len += low_len % 2 == 0
    inner, outer = (2, 15) if robust else (5, 0)
    trend = np.zeros(n)
    season = np.zeros(n)
    rw = np.ones(n)
    userw = False
    k = 0
    while True:
        for _ in range(inner):
            c = _ss(y - trend, period, seasonal, 1, userw, rw)
            low = _ess(_ma(_ma(_ma(c, period), period), 3), low_len, 1, False, rw)
            season = c[period:period + n] - low
            trend = _ess(y - season, trend_len, 1, userw, rw)
        k += 1
        if k > outer:
            break
        r = np.abs(y - trend - season)
        cmad = 6.0 * np.median(r)
        u = r / cmad if cmad > 0 else np.zeros(n)
        rw = np.where(u <= 0.001, 1.0, np.where(u <= 0.999, (1.0 - u ** 2) ** 2, 0.0))
        userw = True
    return trend, season, y - trend - season


def quarterly_medians(silver_df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    df = silver_df.where(F.col("region").isNotNull() & F.col("quarter_id").isNotNull())
    keys = df.select("region", "quarter_id").distinct()
    med = group_quantiles(df, ["region", "quarter_id"], "real_sqm_price", [0.5], ["real_sqm_price_median"],
                          cfg.quantile_mode)
    q = keys.join(med, ["region", "quarter_id"], "left")
    # W25 forward fill within region
    w = Window.partitionBy("region").orderBy("quarter_id").rowsBetween(Window.unboundedPreceding, 0)
    return q.withColumn("real_sqm_price_median", F.last("real_sqm_price_median", ignorenulls=True).over(w))


def stl_per_region(silver_df: DataFrame, cfg: EngineConfig = EngineConfig(), period: int = 4) -> DataFrame:
    """STL components per region; regions with fewer than 2 periods are skipped.
    Runs on unfiltered Silver, as the reference does."""
    q = quarterly_medians(silver_df, cfg)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("quarter_id")
        y = pdf["real_sqm_price_median"].to_numpy(dtype=float)
        if len(y) < 2 * period or np.isnan(y).any():
            return pd.DataFrame(columns=["region", "quarter_id", "real_sqm_price_median", "trend", "seasonal", "residual"])
        t, s, r = stl_decompose(y, period=period)
        return pd.DataFrame({"region": pdf["region"].to_numpy(), "quarter_id": pdf["quarter_id"].to_numpy(),
                             "real_sqm_price_median": y, "trend": t, "seasonal": s, "residual": r})

    return q.groupBy("region").applyInPandas(fit, STL_SCHEMA)
