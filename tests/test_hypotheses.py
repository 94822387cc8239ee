"""Hypothesis-study helpers against direct pandas computations."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hearth.operators import hypotheses as H


def _series(spark, values, key="A"):
    q = pd.date_range("2000-01-01", periods=len(values), freq="QS")
    return spark.createDataFrame(pd.DataFrame({"k": key, "quarter_date": q, "price_sqm": values}))


def test_bounded_drawdown_and_speed(spark):
    vals = [100, 110, 120, 120, 115, 90, 95, 80, 85, 130]
    s = _series(spark, [float(v) for v in vals])
    r = H.bounded_drawdowns(s, ["k"], [("E", "2000-01-01", "2001-12-31")]).first()
    ep = pd.Series(vals[:8], dtype=float)
    peak = ep.idxmax()
    trough = ep.loc[peak:].min()
    assert r.peak_value == 120 and r.trough_value == trough
    assert abs(r.drawdown_pct - (trough - 120) / 120 * 100) < 1e-12
    assert r.quarters_to_trough == int(ep.iloc[ep.values.argmax():].values.argmin())


def test_yoy_and_rolling_volatility(spark):
    vals = [float(v) for v in 100 + np.cumsum(np.random.default_rng(2).normal(0, 3, 16))]
    got = H.yoy_and_volatility(_series(spark, vals), ["k"]).orderBy("quarter_date").toPandas()
    s = pd.Series(vals)
    yoy = s.pct_change(4) * 100
    assert np.allclose(got.yoy.fillna(-999), yoy.fillna(-999))
    assert np.allclose(got.yoy_vol4.fillna(-999), yoy.rolling(4, min_periods=3).std().fillna(-999))


def test_cross_correlation_lags(spark):
    rng = np.random.default_rng(5)
    b = rng.normal(4, 1, 30)
    v = np.roll(b, 2) * -50 + rng.normal(0, 5, 30) + 1000
    q = pd.date_range("2000-01-01", periods=30, freq="QS")
    m = spark.createDataFrame(pd.DataFrame({"quarter_date": q, "bond_yield": b, "total_vol": v}))
    got = {r.lag: r.r for r in H.cross_correlation(m, 4).collect()}
    for lag in range(5):
        exp = np.corrcoef(b[:-lag] if lag else b, v[lag:])[0, 1]
        assert abs(got[lag] - exp) < 1e-9
    assert H.best_negative_lag(H.cross_correlation(m, 4)).first().peak_lag == 2


def test_map_with_fallback(spark):
    df = spark.createDataFrame([("Zealand",), ("Fyn",), (None,)], "region string")
    got = [r[0] for r in df.select(H.map_with_fallback("region", {"Zealand": "Copenhagen/Zealand"})).collect()]
    assert got == ["Copenhagen/Zealand", "Fyn", None]
