"""Gold KPI tables.

Every KPI first aggregates the fact table to one row per (region, quarter)
or per quarter; the ordered windows then run on those few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.config import EngineConfig
from hearth.functions.quantile import group_quantiles
from hearth.functions.scalar import qid_num, qid_year


def exclude_flagged(df: DataFrame, flags=("is_family_sale", "is_unclassified_sale")) -> DataFrame:
    """Drop rows carrying any of the given flags (missing flags are ignored)."""
    cond = F.lit(True)
    for f in flags:
        if f in df.columns:
            cond = cond & ~F.coalesce(F.col(f), F.lit(False))
    return df.where(cond)


def price_index(silver_df: DataFrame, cfg: EngineConfig = EngineConfig(), stl: DataFrame | None = None) -> DataFrame:
    """KPI 1: median and count of real_sqm_price by (region, quarter); index =
    median / base-year median of the region x 100 (NULL without a base)."""
    df = exclude_flagged(silver_df, cfg.exclude_flags).where(
        F.col("real_sqm_price").isNotNull() & F.col("region").isNotNull() & F.col("quarter_id").isNotNull())
    counts = df.groupBy("region", "quarter_id").agg(F.count(F.lit(1)).alias("n_transactions"))
    med = group_quantiles(df, ["region", "quarter_id"], "real_sqm_price", [0.5], ["real_sqm_price_median"],
                          cfg.quantile_mode)
    base = group_quantiles(df.where(F.col("year_sale") == cfg.base_index_year), ["region"], "real_sqm_price", [0.5],
                           ["_base_median"], cfg.quantile_mode)
    q = counts.join(med, ["region", "quarter_id"]).join(base, "region", "left")
    q = q.select(
        "region", "quarter_id", "real_sqm_price_median", "n_transactions",
        (F.try_divide(F.col("real_sqm_price_median"), F.col("_base_median")) * 100.0).alias("price_index"),
        qid_year("quarter_id").alias("year_sale"), qid_num("quarter_id").alias("quarter_num"),
    )
    if stl is not None:
        # the reference stores the trend of the raw quarterly median here, not of the index
        q = q.join(stl.select("region", "quarter_id", F.col("trend").alias("price_index_stl_trend")),
                   ["region", "quarter_id"], "left")
    return q


def transaction_volume(silver_df: DataFrame) -> DataFrame:
    """KPI 2: count by (region, quarter, house_type) on unfiltered Silver and the
    share of the region's annual total (half-even, 2 digits)."""
    v = (silver_df.where(F.col("region").isNotNull() & F.col("quarter_id").isNotNull() & F.col("house_type").isNotNull())
         .groupBy("region", "quarter_id", "house_type").agg(F.count(F.lit(1)).alias("n_transactions"))
         .withColumn("year_sale", qid_year("quarter_id")).withColumn("quarter_num", qid_num("quarter_id")))
    tot = F.sum("n_transactions").over(Window.partitionBy("region", "year_sale"))
    return v.withColumn("pct_of_annual_total", F.bround(F.col("n_transactions") / tot * 100.0, 2))


def macro_shock_label(quarter_col: str | F.Column, shock_years=(1995, 2008, 2020, 2022)) -> F.Column:
    """First shock year (in the given order) within one year of the quarter's year."""
    y = qid_year(quarter_col)
    return F.coalesce(*[F.when(F.abs(y - s) <= 1, F.lit(str(s))) for s in shock_years])


def drawdown_episodes(series: DataFrame, keys: list[str], order_col: str, value_col: str,
                      enter: float = -0.02, exit_: float = -0.01) -> DataFrame:
    """Peak-to-trough episodes per series, written as windows.

    dd = (x - running max) / running max. A row with dd < enter opens an
    episode, dd > exit closes it, anything between keeps the state (hysteresis
    via last-non-null). Peak = first position reaching the episode's running
    max; trough = first minimum of dd. An episode still open at the end is
    kept. Positions count every row of the series (NULL values included).
    """
    w = Window.partitionBy(*keys).orderBy(order_col)
    cum = w.rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value_col)
    s = series.select(*keys, order_col, value_col).withColumn("_i", F.row_number().over(w) - 1)
    s = s.withColumn("_cm", F.max(x).over(cum))
    s = s.withColumn("_dd", F.try_divide(x - F.col("_cm"), F.col("_cm")))
    sig = F.when(F.col("_dd") < enter, 1).when(F.col("_dd") > exit_, 0)
    s = s.withColumn("_st", F.last(sig, ignorenulls=True).over(cum))
    # first position at which the running max reached its current value
    new_max = F.when((x == F.col("_cm")) & (F.lag("_cm").over(w).isNull() | (F.col("_cm") > F.lag("_cm").over(w))), F.col("_i"))
    s = s.withColumn("_peak_i", F.last(new_max, ignorenulls=True).over(cum))
    start = (F.col("_st") == 1) & (F.coalesce(F.lag("_st").over(w), F.lit(0)) == 0)
    s = s.withColumn("_ep", F.sum(F.when(start, 1).otherwise(0)).over(cum))
    ep = s.where((F.col("_st") == 1) & F.col("_dd").isNotNull())
    trough = F.min(F.struct(F.col("_dd"), F.col("_i"), F.col(order_col).alias("_q"), x.alias("_x")))
    agg = ep.groupBy(*keys, "_ep").agg(trough.alias("_t"), F.min(F.col("_peak_i")).alias("_pi"))
    peaks = s.select(*keys, F.col("_i").alias("_pi"), F.col(order_col).alias("peak_quarter_id"),
                     x.alias("peak_index"))
    out = agg.join(peaks, [*keys, "_pi"])
    return out.select(
        *keys,
        "peak_quarter_id",
        F.col("_t._q").alias("trough_quarter_id"),
        F.col("peak_index").cast("double").alias("peak_index"),
        F.col("_t._x").cast("double").alias("trough_index"),
        F.bround(F.col("_t._dd") * 100.0, 2).alias("drawdown_pct"),
        (F.col("_t._i") - F.col("_pi")).alias("drawdown_duration_quarters"),
    )


def drawdown(price_idx: DataFrame, cfg: EngineConfig = EngineConfig(), keys=("region",)) -> DataFrame:
    """KPI 3 by region (house_type = 'All'), macro-shock label of the trough."""
    keys = list(keys)
    ep = drawdown_episodes(price_idx, keys, "quarter_id", "price_index", cfg.drawdown_enter, cfg.drawdown_exit)
    if "house_type" not in keys:
        ep = ep.withColumn("house_type", F.lit("All"))
    return ep.withColumn("macro_shock_label", macro_shock_label("trough_quarter_id", cfg.macro_shock_years))


def rolling_std_full(x: str, n: int, keys: list[str], order_col: str) -> F.Column:
    """Sample std over the last n rows, NULL until n non-null values are in the window."""
    w = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.col(x)).over(w) == n, F.stddev_samp(F.col(x)).over(w))


def volatility(price_idx: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """KPI 4: rolling 4- and 8-quarter std of the quarterly median, per region."""
    cols = {f"rolling_{n}q_std": rolling_std_full("real_sqm_price_median", n, ["region"], "quarter_id")
            for n in cfg.volatility_windows}
    return (price_idx.select("region", "quarter_id", "real_sqm_price_median").withColumns(cols)
            .drop("real_sqm_price_median")
            .withColumn("year_sale", qid_year("quarter_id")).withColumn("quarter_num", qid_num("quarter_id")))


def bond_elasticity(volume: DataFrame, silver_df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """KPI 5: OLS of quarterly volume change (%) on lagged yield change (bps),
    national, one row per lag with at least 10 observations."""
    yq = group_quantiles(silver_df.where(F.col("quarter_id").isNotNull()), ["quarter_id"],
                         "yield_on_mortgage_credit_bonds%", [0.5], ["yield_median"], cfg.quantile_mode)
    vol = volume.groupBy("quarter_id").agg(F.sum("n_transactions").alias("n_transactions"))
    w = Window.orderBy("quarter_id")  # one row per quarter
    vol = vol.withColumn("delta_pct_volume", (F.try_divide(F.col("n_transactions"), F.lag("n_transactions").over(w)) - 1) * 100.0)
    yq = yq.withColumn("delta_bps_yield", (F.col("yield_median") - F.lag("yield_median").over(w)) * 100.0)
    m = vol.join(yq, "quarter_id").withColumn("_r", F.row_number().over(w))  # each series is differenced on its own first
    # lag k of the yield change: shift by k rows in quarter order (one row per quarter and lag)
    shifted = m.select(F.col("_r").alias("_rs"), F.col("delta_bps_yield").alias("_yl"))
    pairs = (m.withColumn("lag_quarters", F.explode(F.array(*[F.lit(int(k)) for k in cfg.elasticity_lags])))
             .join(shifted, F.col("_rs") == F.col("_r") - F.col("lag_quarters"), "left")
             .where(F.col("delta_pct_volume").isNotNull() & F.col("_yl").isNotNull()))
    y, xx = F.col("delta_pct_volume"), F.col("_yl")
    res = pairs.groupBy("lag_quarters").agg(
        F.regr_slope(y, xx).alias("_b"), F.regr_r2(y, xx).alias("_r2"), F.regr_sxx(y, xx).alias("_sxx"),
        F.regr_syy(y, xx).alias("_syy"), F.count(F.lit(1)).alias("n_observations"),
        F.min("quarter_id").alias("_q0"), F.max("quarter_id").alias("_q1"))
    se = F.sqrt(F.try_divide((F.lit(1.0) - F.col("_r2")) * F.col("_syy"), (F.col("n_observations") - 2) * F.col("_sxx")))
    return res.where(F.col("n_observations") >= 10).select(
        F.lit("National").alias("region"), "lag_quarters",
        F.bround("_b", 4).alias("beta_ols"), F.bround(se, 4).alias("beta_ols_se"), F.bround("_r2", 4).alias("r2"),
        "n_observations", F.concat("_q0", F.lit("–"), "_q1").alias("period_label"),
        F.lit("confounded_OLS").alias("causal_warning"))
