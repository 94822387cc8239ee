"""Three-hypothesis time-series study.

The fact table is reduced once to quarterly rows per (region, type) and per
quarter; every later step (normalisation, cross-correlation by lag, YoY,
rolling volatility, bounded drawdowns) runs on those quarterly tables, whose
size is bounded by the calendar, not by the number of sales.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.quantile import group_quantiles
from hearth.functions.stats import safe_corr


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def map_with_fallback(col: str, mapping: Mapping[str, str]) -> Column:
    """Mapped value, or the original when the key is not in the map."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(m[_c(col)], _c(col))


def prepare(df: DataFrame, region_map: Mapping[str, str], type_map: Mapping[str, str],
            regular_sale: str = "Alm. Salg", yield_col: str = "yield_on_mortgage_credit_bonds%",
            infl_col: str = "dk_ann_infl_rate%", cpi_base_year: int = 2024, mode: str = "exact") -> DataFrame:
    """P12 + P15 + F17 + CPI deflation of the study: regular sales with date,
    sqm price, region and type; cleaned labels; quarter start; real prices
    with missing quarterly inflation counted as 0 %."""
    d = (df.where(F.col("sales_type") == regular_sale)
         .where(F.col("date").isNotNull() & F.col("sqm_price").isNotNull() & F.col("region").isNotNull() & F.col("house_type").isNotNull())
         .select("date", "sqm_price", "purchase_price", "region", "house_type",
                 _c(yield_col).alias("bond_yield"), _c(infl_col).alias("infl_rate"))
         .withColumns({"year": F.year("date"), "quarter_num": F.quarter("date"),
                       "region_clean": map_with_fallback("region", region_map),
                       "house_type_clean": map_with_fallback("house_type", type_map),
                       "quarter_date": F.date_trunc("quarter", "date")}))
    q = group_quantiles(d, ["quarter_date"], "infl_rate", [0.5], ["_r"], mode)
    qd = d.select("quarter_date").distinct().join(q, "quarter_date", "left")
    w = Window.orderBy("quarter_date").rowsBetween(Window.unboundedPreceding, 0)
    cpi = qd.withColumn("cpi_index", F.product(F.pow(1 + F.coalesce(F.col("_r"), F.lit(0.0)) / 100.0, 0.25)).over(w))
    in_base = F.year("quarter_date") == cpi_base_year
    base = cpi.agg(F.when(F.max(in_base.cast("int")) == 1, F.max_by(F.when(in_base, F.col("cpi_index")), F.when(in_base, F.col("quarter_date"))))
                   .otherwise(F.max_by("cpi_index", "quarter_date")).alias("_base"))
    small = cpi.crossJoin(F.broadcast(base)).select("quarter_date", (F.col("_base") / F.col("cpi_index")).alias("deflator"))
    d = d.join(F.broadcast(small), "quarter_date", "left")
    return d.withColumns({"real_purchase_price": F.col("purchase_price") * F.col("deflator"),
                          "real_sqm_price": F.col("sqm_price") * F.col("deflator")})


def quarterly_by_region_type(d: DataFrame, mode: str = "exact") -> DataFrame:
    """Median real sqm price, count and mean yield per quarter x region x type."""
    keys = ["quarter_date", "year", "quarter_num", "region_clean", "house_type_clean"]
    g = d.groupBy(*keys).agg(F.count("real_sqm_price").alias("transactions"), F.avg("bond_yield").alias("bond_yield"))
    med = group_quantiles(d, keys, "real_sqm_price", [0.5], ["price_sqm"], mode)
    return g.join(med, keys, "left")


def national_macro(d: DataFrame, norm_from: str = "1992-01-01", mode: str = "exact") -> DataFrame:
    """A27 + W16: national quarterly median real sqm price, volume, mean
    yield, the year, and the price normalised to its first quarter on or
    after ``norm_from``."""
    g = d.groupBy("quarter_date").agg(F.count("real_sqm_price").alias("total_vol"), F.avg("bond_yield").alias("bond_yield"),
                                      F.min("year").alias("year"))
    med = group_quantiles(d, ["quarter_date"], "real_sqm_price", [0.5], ["price_idx"], mode)
    m = g.join(med, "quarter_date", "left")
    return normalise(m, "price_idx", "price_norm", [], norm_from)


def normalise(df: DataFrame, value: str, out: str, keys: Sequence[str], norm_from: str) -> DataFrame:
    """Value / (first value at or after ``norm_from``, else the first) x 100."""
    after = F.to_date("quarter_date") >= F.lit(norm_from).cast("date")  # date compare: independent of the session zone
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    base = F.coalesce(F.min_by(F.when(after, F.col(value)), F.when(after, F.col("quarter_date"))).over(w),
                      F.min_by(F.col(value), F.col("quarter_date")).over(w))
    return df.withColumn(out, F.col(value) / base * 100.0)


def national_by_type(agg: DataFrame, norm_from: str = "1992-01-01", mode: str = "exact") -> DataFrame:
    """Per type and quarter, the median of the regional medians and the
    summed transactions, normalised per type."""
    s = agg.groupBy("house_type_clean", "quarter_date").agg(F.sum("transactions").alias("transactions"))
    med = group_quantiles(agg, ["house_type_clean", "quarter_date"], "price_sqm", [0.5], ["price_sqm"], mode)
    s = s.join(med, ["house_type_clean", "quarter_date"], "left")
    return normalise(s, "price_sqm", "price_norm", ["house_type_clean"], norm_from)


def cross_correlation(macro: DataFrame, max_lag: int = 12) -> DataFrame:
    """r(yield at t, volume at t + lag) for lag 0..max_lag on quarters
    with a yield, with the 95 % band 1.96 / sqrt(n)."""
    m = macro.where(F.col("bond_yield").isNotNull())
    m = m.withColumn("_i", F.row_number().over(Window.orderBy("quarter_date")))
    a = m.select(F.col("_i").alias("_ia"), F.col("bond_yield").alias("_b"),
                 F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    b = m.select(F.col("_i").alias("_ib"), F.col("total_vol").cast("double").alias("_v"))
    pairs = a.join(b, F.col("_ib") == F.col("_ia") + F.col("lag"))
    n = m.agg(F.count(F.lit(1)).alias("n"))
    r = pairs.groupBy("lag").agg(safe_corr(F.col("_b"), F.col("_v")).alias("r"))
    return r.crossJoin(F.broadcast(n)).withColumn("ci95", 1.96 / F.sqrt(F.col("n").cast("double")))


def best_negative_lag(ccf: DataFrame) -> DataFrame:
    """Lag of the most negative correlation (first on ties) and the lag
    used for the level OLS (that lag when in 1..8, else 2)."""
    b = ccf.agg(F.min_by("lag", F.struct(F.col("r"), F.col("lag"))).alias("peak_lag"), F.min("r").alias("peak_r"))
    return b.withColumn("opt_lag", F.when((F.col("peak_lag") > 0) & (F.col("peak_lag") <= 8), F.col("peak_lag")).otherwise(2))


def level_ols(macro: DataFrame, opt: DataFrame) -> DataFrame:
    """OLS of volume(t) on yield(t - lag) at the chosen lag."""
    m = macro.where(F.col("bond_yield").isNotNull()).withColumn("_i", F.row_number().over(Window.orderBy("quarter_date")))
    lag = opt.select("opt_lag")
    a = m.select("_i", F.col("total_vol").cast("double").alias("_v")).crossJoin(F.broadcast(lag))
    b = m.select(F.col("_i").alias("_j"), F.col("bond_yield").alias("_b"))
    p = a.join(b, F.col("_j") == F.col("_i") - F.col("opt_lag"))
    return p.groupBy("opt_lag").agg(
        F.regr_slope("_v", "_b").alias("slope"), F.regr_intercept("_v", "_b").alias("intercept"),
        F.regr_r2("_v", "_b").alias("r2"), F.count(F.lit(1)).alias("n"))


def yoy_and_volatility(series: DataFrame, keys: Sequence[str], value: str = "price_sqm") -> DataFrame:
    """4-quarter % change and its rolling 4-quarter std (at least 3 values)."""
    w = Window.partitionBy(*keys).orderBy("quarter_date")
    s = series.withColumn("yoy", (F.try_divide(F.col(value), F.lag(value, 4).over(w)) - 1) * 100.0)
    r = w.rowsBetween(-3, 0)
    return s.withColumn("yoy_vol4", F.when(F.count("yoy").over(r) >= 3, F.stddev_samp("yoy").over(r)))


def levene_and_ttest(yoy: DataFrame, group_col: str, a: str, b: str) -> DataFrame:
    """T3 + T4 (one row): median-centred Levene W on the two YoY series and
    the pooled two-sample t on |YoY|, over quarters where both exist."""
    both = (yoy.where(F.col(group_col).isin(a, b) & F.col("yoy").isNotNull())
            .groupBy("quarter_date").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") == 2).select("quarter_date"))
    x = yoy.where(F.col(group_col).isin(a, b) & F.col("yoy").isNotNull()).join(both, "quarter_date")
    med = x.groupBy(group_col).agg(F.median("yoy").alias("_med"))  # one value per quarter: tiny groups
    x = x.join(med, group_col).withColumn("_z", F.abs(F.col("yoy") - F.col("_med"))).withColumn("_abs", F.abs("yoy"))
    g = x.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"), F.avg("_z").alias("zm"), F.avg("_abs").alias("am"),
                                 F.var_samp("_abs").alias("av"))
    tot = x.agg(F.avg("_z").alias("_zall"), F.count(F.lit(1)).alias("_N"))
    x2 = x.join(g.select(group_col, "zm"), group_col)
    within = x2.agg(F.sum((F.col("_z") - F.col("zm")) ** 2).alias("_sw"))
    k = 2
    gg = g.crossJoin(tot).crossJoin(within)
    stat = gg.agg(
        ((F.first("_N") - k) / (k - 1) * F.sum(F.col("n") * (F.col("zm") - F.col("_zall")) ** 2) / F.first("_sw")).alias("levene_w"),
        F.first("_N").alias("n_total"),
        F.max(F.when(F.col(group_col) == a, F.col("am"))).alias("_m1"), F.max(F.when(F.col(group_col) == b, F.col("am"))).alias("_m2"),
        F.max(F.when(F.col(group_col) == a, F.col("av"))).alias("_v1"), F.max(F.when(F.col(group_col) == b, F.col("av"))).alias("_v2"),
        F.max(F.when(F.col(group_col) == a, F.col("n"))).alias("_n1"), F.max(F.when(F.col(group_col) == b, F.col("n"))).alias("_n2"),
    )
    sp2 = ((F.col("_n1") - 1) * F.col("_v1") + (F.col("_n2") - 1) * F.col("_v2")) / (F.col("_n1") + F.col("_n2") - 2)
    t = (F.col("_m1") - F.col("_m2")) / F.sqrt(sp2 * (1.0 / F.col("_n1") + 1.0 / F.col("_n2")))
    return stat.select("levene_w", (F.col("n_total") - 2).alias("levene_df2"), t.alias("t_stat"),
                       (F.col("_n1") + F.col("_n2") - 2).alias("t_df"))


def bounded_drawdowns(series: DataFrame, keys: Sequence[str], episodes: Sequence[tuple[str, str, str]],
                      value: str = "price_sqm") -> DataFrame:
    """W20 + W21 + W22: for each series and episode window [start, end]: the
    first maximum, the first minimum after it, the drawdown (%) and the number
    of quarters from peak to trough."""
    ep = F.array(*[F.struct(F.lit(e).alias("episode"), F.lit(a).cast("date").alias("_s"), F.lit(b).cast("date").alias("_e"))
                   for e, a, b in episodes])
    s = series.where(F.col(value).isNotNull()).withColumn("_ep", F.explode(ep)).select("*", "_ep.*").drop("_ep")
    s = s.where((F.to_date("quarter_date") >= F.col("_s")) & (F.to_date("quarter_date") <= F.col("_e")))
    g = [*keys, "episode"]
    w = Window.partitionBy(*g).orderBy("quarter_date")
    s = s.withColumn("_pos", F.row_number().over(w) - 1)
    peak = s.groupBy(*g).agg(F.min_by(F.struct("_pos", value), F.struct(-F.col(value), F.col("_pos"))).alias("_pk"))
    s2 = s.join(peak, g).where(F.col("_pos") >= F.col("_pk._pos"))
    tr = s2.groupBy(*g).agg(F.first("_pk").alias("_pk"),
                            F.min_by(F.struct("_pos", value), F.struct(F.col(value), F.col("_pos"))).alias("_tr"))
    return tr.select(*g, F.col(f"_pk.{value}").alias("peak_value"), F.col(f"_tr.{value}").alias("trough_value"),
                     ((F.col(f"_tr.{value}") - F.col(f"_pk.{value}")) / F.col(f"_pk.{value}") * 100.0).alias("drawdown_pct"),
                     (F.col("_tr._pos") - F.col("_pk._pos")).alias("quarters_to_trough"))


def volume_price_trend(volume: DataFrame) -> DataFrame:
    """OLS of mean sqm price on log10(transactions) across groups."""
    x = F.log10(F.col("n_transactions").cast("double"))
    return volume.agg(F.regr_slope("mean_sqm_price", x).alias("slope"), F.regr_intercept("mean_sqm_price", x).alias("intercept"),
                      F.regr_r2("mean_sqm_price", x).alias("r2"))
