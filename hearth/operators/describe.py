"""Descriptive market analysis.

Each function returns a small per-group DataFrame computed by one
partial-aggregated ``groupBy`` (plus exact quantiles through
``functions.quantile``). Rounding follows pandas: ``round(0)`` is half-even
(``bround``). Labels are the reference's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.quantile import scalar_quantiles
from hearth.functions.stats import grouped_stats, safe_corr, t975

# --- fixed values (reference labels and thresholds) --------------------------
MARKET_SIZE_CLASSES = (("Principal", 5.0), ("Secundario", 2.0), ("Terciario", 0.5))
MARKET_SIZE_OTHER = "Nicho"
PRICE_SEGMENT_LABELS = ("Económico", "Medio", "Alto", "Premium")
AGE_BINS = (0, 10, 25, 50, 100)
AGE_LABELS = ("Nueva (0-10 años)", "Moderna (11-25 años)", "Madura (26-50 años)", "Antigua (51-100 años)",
              "Histórica (>100 años)")
CHANGE_BINS = (-5, -1, 1, 5)
CHANGE_LABELS = ("Descuento >5%", "Descuento 1-5%", "Sin cambio ±1%", "Premium 1-5%", "Premium >5%")
AREA_LABELS = ("Urbano", "Rural")
# -----------------------------------------------------------------------------

PRICE = "purchase_price"
SQMP = "sqm_price"


def _bround(df: DataFrame, cols: Sequence[str], d: int = 0) -> DataFrame:
    return df.withColumns({c: F.bround(F.col(c).cast("double"), d) for c in cols})


def price_stats(df: DataFrame, group: str = "region", value: str = PRICE, mode: str = "exact") -> DataFrame:
    """Count, mean, median, std, q25, q75, min, max (rounded to 0) and the
    95 % t confidence interval of the mean per group, sorted by mean desc."""
    specs = [("transactions", "count", value), ("mean", "mean", value), ("median", "median", value),
             ("std", "std", value), ("q1", "q25", value), ("q3", "q75", value), ("minimum", "min", value),
             ("maximum", "max", value)]
    st = grouped_stats(df, [group], specs, mode)
    n = F.col("transactions")
    half = F.try_divide(t975(n - 1) * F.col("std"), F.sqrt(n.cast("double")))
    st = st.withColumns({"ci_lower": F.bround(F.col("mean") - half, 0), "ci_upper": F.bround(F.col("mean") + half, 0)})
    return _bround(st, ["mean", "median", "std", "q1", "q3", "minimum", "maximum"]).orderBy(F.desc("mean"), group)


def sqm_price_stats(df: DataFrame, group: str = "region", mode: str = "exact") -> DataFrame:
    """Sqm-price stats per group, premium flag (mean above the national
    q75) and coefficient of variation (%)."""
    specs = [("transactions", "count", SQMP), ("mean_m2", "mean", SQMP), ("median_m2", "median", SQMP),
             ("std_m2", "std", SQMP), ("q1_m2", "q25", SQMP), ("q3_m2", "q75", SQMP), ("min_m2", "min", SQMP),
             ("max_m2", "max", SQMP)]
    st = _bround(grouped_stats(df, [group], specs, mode), [n for n, _, _ in specs[1:]])
    thr = scalar_quantiles(df, SQMP, [0.75], ["_premium_threshold"], mode)
    st = st.crossJoin(F.broadcast(thr))
    return st.select(*[c for c in st.columns if c != "_premium_threshold"],
                     (F.col("mean_m2") > F.col("_premium_threshold")).alias("is_premium_market"),
                     (F.try_divide(F.col("std_m2"), F.col("mean_m2")) * 100.0).alias("cv_m2"))


def ranking_comparison(df: DataFrame, group: str = "region") -> DataFrame:
    """Rank of each group by mean price and by mean sqm price (ties by name)."""
    st = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.bround(F.avg(PRICE), 0).alias("mean_price"), F.bround(F.avg(SQMP), 0).alias("mean_m2"))
    w1 = Window.orderBy(F.desc("mean_price"), group)
    w2 = Window.orderBy(F.desc("mean_m2"), group)
    st = st.withColumns({"rank_price": F.row_number().over(w1), "rank_m2": F.row_number().over(w2)})
    return st.withColumn("rank_difference", F.col("rank_price") - F.col("rank_m2"))


def _market_class(share: F.Column) -> F.Column:
    e = None
    for label, lo in MARKET_SIZE_CLASSES:
        e = F.when(share >= lo, label) if e is None else e.when(share >= lo, label)
    return e.otherwise(MARKET_SIZE_OTHER)


def volume_stats(df: DataFrame, group: str = "region") -> DataFrame:
    """A8 + W7: transactions, total value, mean sqm price, market share,
    cumulative share (by volume desc), market class, top-20 % liquidity flag."""
    st = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(PRICE).alias("n_transactions"), F.bround(F.sum(PRICE), 0).alias("total_value"),
        F.bround(F.avg(SQMP), 0).alias("mean_sqm_price"))
    all_ = Window.partitionBy()
    order = Window.orderBy(F.desc("n_transactions"), group).rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("n_transactions") / F.sum("n_transactions").over(all_) * 100.0
    st = st.withColumn("market_share", share)
    st = st.withColumn("cumulative_share", F.sum("market_share").over(order))
    st = st.withColumn("market_type", _market_class(F.col("market_share")))
    thr = st.agg(F.percentile(F.col("n_transactions").cast("double"), 0.8).alias("_thr"))
    st = st.crossJoin(F.broadcast(thr))
    return st.withColumn("high_liquidity", F.col("n_transactions") > F.col("_thr")).drop("_thr")


def concentration_summary(df: DataFrame, group: str = "region", top_n: int = 10) -> DataFrame:
    """Groups covering 80 % of volume, top-N share, volume/price correlation,
    liquidity threshold and number of groups per market class (one row)."""
    v = volume_stats(df, group)
    rk = Window.orderBy(F.desc("n_transactions"), group)
    v = v.withColumn("_rk", F.row_number().over(rk))
    aggs = [
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("cumulative_share") <= 80).alias("groups_to_80pct"),
        F.sum(F.when(F.col("_rk") <= top_n, F.col("market_share"))).alias(f"top{top_n}_share"),
        safe_corr(F.col("n_transactions"), F.col("mean_sqm_price")).alias("corr_volume_sqm_price"),
        F.percentile(F.col("n_transactions").cast("double"), 0.8).alias("high_liquidity_threshold"),
        F.count_if(F.col("high_liquidity")).alias("n_high_liquidity"),
    ]
    for label, _ in MARKET_SIZE_CLASSES:
        aggs.append(F.count_if(F.col("market_type") == label).alias(f"n_{label.lower()}"))
    aggs.append(F.count_if(F.col("market_type") == MARKET_SIZE_OTHER).alias(f"n_{MARKET_SIZE_OTHER.lower()}"))
    return v.agg(*aggs)


def cv_ranking(df: DataFrame, group: str = "region", top: int = 15, mode: str = "exact") -> DataFrame:
    """A10 + K2: coefficient of variation (%) of price per group from the
    rounded stats, top ``top`` by CV."""
    st = df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.bround(F.stddev_samp(PRICE), 0).alias("std"), F.bround(F.avg(PRICE), 0).alias("mean"))
    st = st.withColumn("cv_pct", F.try_divide(F.col("std"), F.col("mean")) * 100.0)
    return st.orderBy(F.desc("cv_pct"), group).limit(top)


def house_type_price_stats(df: DataFrame, mode: str = "exact") -> DataFrame:
    """Price stats by house type, cv (%) rounded to 2, sorted by median."""
    specs = [(n, n, PRICE) for n in ("count", "mean", "median", "std", "min", "max")]
    st = _bround(grouped_stats(df, ["house_type"], specs, mode), ["mean", "median", "std", "min", "max"])
    return st.withColumn("cv", F.bround(F.try_divide(F.col("std"), F.col("mean")) * 100.0, 2)).orderBy(
        F.desc("median"), "house_type")


def house_type_physical_stats(df: DataFrame, mode: str = "exact") -> DataFrame:
    """Mean / median / std of sqm, rooms and sqm price by type (round 2)."""
    specs = [(f"{c}_{fn}", fn, c) for c in ("sqm", "no_rooms", SQMP) for fn in ("mean", "median", "std")]
    return _bround(grouped_stats(df, ["house_type"], specs, mode), [n for n, _, _ in specs], 2)


def region_type_distribution(df: DataFrame, top: int = 3) -> DataFrame:
    """A13 + K3: share (%) of each region within each house type (column-
    normalized cross-tab, long form, round 1) and the top regions per type."""
    c = (df.where(F.col("region").isNotNull() & F.col("house_type").isNotNull())
         .groupBy("region", "house_type").agg(F.count(F.lit(1)).alias("n")))
    pct = F.col("n") / F.sum("n").over(Window.partitionBy("house_type")) * 100.0
    c = c.withColumn("pct_of_type", F.bround(pct, 1))
    rk = F.row_number().over(Window.partitionBy("house_type").orderBy(F.desc("n"), "region"))
    return c.withColumn("rank_in_type", rk).withColumn("is_top", F.col("rank_in_type") <= top)


def sales_type_stats(df: DataFrame, mode: str = "exact") -> DataFrame:
    """Price and sqm-price stats by sales channel (round 0)."""
    specs = [("price_count", "count", PRICE), ("price_mean", "mean", PRICE), ("price_median", "median", PRICE),
             ("price_std", "std", PRICE), ("sqm_price_mean", "mean", SQMP), ("sqm_price_median", "median", SQMP)]
    return _bround(grouped_stats(df, ["sales_type"], specs, mode), [n for n, _, _ in specs[1:]])


def binned(c: F.Column, edges: Sequence[float], labels: Sequence[str], lowest=None) -> F.Column:
    """``pd.cut`` with right-closed bins: (lowest, e0], (e0, e1], ..., (e_last, inf).
    Values outside (lowest, inf) or NULL get no label."""
    e = None
    if lowest is not None:
        e = F.when(c <= lowest, F.lit(None))
    for edge, label in zip(edges, labels):
        e = F.when(c <= edge, label) if e is None else e.when(c <= edge, label)
    return e.when(c.isNotNull(), labels[len(edges)])


def offer_change_distribution(df: DataFrame, col: str = "%_change_between_offer_and_purchase") -> DataFrame:
    """Five right-closed bins of the offer-to-purchase change, count and share of all rows."""
    cat = binned(F.col(col), CHANGE_BINS, CHANGE_LABELS)
    c = df.select(cat.alias("change_category")).groupBy("change_category").agg(F.count(F.lit(1)).alias("n"))
    tot = df.agg(F.count(F.lit(1)).alias("_tot"))
    c = c.where(F.col("change_category").isNotNull()).crossJoin(F.broadcast(tot))
    return c.select("change_category", "n", (F.col("n") / F.col("_tot") * 100.0).alias("pct"))


def describe_column(df: DataFrame, col: str, mode: str = "exact") -> DataFrame:
    """pandas ``describe`` of one numeric column (count, mean, std, min, quartiles, max)."""
    specs = [("count", "count", col), ("mean", "mean", col), ("std", "std", col), ("min", "min", col),
             ("q25", "q25", col), ("median", "median", col), ("q75", "q75", col), ("max", "max", col)]
    return grouped_stats(df, [], specs, mode)


def quarter_of_year_stats(df: DataFrame, mode: str = "exact") -> DataFrame:
    """By calendar quarter of the sale date (round 0)."""
    d = df.withColumn("quarter_from_date", F.quarter("date"))
    specs = [("price_count", "count", PRICE), ("price_mean", "mean", PRICE), ("price_median", "median", PRICE),
             ("sqm_price_mean", "mean", SQMP), ("sqm_price_median", "median", SQMP)]
    return _bround(grouped_stats(d, ["quarter_from_date"], specs, mode), [n for n, _, _ in specs[1:]])


def month_stats(df: DataFrame, mode: str = "exact") -> DataFrame:
    """By calendar month (round 0)."""
    d = df.withColumn("month", F.month("date"))
    specs = [("count", "count", PRICE), ("mean", "mean", PRICE), ("median", "median", PRICE)]
    return _bround(grouped_stats(d, ["month"], specs, mode), ["mean", "median"])


def seasonal_extremes(df: DataFrame, mode: str = "exact") -> DataFrame:
    """Months of highest / lowest median price and volume, and the
    seasonal variation (max - min) / mean in % (one row)."""
    d = df.withColumn("month", F.month("date"))
    m = grouped_stats(d, ["month"], [("median_price", "median", PRICE), ("volume", "size", PRICE)], mode)
    return m.agg(
        F.max_by("month", F.struct(F.col("median_price"), -F.col("month"))).alias("max_price_month"),
        F.min_by("month", F.struct(F.col("median_price"), F.col("month"))).alias("min_price_month"),
        F.max_by("month", F.struct(F.col("volume"), -F.col("month"))).alias("max_volume_month"),
        F.min_by("month", F.struct(F.col("volume"), F.col("month"))).alias("min_volume_month"),
        ((F.max("median_price") - F.min("median_price")) / F.avg("median_price") * 100.0).alias("price_variation_pct"),
        ((F.max("volume") - F.min("volume")) / F.avg("volume") * 100.0).alias("volume_variation_pct"),
    )


def yearly_trend(df: DataFrame, mode: str = "exact") -> DataFrame:
    """A18 + W9: yearly stats (round 0) and growth (%) of the rounded means."""
    d = df.withColumn("year", F.year("date"))
    specs = [("transactions", "count", PRICE), ("price_mean", "mean", PRICE), ("price_median", "median", PRICE),
             ("price_std", "std", PRICE), ("sqm_price_mean", "mean", SQMP), ("sqm_price_median", "median", SQMP)]
    y = _bround(grouped_stats(d, ["year"], specs, mode), [n for n, _, _ in specs[1:]])
    w = Window.orderBy("year")
    return y.withColumns({
        "price_growth_pct": (F.try_divide(F.col("price_mean"), F.lag("price_mean").over(w)) - 1) * 100.0,
        "sqm_price_growth_pct": (F.try_divide(F.col("sqm_price_mean"), F.lag("sqm_price_mean").over(w)) - 1) * 100.0,
    })


def temporal_insights(df: DataFrame, mode: str = "exact") -> DataFrame:
    """Years of the largest and smallest growth and the mean growth (one row)."""
    y = yearly_trend(df, mode).where(F.col("price_growth_pct").isNotNull())
    return y.agg(
        F.max_by("year", F.struct(F.col("price_growth_pct"), -F.col("year"))).alias("max_growth_year"),
        F.max("price_growth_pct").alias("max_growth_pct"),
        F.min_by("year", F.struct(F.col("price_growth_pct"), F.col("year"))).alias("min_growth_year"),
        F.min("price_growth_pct").alias("min_growth_pct"),
        F.avg("price_growth_pct").alias("mean_growth_pct"),
        F.min("year").alias("first_year"), F.max("year").alias("last_year"),
    )


def price_segments(df: DataFrame, value: str = PRICE, mode: str = "exact") -> DataFrame:
    """Cut price at q25 / q75 / q90 into four labelled segments; stats per segment (round 0)."""
    thr = scalar_quantiles(df, value, [0.25, 0.75, 0.90], ["_q25", "_q75", "_q90"], mode)
    d = df.crossJoin(F.broadcast(thr))
    seg = binned(F.col(value), [F.col("_q25"), F.col("_q75"), F.col("_q90")], PRICE_SEGMENT_LABELS, lowest=0)
    d = d.withColumn("price_segment", seg)
    specs = [(f"{value}_{f}", f, value) for f in ("count", "mean", "median", "min", "max")]
    specs += [(f"{c}_{f}", f, c) for c in ("sqm", "no_rooms", SQMP) for f in ("mean", "median")]
    return _bround(grouped_stats(d, ["price_segment"], specs, mode), [n for n, _, _ in specs[1:]])


def age_segments(df: DataFrame, current_year: int = 2024, value: str = PRICE, mode: str = "exact") -> DataFrame:
    """Property age = current_year - year_build (year_build > 1800 only),
    five right-closed age bins from 0; stats per bin (round 0)."""
    d = df.where(F.col("year_build") > 1800).withColumn("property_age", F.lit(current_year) - F.col("year_build"))
    d = d.withColumn("age_category", binned(F.col("property_age"), AGE_BINS[1:], AGE_LABELS, lowest=AGE_BINS[0]))
    specs = [(f"{value}_count", "count", value), (f"{value}_mean", "mean", value), (f"{value}_median", "median", value),
             ("sqm_price_mean", "mean", SQMP), ("sqm_price_median", "median", SQMP),
             ("property_age_mean", "mean", "property_age"), ("property_age_median", "median", "property_age")]
    return _bround(grouped_stats(d, ["age_category"], specs, mode), [n for n, _, _ in specs[1:]])


def niche_markets(df: DataFrame, niche_types: Sequence[str], value: str = PRICE, mode: str = "exact") -> DataFrame:
    """Per niche house type: count, mean and median price, mean size, mean sqm price."""
    d = df.where(F.col("house_type").isin(list(niche_types)))
    specs = [("count", "size", value), ("avg_price", "mean", value), ("median_price", "median", value),
             ("avg_size", "mean", "sqm"), ("avg_sqm_price", "mean", SQMP)]
    return grouped_stats(d, ["house_type"], specs, mode)


def niche_top_regions(df: DataFrame, niche_types: Sequence[str], top: int = 5) -> DataFrame:
    """A22 + K3: the top regions of each niche type with their share (%)."""
    d = df.where(F.col("house_type").isin(list(niche_types)))
    c = d.where(F.col("region").isNotNull()).groupBy("house_type", "region").agg(F.count(F.lit(1)).alias("n"))
    tot = d.groupBy("house_type").agg(F.count(F.lit(1)).alias("_tot"))
    rk = F.row_number().over(Window.partitionBy("house_type").orderBy(F.desc("n"), "region"))
    c = c.withColumn("rank", rk).where(F.col("rank") <= top).join(tot, "house_type")
    return c.select("house_type", "region", "n", "rank", (F.col("n") / F.col("_tot") * 100.0).alias("pct"))


def niche_seasonality(df: DataFrame, niche_types: Sequence[str], top: int = 3) -> DataFrame:
    """Monthly volume of each niche type and its top months."""
    d = df.where(F.col("house_type").isin(list(niche_types)) & F.col("date").isNotNull())
    c = d.groupBy("house_type", F.month("date").alias("month")).agg(F.count(F.lit(1)).alias("volume"))
    rk = F.row_number().over(Window.partitionBy("house_type").orderBy(F.desc("volume"), "month"))
    return c.withColumn("rank", rk).withColumn("is_peak", F.col("rank") <= top)


def urban_rural(df: DataFrame, urban_regions: Sequence[str], value: str = PRICE, mode: str = "exact") -> DataFrame:
    """Urban vs rural stats (round 0)."""
    d = df.withColumn("area_type", F.when(F.col("region").isin(list(urban_regions)), AREA_LABELS[0]).otherwise(AREA_LABELS[1]))
    specs = [(f"{value}_count", "count", value), (f"{value}_mean", "mean", value), (f"{value}_median", "median", value),
             ("sqm_price_mean", "mean", SQMP), ("sqm_price_median", "median", SQMP),
             ("sqm_mean", "mean", "sqm"), ("sqm_median", "median", "sqm")]
    return _bround(grouped_stats(d, ["area_type"], specs, mode), [n for n, _, _ in specs[1:]])


def urban_premium(df: DataFrame, urban_regions: Sequence[str], mode: str = "exact") -> DataFrame:
    """urban/rural ratio of median price and gap of median sqm price (unrounded, one row)."""
    d = df.withColumn("area_type", F.when(F.col("region").isin(list(urban_regions)), AREA_LABELS[0]).otherwise(AREA_LABELS[1]))
    m = grouped_stats(d, ["area_type"], [("mp", "median", PRICE), ("ms", "median", SQMP)], mode)
    u, r = F.col("area_type") == AREA_LABELS[0], F.col("area_type") == AREA_LABELS[1]
    return m.agg(
        F.try_divide(F.max(F.when(u, F.col("mp"))), F.max(F.when(r, F.col("mp")))).alias("urban_price_premium"),
        (F.max(F.when(u, F.col("ms"))) - F.max(F.when(r, F.col("ms")))).alias("sqm_price_gap"),
    )


def niche_vs_regular(df: DataFrame, niche_types: Sequence[str], regular_types: Sequence[str],
                     mode: str = "exact") -> DataFrame:
    """Niche mean size over regular mean size, niche median price over regular median price."""
    reg = df.where(F.col("house_type").isin(list(regular_types)))
    rstats = grouped_stats(reg, [], [("_reg_sqm", "mean", "sqm"), ("_reg_median", "median", PRICE)], mode)
    n = niche_markets(df, niche_types, mode=mode)
    return n.crossJoin(F.broadcast(rstats)).select(
        "house_type", F.try_divide(F.col("avg_size"), F.col("_reg_sqm")).alias("size_ratio"),
        F.try_divide(F.col("median_price"), F.col("_reg_median")).alias("price_ratio"))


def anova_oneway(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way ANOVA F statistic from per-group n / mean / variance (one row)."""
    g = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    tot = g.agg(F.sum("n").alias("_N"), F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("_gm"),
                F.count(F.lit(1)).alias("_k"))
    j = g.crossJoin(F.broadcast(tot))
    s = j.agg(F.sum(F.col("n") * (F.col("m") - F.col("_gm")) ** 2).alias("ssb"),
              F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw"),
              F.first("_k").alias("k"), F.first("_N").alias("N"))
    return s.select((F.col("k") - 1).alias("df_between"), (F.col("N") - F.col("k")).alias("df_within"),
                    F.try_divide(F.try_divide("ssb", F.col("k") - 1), F.try_divide("ssw", F.col("N") - F.col("k"))).alias("f_stat"))


def type_correlations(df: DataFrame, value: str = PRICE) -> DataFrame:
    """Correlation of price with size and with rooms per house type."""
    return df.where(F.col("house_type").isNotNull()).groupBy("house_type").agg(
        safe_corr(F.col(value), F.col("sqm")).alias("size_correlation"), safe_corr(F.col(value), F.col("no_rooms")).alias("rooms_correlation"))
