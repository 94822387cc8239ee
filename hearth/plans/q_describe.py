"""Descriptive-analysis queries over the Bronze sales table."""

from __future__ import annotations

from hearth.config import DRIVER_CONFIG as CFG
from hearth.functions.stats import sql_grouped_stats as sgs
from hearth.functions.stats import t975_sql
from hearth.operators import describe as D
from hearth.plans.layers import bronze_table
from hearth.plans.registry import register
from hearth.plans.sql import with_ctes, with_layers

# Parameters for the driver data (house types are TPC-H part types there).
NICHE_TYPES = ("Promo", "Large")
REGULAR_TYPES = ("Economy", "Medium", "Standard")
URBAN_REGIONS = ("Europe",)
M = CFG.quantile_mode


def _b(spark, sf_dir):
    return bronze_table(spark, sf_dir, CFG)


def re0(x: str, d: int = 0) -> str:
    return f"round_even(CAST({x} AS DOUBLE), {d})"


def _lst(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


# A6 -------------------------------------------------------------------------
_A6 = [("transactions", "count", "purchase_price"), ("mean", "mean", "purchase_price"), ("median", "median", "purchase_price"),
       ("std", "std", "purchase_price"), ("q1", "q25", "purchase_price"), ("q3", "q75", "purchase_price"),
       ("minimum", "min", "purchase_price"), ("maximum", "max", "purchase_price")]


@register("regional_price_stats", ("A6", "T5", "S2", "K1"), with_layers(
    f"""SELECT region, transactions, {re0('mean')} AS mean, {re0('median')} AS median, {re0('std')} AS std,
       {re0('q1')} AS q1, {re0('q3')} AS q3, {re0('minimum')} AS minimum, {re0('maximum')} AS maximum,
       {re0(f'mean - {t975_sql("transactions - 1")} * std / sqrt(transactions)')} AS ci_lower,
       {re0(f'mean + {t975_sql("transactions - 1")} * std / sqrt(transactions)')} AS ci_upper
FROM {sgs('bronze', ['region'], _A6)}"""))
def regional_price_stats(spark, sf_dir):
    """Price statistics and 95 % CI of the mean by region."""
    return D.price_stats(_b(spark, sf_dir), "region", mode=M)


_A7 = [("transactions", "count", "sqm_price"), ("mean_m2", "mean", "sqm_price"), ("median_m2", "median", "sqm_price"),
       ("std_m2", "std", "sqm_price"), ("q1_m2", "q25", "sqm_price"), ("q3_m2", "q75", "sqm_price"),
       ("min_m2", "min", "sqm_price"), ("max_m2", "max", "sqm_price")]


@register("sqm_price_stats", ("A7",), with_layers(
    "SELECT region, transactions, " + ", ".join(f"{re0(n)} AS {n}" for n, _, _ in _A7[1:])
    + f""", {re0('mean_m2')} > t.thr AS is_premium_market, {re0('std_m2')} / {re0('mean_m2')} * 100.0 AS cv_m2
FROM {sgs('bronze', ['region'], _A7)} s CROSS JOIN (SELECT quantile_cont(sqm_price, 0.75) AS thr FROM bronze) t"""))
def sqm_price_stats(spark, sf_dir):
    """Sqm-price statistics by region with premium flag and CV."""
    return D.sqm_price_stats(_b(spark, sf_dir), "region", mode=M)


@register("ranking_comparison", ("W24",), with_layers(
    f"""SELECT region, mean_price, mean_m2, rank_price, rank_m2, rank_price - rank_m2 AS rank_difference FROM (
  SELECT region, mean_price, mean_m2,
         row_number() OVER (ORDER BY mean_price DESC, region) AS rank_price,
         row_number() OVER (ORDER BY mean_m2 DESC, region) AS rank_m2
  FROM (SELECT region, {re0('avg(purchase_price)')} AS mean_price, {re0('avg(sqm_price)')} AS mean_m2
        FROM bronze WHERE region IS NOT NULL GROUP BY region))"""))
def ranking_comparison(spark, sf_dir):
    """Region ranks by mean price vs mean sqm price."""
    return D.ranking_comparison(_b(spark, sf_dir), "region")


_VOL_CTES = f"""
vol0 AS (SELECT region, count(purchase_price) AS n_transactions, {re0('sum(purchase_price)')} AS total_value,
                {re0('avg(sqm_price)')} AS mean_sqm_price FROM bronze WHERE region IS NOT NULL GROUP BY region),
vol1 AS (SELECT *, CAST(n_transactions AS DOUBLE) / sum(n_transactions) OVER () * 100.0 AS market_share FROM vol0),
vol AS (SELECT *, sum(market_share) OVER (ORDER BY n_transactions DESC, region ROWS UNBOUNDED PRECEDING) AS cumulative_share,
               CASE WHEN market_share >= 5.0 THEN 'Principal' WHEN market_share >= 2.0 THEN 'Secundario'
                    WHEN market_share >= 0.5 THEN 'Terciario' ELSE 'Nicho' END AS market_type,
               n_transactions > (SELECT quantile_cont(n_transactions, 0.8) FROM vol0) AS high_liquidity
        FROM vol1)"""


@register("volume_stats", ("A8", "W7"), with_ctes(_VOL_CTES, "SELECT * FROM vol"))
def volume_stats(spark, sf_dir):
    """Transaction volume, market share and liquidity by region."""
    return D.volume_stats(_b(spark, sf_dir), "region")


@register("concentration_summary", ("A9",), with_ctes(_VOL_CTES, """
SELECT count(*) AS n_groups, count(*) FILTER (WHERE cumulative_share <= 80) AS groups_to_80pct,
       sum(market_share) FILTER (WHERE rk <= 10) AS top10_share,
       corr(CAST(n_transactions AS DOUBLE), mean_sqm_price) AS corr_volume_sqm_price,
       quantile_cont(n_transactions, 0.8) AS high_liquidity_threshold,
       count(*) FILTER (WHERE high_liquidity) AS n_high_liquidity,
       count(*) FILTER (WHERE market_type = 'Principal') AS n_principal,
       count(*) FILTER (WHERE market_type = 'Secundario') AS n_secundario,
       count(*) FILTER (WHERE market_type = 'Terciario') AS n_terciario,
       count(*) FILTER (WHERE market_type = 'Nicho') AS n_nicho
FROM (SELECT *, row_number() OVER (ORDER BY n_transactions DESC, region) AS rk FROM vol)"""))
def concentration_summary(spark, sf_dir):
    """Market concentration summary (one row)."""
    return D.concentration_summary(_b(spark, sf_dir), "region")


@register("cv_ranking", ("A10", "K2"), with_layers(
    f"""SELECT region, std, mean, std / mean * 100.0 AS cv_pct FROM (
  SELECT region, {re0('stddev_samp(purchase_price)')} AS std, {re0('avg(purchase_price)')} AS mean
  FROM bronze WHERE region IS NOT NULL GROUP BY region) ORDER BY cv_pct DESC, region LIMIT 15"""))
def cv_ranking(spark, sf_dir):
    """A10: top-15 regions by coefficient of variation of price."""
    return D.cv_ranking(_b(spark, sf_dir), "region", mode=M)


_A11 = [(n, n, "purchase_price") for n in ("count", "mean", "median", "std", "min", "max")]


@register("house_type_price_stats", ("A11",), with_layers(
    "SELECT house_type, count, " + ", ".join(f"{re0(n)} AS {n}" for n in ("mean", "median", "std", "min", "max"))
    + ", " + re0(f"{re0('std')} / {re0('mean')} * 100.0", 2) + f" AS cv FROM {sgs('bronze', ['house_type'], _A11)}"))
def house_type_price_stats(spark, sf_dir):
    """Price statistics by house type."""
    return D.house_type_price_stats(_b(spark, sf_dir), mode=M)


_A12 = [(f"{c}_{fn}", fn, c) for c in ("sqm", "no_rooms", "sqm_price") for fn in ("mean", "median", "std")]


@register("house_type_physical_stats", ("A12",), with_layers(
    "SELECT house_type, " + ", ".join(f"{re0(n, 2)} AS {n}" for n, _, _ in _A12) + f" FROM {sgs('bronze', ['house_type'], _A12)}"))
def house_type_physical_stats(spark, sf_dir):
    """Size, rooms and sqm-price statistics by house type."""
    return D.house_type_physical_stats(_b(spark, sf_dir), mode=M)


@register("region_type_distribution", ("A13", "K3"), with_layers(
    f"""SELECT region, house_type, n, {re0('CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY house_type) * 100.0', 1)} AS pct_of_type,
       row_number() OVER (PARTITION BY house_type ORDER BY n DESC, region) AS rank_in_type,
       row_number() OVER (PARTITION BY house_type ORDER BY n DESC, region) <= 3 AS is_top
FROM (SELECT region, house_type, count(*) AS n FROM bronze WHERE region IS NOT NULL AND house_type IS NOT NULL
      GROUP BY region, house_type)"""))
def region_type_distribution(spark, sf_dir):
    """Regional distribution within each house type."""
    return D.region_type_distribution(_b(spark, sf_dir))


_A14 = [("price_count", "count", "purchase_price"), ("price_mean", "mean", "purchase_price"),
        ("price_median", "median", "purchase_price"), ("price_std", "std", "purchase_price"),
        ("sqm_price_mean", "mean", "sqm_price"), ("sqm_price_median", "median", "sqm_price")]


@register("sales_type_stats", ("A14",), with_layers(
    "SELECT sales_type, price_count, " + ", ".join(f"{re0(n)} AS {n}" for n, _, _ in _A14[1:])
    + f" FROM {sgs('bronze', ['sales_type'], _A14)}"))
def sales_type_stats(spark, sf_dir):
    """Statistics by sales channel."""
    return D.sales_type_stats(_b(spark, sf_dir), mode=M)


_CHG = '"%_change_between_offer_and_purchase"'


@register("offer_change_distribution", ("A15",), with_layers(
    f"""SELECT change_category, n, CAST(n AS DOUBLE) / (SELECT count(*) FROM bronze) * 100.0 AS pct FROM (
  SELECT CASE WHEN {_CHG} <= -5 THEN 'Descuento >5%' WHEN {_CHG} <= -1 THEN 'Descuento 1-5%'
              WHEN {_CHG} <= 1 THEN 'Sin cambio ±1%' WHEN {_CHG} <= 5 THEN 'Premium 1-5%'
              WHEN {_CHG} IS NOT NULL THEN 'Premium >5%' END AS change_category, count(*) AS n
  FROM bronze GROUP BY 1) WHERE change_category IS NOT NULL"""))
def offer_change_distribution(spark, sf_dir):
    """Distribution of the offer-to-purchase change."""
    return D.offer_change_distribution(_b(spark, sf_dir))


_DESC = [("count", "count", "%_change_between_offer_and_purchase"), ("mean", "mean", "%_change_between_offer_and_purchase"),
         ("std", "std", "%_change_between_offer_and_purchase"), ("min", "min", "%_change_between_offer_and_purchase"),
         ("q25", "q25", "%_change_between_offer_and_purchase"), ("median", "median", "%_change_between_offer_and_purchase"),
         ("q75", "q75", "%_change_between_offer_and_purchase"), ("max", "max", "%_change_between_offer_and_purchase")]


@register("offer_change_describe", ("A15",), with_layers(f"SELECT * FROM {sgs('bronze', [], _DESC)}"))
def offer_change_describe(spark, sf_dir):
    """describe() of the offer-to-purchase change."""
    return D.describe_column(_b(spark, sf_dir), "%_change_between_offer_and_purchase", mode=M)


_A16Q = [("price_count", "count", "purchase_price"), ("price_mean", "mean", "purchase_price"),
         ("price_median", "median", "purchase_price"), ("sqm_price_mean", "mean", "sqm_price"),
         ("sqm_price_median", "median", "sqm_price")]


@register("quarter_of_year_stats", ("A16", "F1"), with_ctes(
    "bq AS (SELECT *, quarter(date) AS quarter_from_date FROM bronze)",
    "SELECT quarter_from_date, price_count, " + ", ".join(f"{re0(n)} AS {n}" for n, _, _ in _A16Q[1:])
    + f" FROM {sgs('bq', ['quarter_from_date'], _A16Q)}"))
def quarter_of_year_stats(spark, sf_dir):
    """Statistics by calendar quarter."""
    return D.quarter_of_year_stats(_b(spark, sf_dir), mode=M)


_A16M = [("count", "count", "purchase_price"), ("mean", "mean", "purchase_price"), ("median", "median", "purchase_price")]


@register("month_stats", ("A16",), with_ctes(
    "bm AS (SELECT *, month(date) AS month FROM bronze)",
    f"SELECT month, count, {re0('mean')} AS mean, {re0('median')} AS median FROM {sgs('bm', ['month'], _A16M)}"))
def month_stats(spark, sf_dir):
    """Statistics by calendar month."""
    return D.month_stats(_b(spark, sf_dir), mode=M)


@register("seasonal_extremes", ("A17",), with_ctes(
    """bm AS (SELECT *, month(date) AS month FROM bronze),
mm AS (SELECT month, quantile_cont(purchase_price, 0.5) AS median_price, count(*) AS volume FROM bm
       WHERE month IS NOT NULL GROUP BY month)""",
    """SELECT arg_max(month, struct_pack(a := median_price, b := -month)) AS max_price_month,
       arg_min(month, struct_pack(a := median_price, b := month)) AS min_price_month,
       arg_max(month, struct_pack(a := volume, b := -month)) AS max_volume_month,
       arg_min(month, struct_pack(a := volume, b := month)) AS min_volume_month,
       (max(median_price) - min(median_price)) / avg(median_price) * 100.0 AS price_variation_pct,
       (max(volume) - min(volume)) / avg(volume) * 100.0 AS volume_variation_pct FROM mm"""))
def seasonal_extremes(spark, sf_dir):
    """Seasonal extremes of price and volume."""
    return D.seasonal_extremes(_b(spark, sf_dir), mode=M)


_A18 = [("transactions", "count", "purchase_price"), ("price_mean", "mean", "purchase_price"),
        ("price_median", "median", "purchase_price"), ("price_std", "std", "purchase_price"),
        ("sqm_price_mean", "mean", "sqm_price"), ("sqm_price_median", "median", "sqm_price")]
_YEARLY_CTES = f"""
byr AS (SELECT *, year(date) AS year FROM bronze),
y0 AS (SELECT year, transactions, {", ".join(f"{re0(n)} AS {n}" for n, _, _ in _A18[1:])} FROM {sgs('byr', ['year'], _A18)}),
yt AS (SELECT *, (price_mean / lag(price_mean) OVER (ORDER BY year) - 1) * 100.0 AS price_growth_pct,
              (sqm_price_mean / lag(sqm_price_mean) OVER (ORDER BY year) - 1) * 100.0 AS sqm_price_growth_pct FROM y0)"""


@register("yearly_trend", ("A18", "W9"), with_ctes(_YEARLY_CTES, "SELECT * FROM yt"))
def yearly_trend(spark, sf_dir):
    """Yearly statistics with growth rates."""
    return D.yearly_trend(_b(spark, sf_dir), mode=M)


@register("temporal_insights", ("A19",), with_ctes(_YEARLY_CTES, """
SELECT arg_max(year, struct_pack(a := price_growth_pct, b := -year)) AS max_growth_year, max(price_growth_pct) AS max_growth_pct,
       arg_min(year, struct_pack(a := price_growth_pct, b := year)) AS min_growth_year, min(price_growth_pct) AS min_growth_pct,
       avg(price_growth_pct) AS mean_growth_pct, min(year) AS first_year, max(year) AS last_year
FROM yt WHERE price_growth_pct IS NOT NULL"""))
def temporal_insights(spark, sf_dir):
    """Growth extremes over the years."""
    return D.temporal_insights(_b(spark, sf_dir), mode=M)


_A20 = [(f"purchase_price_{f}", f, "purchase_price") for f in ("count", "mean", "median", "min", "max")]
_A20 += [(f"{c}_{f}", f, c) for c in ("sqm", "no_rooms", "sqm_price") for f in ("mean", "median")]


@register("price_segments", ("A20",), with_ctes(
    """thr AS (SELECT quantile_cont(purchase_price, 0.25) AS q25, quantile_cont(purchase_price, 0.75) AS q75,
                      quantile_cont(purchase_price, 0.90) AS q90 FROM bronze),
seg AS (SELECT b.*, CASE WHEN purchase_price <= 0 THEN NULL WHEN purchase_price <= q25 THEN 'Económico'
                          WHEN purchase_price <= q75 THEN 'Medio' WHEN purchase_price <= q90 THEN 'Alto'
                          WHEN purchase_price IS NOT NULL THEN 'Premium' END AS price_segment
        FROM bronze b CROSS JOIN thr)""",
    "SELECT price_segment, purchase_price_count, " + ", ".join(f"{re0(n)} AS {n}" for n, _, _ in _A20[1:])
    + f" FROM {sgs('seg', ['price_segment'], _A20)}"))
def price_segments(spark, sf_dir):
    """Price segmentation at q25/q75/q90."""
    return D.price_segments(_b(spark, sf_dir), mode=M)


_A21 = [("purchase_price_count", "count", "purchase_price"), ("purchase_price_mean", "mean", "purchase_price"),
        ("purchase_price_median", "median", "purchase_price"), ("sqm_price_mean", "mean", "sqm_price"),
        ("sqm_price_median", "median", "sqm_price"), ("property_age_mean", "mean", "property_age"),
        ("property_age_median", "median", "property_age")]


@register("age_segments", ("A21", "F4"), with_ctes(
    """ag AS (SELECT *, 2024 - year_build AS property_age FROM bronze WHERE year_build > 1800),
agc AS (SELECT *, CASE WHEN property_age <= 0 THEN NULL WHEN property_age <= 10 THEN 'Nueva (0-10 años)'
                       WHEN property_age <= 25 THEN 'Moderna (11-25 años)' WHEN property_age <= 50 THEN 'Madura (26-50 años)'
                       WHEN property_age <= 100 THEN 'Antigua (51-100 años)'
                       WHEN property_age IS NOT NULL THEN 'Histórica (>100 años)' END AS age_category FROM ag)""",
    "SELECT age_category, purchase_price_count, " + ", ".join(f"{re0(n)} AS {n}" for n, _, _ in _A21[1:])
    + f" FROM {sgs('agc', ['age_category'], _A21)}"))
def age_segments(spark, sf_dir):
    """Segmentation by property age."""
    return D.age_segments(_b(spark, sf_dir), mode=M)


_A22 = [("count", "size", "purchase_price"), ("avg_price", "mean", "purchase_price"),
        ("median_price", "median", "purchase_price"), ("avg_size", "mean", "sqm"), ("avg_sqm_price", "mean", "sqm_price")]
_NICHE_CTE = f"niche AS (SELECT * FROM bronze WHERE house_type IN ({_lst(NICHE_TYPES)}))"


@register("niche_markets", ("A22",), with_ctes(_NICHE_CTE, f"SELECT * FROM {sgs('niche', ['house_type'], _A22)}"))
def niche_markets(spark, sf_dir):
    """Niche house types summary."""
    return D.niche_markets(_b(spark, sf_dir), NICHE_TYPES, mode=M)


@register("niche_top_regions", ("A22", "K3"), with_ctes(_NICHE_CTE, """
SELECT c.house_type, c.region, c.n, c.rank, CAST(c.n AS DOUBLE) / t.tot * 100.0 AS pct FROM (
  SELECT house_type, region, count(*) AS n, row_number() OVER (PARTITION BY house_type ORDER BY count(*) DESC, region) AS rank
  FROM niche WHERE region IS NOT NULL GROUP BY house_type, region) c
JOIN (SELECT house_type, count(*) AS tot FROM niche GROUP BY house_type) t ON c.house_type = t.house_type
WHERE c.rank <= 5"""))
def niche_top_regions(spark, sf_dir):
    """Top-5 regions of each niche type."""
    return D.niche_top_regions(_b(spark, sf_dir), NICHE_TYPES)


@register("niche_seasonality", ("A23", "K3"), with_ctes(_NICHE_CTE, """
SELECT house_type, month, volume, rank, rank <= 3 AS is_peak FROM (
  SELECT house_type, month(date) AS month, count(*) AS volume,
         row_number() OVER (PARTITION BY house_type ORDER BY count(*) DESC, month(date)) AS rank
  FROM niche WHERE date IS NOT NULL GROUP BY house_type, month(date))"""))
def niche_seasonality(spark, sf_dir):
    """Monthly volume and peak months of niche types."""
    return D.niche_seasonality(_b(spark, sf_dir), NICHE_TYPES)


_A24 = [("purchase_price_count", "count", "purchase_price"), ("purchase_price_mean", "mean", "purchase_price"),
        ("purchase_price_median", "median", "purchase_price"), ("sqm_price_mean", "mean", "sqm_price"),
        ("sqm_price_median", "median", "sqm_price"), ("sqm_mean", "mean", "sqm"), ("sqm_median", "median", "sqm")]
_AREA_CTE = f"ar AS (SELECT *, CASE WHEN region IN ({_lst(URBAN_REGIONS)}) THEN 'Urbano' ELSE 'Rural' END AS area_type FROM bronze)"


@register("urban_rural_stats", ("A24",), with_ctes(
    _AREA_CTE, "SELECT area_type, purchase_price_count, " + ", ".join(f"{re0(n)} AS {n}" for n, _, _ in _A24[1:])
    + f" FROM {sgs('ar', ['area_type'], _A24)}"))
def urban_rural_stats(spark, sf_dir):
    """Urban vs rural statistics."""
    return D.urban_rural(_b(spark, sf_dir), URBAN_REGIONS, mode=M)


@register("urban_premium", ("A24",), with_ctes(_AREA_CTE, """
SELECT (quantile_cont(purchase_price, 0.5) FILTER (WHERE area_type = 'Urbano'))
         / (quantile_cont(purchase_price, 0.5) FILTER (WHERE area_type = 'Rural')) AS urban_price_premium,
       (quantile_cont(sqm_price, 0.5) FILTER (WHERE area_type = 'Urbano'))
         - (quantile_cont(sqm_price, 0.5) FILTER (WHERE area_type = 'Rural')) AS sqm_price_gap FROM ar"""))
def urban_premium(spark, sf_dir):
    """Urban price premium and sqm-price gap."""
    return D.urban_premium(_b(spark, sf_dir), URBAN_REGIONS, mode=M)


@register("niche_vs_regular", ("A25",), with_ctes(_NICHE_CTE, f"""
SELECT n.house_type, avg_size / reg_sqm AS size_ratio, median_price / reg_median AS price_ratio
FROM {sgs('niche', ['house_type'], _A22)} n CROSS JOIN
     (SELECT avg(sqm) AS reg_sqm, quantile_cont(purchase_price, 0.5) AS reg_median FROM bronze
      WHERE house_type IN ({_lst(REGULAR_TYPES)})) r"""))
def niche_vs_regular(spark, sf_dir):
    """Niche vs regular size and price ratios."""
    return D.niche_vs_regular(_b(spark, sf_dir), NICHE_TYPES, REGULAR_TYPES, mode=M)


@register("anova_house_type", ("T1",), with_ctes(
    """g AS (SELECT house_type, count(purchase_price) AS n, avg(purchase_price) AS m, var_samp(purchase_price) AS v
       FROM bronze WHERE house_type IS NOT NULL AND purchase_price IS NOT NULL GROUP BY house_type),
t AS (SELECT sum(n) AS nn, sum(n * m) / sum(n) AS gm, count(*) AS k FROM g)""",
    """SELECT k - 1 AS df_between, nn - k AS df_within,
       (sum(n * (m - gm) ^ 2) / (k - 1)) / (sum((n - 1) * coalesce(v, 0)) / (nn - k)) AS f_stat
FROM g CROSS JOIN t GROUP BY k, nn"""))
def anova_house_type(spark, sf_dir):
    """One-way ANOVA of price across house types (F statistic)."""
    return D.anova_oneway(_b(spark, sf_dir), "house_type", "purchase_price")


@register("type_correlations", ("T2",), with_layers(
    """SELECT house_type, corr(purchase_price, sqm) AS size_correlation,
       corr(purchase_price, CAST(no_rooms AS DOUBLE)) AS rooms_correlation
FROM bronze WHERE house_type IS NOT NULL GROUP BY house_type"""))
def type_correlations(spark, sf_dir):
    """Price correlations with size and rooms by house type."""
    return D.type_correlations(_b(spark, sf_dir))

