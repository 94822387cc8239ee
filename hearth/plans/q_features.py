"""Feature-engineering queries over the Bronze sales table."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from hearth.config import DRIVER_CONFIG as CFG
from hearth.operators import features as X
from hearth.plans.layers import _root, bronze_table
from hearth.plans.registry import register
from hearth.plans.sql import with_ctes, with_layers

M = CFG.quantile_mode
KEY = ("house_id", "no_rooms", "date", "purchase_price")


def _b(spark, sf_dir):
    return bronze_table(spark, sf_dir, CFG).withColumn("year", F.col("year_sale"))


@register("date_features", ("F1", "F2", "F3"), with_layers("""
SELECT house_id, no_rooms, date, purchase_price, year(date) AS year_sale, month(date) AS month_sale, day(date) AS day_sale,
       isodow(date) - 1 AS dayofweek_sale, quarter(date) AS quarter_sale,
       CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) IN (3, 4, 5) THEN 'Spring'
            WHEN month(date) IN (6, 7, 8) THEN 'Summer' ELSE 'Autumn' END AS season_sale,
       ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][isodow(date)] AS dayname_sale,
       sin(2 * pi() * month(date) / 12) AS month_sin, cos(2 * pi() * month(date) / 12) AS month_cos,
       sin(2 * pi() * (isodow(date) - 1) / 7) AS dayofweek_sin, cos(2 * pi() * (isodow(date) - 1) / 7) AS dayofweek_cos,
       sin(2 * pi() * quarter(date) / 4) AS quarter_sin, cos(2 * pi() * quarter(date) / 4) AS quarter_cos,
       year(date) - (SELECT min(year(date)) FROM bronze) AS years_since_start,
       2024 - year_build AS property_age, floor(year_build / 10.0) * 10 AS decade_built
FROM bronze"""))
def date_features(spark, sf_dir):
    """Calendar parts, season, day name, cyclic encodings."""
    d = X.property_age_features(X.cyclic_features(X.date_features(_b(spark, sf_dir))))
    return d.withColumn("decade_built", F.col("decade_built").cast("double")).select(*KEY, "property_age", "decade_built", "year_sale", "month_sale", "day_sale", "dayofweek_sale", "quarter_sale", "season_sale",
                    "dayname_sale", "month_sin", "month_cos", "dayofweek_sin", "dayofweek_cos", "quarter_sin",
                    "quarter_cos", "years_since_start")


@register("property_age_features", ("F4",), with_layers("""
SELECT house_id, no_rooms, date, purchase_price, 2024 - year_build AS property_age,
       CAST(floor(year_build / 10) * 10 AS BIGINT) AS decade_built,
       CAST(CAST(floor(year_build / 10) * 10 AS BIGINT) AS VARCHAR) || 's' AS decade_built_label,
       CASE WHEN 2024 - year_build < 0 THEN 'Future/Error' WHEN 2024 - year_build <= 5 THEN 'New (0-5 years)'
            WHEN 2024 - year_build <= 15 THEN 'Modern (6-15 years)' WHEN 2024 - year_build <= 30 THEN 'Established (16-30 years)'
            WHEN 2024 - year_build <= 50 THEN 'Mature (31-50 years)' ELSE 'Historic (50+ years)' END AS age_category,
       CASE WHEN year_build < 1900 THEN 'Historic' WHEN year_build < 1950 THEN 'Pre-War' WHEN year_build < 1980 THEN 'Post-War'
            WHEN year_build < 2000 THEN 'Late Century' ELSE 'Modern' END AS vintage_category
FROM bronze"""))
def property_age_features(spark, sf_dir):
    """property age, decade and categories."""
    d = X.property_age_features(_b(spark, sf_dir))
    return d.select(*KEY, "property_age", F.col("decade_built").cast("long").alias("decade_built"),
                    "decade_built_label", "age_category", "vintage_category")


@register("size_features", ("F5", "W23"), with_ctes("""
thr AS (SELECT quantile_cont(sqm, 0.33) AS s33, quantile_cont(sqm, 0.67) AS s67,
               quantile_cont(sqm_price, 0.25) AS p25, quantile_cont(sqm_price, 0.5) AS p50, quantile_cont(sqm_price, 0.75) AS p75 FROM bronze)""",
    """SELECT house_id, no_rooms, date, purchase_price,
       CASE WHEN no_rooms <= 2 THEN '1-2 rooms' WHEN no_rooms <= 4 THEN '3-4 rooms' ELSE '5+ rooms' END AS rooms_category,
       CASE WHEN sqm <= s33 THEN 'Small' WHEN sqm <= s67 THEN 'Medium' ELSE 'Large' END AS size_category,
       CASE WHEN no_rooms = 0 THEN NULL ELSE sqm / no_rooms END AS sqm_per_room,
       CASE WHEN sqm_price <= p25 THEN 'Very Efficient' WHEN sqm_price <= p50 THEN 'Efficient'
            WHEN sqm_price <= p75 THEN 'Average' ELSE 'Premium' END AS sqm_price_category,
       CASE WHEN sqm_price IS NOT NULL THEN
         (rank() OVER (ORDER BY sqm_price) + (count(*) OVER (PARTITION BY sqm_price) - 1) / 2.0) / count(sqm_price) OVER () END
         AS sqm_price_percentile
FROM bronze CROSS JOIN thr"""))
def size_features(spark, sf_dir):
    """F5 + W23: room/size/sqm-price categories and average-rank percentile."""
    d = X.size_features(_b(spark, sf_dir), mode=M)
    return d.select(*KEY, "rooms_category", "size_category", "sqm_per_room", "sqm_price_category", "sqm_price_percentile")


@register("log_and_interactions", ("F7", "F8", "F9", "F10", "F11", "F12"), with_ctes(
    "mn AS (SELECT min(sqm) AS msqm, min(\"%_change_between_offer_and_purchase\") AS mchg FROM bronze)",
    """SELECT house_id, no_rooms, date, purchase_price, ln(1 + purchase_price) AS log_price,
       CASE WHEN msqm <= 0 THEN ln(1 + sqm) ELSE ln(sqm + 1.0) END AS sqm_log,
       CASE WHEN mchg <= 0 THEN (CASE WHEN "%_change_between_offer_and_purchase" > -1 THEN ln(1 + "%_change_between_offer_and_purchase") END)
            ELSE ln("%_change_between_offer_and_purchase" + 1.0) END
         AS "%_change_between_offer_and_purchase_log",
       sqm * no_rooms AS sqm_x_no_rooms, sqm / (no_rooms + 1e-8) AS sqm_div_no_rooms, sqm + year_build AS sqm_plus_year_build, sqm - no_rooms AS sqm_minus_no_rooms,
       (2024 - year_build) * CASE WHEN house_type = 'Economy' THEN 1 ELSE 0 END AS age_x_economy,
       (2024 - year_build) * CASE WHEN house_type = 'Standard' THEN 1 ELSE 0 END AS age_x_standard,
       sqm / CASE WHEN no_rooms = 0 THEN 1 ELSE no_rooms END AS sqm_per_room,
       power(sqm / CASE WHEN no_rooms = 0 THEN 1 ELSE no_rooms END, 2) AS sqm_per_room_sq,
       no_rooms * sqm AS rooms_x_sqm
FROM bronze CROSS JOIN mn"""))
def log_and_interactions(spark, sf_dir):
    """Log target, log transforms, interactions."""
    b = _b(spark, sf_dir)
    d = X.log_target(b)
    d = X.log_transform(d, ["sqm", "%_change_between_offer_and_purchase"])
    d = X.interactions(d, [("sqm", "no_rooms")], "multiply")
    d = X.interactions(d, [("sqm", "no_rooms")], "divide", "_div_")
    d = X.interactions(X.interactions(d, [("sqm", "year_build")], "add", "_plus_"), [("sqm", "no_rooms")], "subtract", "_minus_")
    d = X.safe_interactions(X.sqm_per_room_safe(X.property_age_features(d)), ("Economy", "Standard"))
    return d.select(*KEY, "log_price", "sqm_log", "%_change_between_offer_and_purchase_log", "sqm_x_no_rooms",
                    "sqm_div_no_rooms", "sqm_plus_year_build", "sqm_minus_no_rooms", "age_x_economy", "age_x_standard",
                    "sqm_per_room", "sqm_per_room_sq", "rooms_x_sqm")


@register("market_phase_features", ("F13",), with_layers("""
SELECT house_id, no_rooms, date, purchase_price,
       (year_sale - (SELECT min(year_sale) FROM bronze)) / greatest((SELECT max(year_sale) - min(year_sale) FROM bronze), 1) AS time_trend,
       CAST(year_sale IN (2008, 2009, 2020, 2021) AS INTEGER) AS crisis_period,
       CASE WHEN year_sale BETWEEN 0 AND 2000 THEN 'growth_90s' WHEN year_sale BETWEEN 2001 AND 2007 THEN 'boom_2000s'
            WHEN year_sale BETWEEN 2008 AND 2012 THEN 'crisis_post2008' WHEN year_sale BETWEEN 2013 AND 2019 THEN 'recovery_2010s'
            WHEN year_sale BETWEEN 2020 AND 2024 THEN 'covid_era' ELSE 'other' END AS market_phase,
       year_sale BETWEEN 0 AND 2000 AS phase_growth_90s, year_sale BETWEEN 2001 AND 2007 AS phase_boom_2000s, year_sale NOT BETWEEN 0 AND 2024 AS phase_other
FROM bronze"""))
def market_phase_features(spark, sf_dir):
    """time trend, crisis flag, market phase."""
    d = X.market_phase_features(_b(spark, sf_dir), "year")
    return d.select(*KEY, "time_trend", "crisis_period", "market_phase",
                    "phase_growth_90s", "phase_boom_2000s", "phase_other")


_RATES = ("dk_ann_infl_rate%", "yield_on_mortgage_credit_bonds%")
_ORDER = ("date", "house_id", "no_rooms", "purchase_price", "sqm_price", "dk_ann_infl_rate%", "yield_on_mortgage_credit_bonds%",
          "sqm", "year_build", "zip_code", "house_type", "region", "area", "sales_type")


def _qq(c):
    return f'"{c}"'


@register("rate_features", ("W12",), with_layers(
    "SELECT house_id, no_rooms, date, purchase_price, "
    'CASE WHEN "yield_on_mortgage_credit_bonds%" <> 0 THEN "dk_ann_infl_rate%" / "yield_on_mortgage_credit_bonds%" END AS rate_ratio, '
    '"dk_ann_infl_rate%" - "yield_on_mortgage_credit_bonds%" AS rate_spread, '
    + ", ".join(f"lag({_qq(c)}, {k}) OVER (ORDER BY {', '.join(_qq(o) + ' NULLS FIRST' for o in _ORDER)}) AS {_qq(c + '_lag' + str(k))}"
                for c in _RATES for k in (1, 2))
    + " FROM bronze"))
def rate_features(spark, sf_dir):
    """Rate ratio/spread and lags in an explicit global order (distributed)."""
    d = X.rate_features(_b(spark, sf_dir), _RATES, _ORDER)
    a, b = _RATES
    return d.select(*KEY, F.col(f"`{a}_{b}_ratio`").alias("rate_ratio"), F.col(f"`{a}_{b}_spread`").alias("rate_spread"),
                    *[F.col(f"`{c}_lag{k}`") for c in _RATES for k in (1, 2)])


def _roll_ctes(years: int) -> str:
    return f"""
keys AS (SELECT DISTINCT region, year_sale AS year FROM bronze WHERE region IS NOT NULL AND year_sale IS NOT NULL),
rs AS (SELECT k.region, k.year, count(b.purchase_price) AS n, avg(b.purchase_price) AS mean,
              quantile_cont(b.purchase_price, 0.5) AS median, stddev_samp(b.purchase_price) AS std,
              quantile_cont(b.purchase_price, 0.9) AS p90
       FROM keys k LEFT JOIN bronze b ON b.region = k.region
            AND b.year_sale BETWEEN k.year - {years} AND k.year - 1 AND b.purchase_price IS NOT NULL
       GROUP BY k.region, k.year),
roll AS (SELECT region, year,
                CASE WHEN n >= {CFG.min_obs_per_window} THEN mean END AS rolling_regional_mean,
                CASE WHEN n >= {CFG.min_obs_per_window} THEN median END AS rolling_regional_median,
                CASE WHEN n >= {CFG.min_obs_per_window} THEN CASE WHEN n = 1 THEN 0.0 ELSE std END END AS rolling_regional_std,
                CASE WHEN n >= {CFG.min_obs_per_window} AND mean <> 0 THEN (CASE WHEN n = 1 THEN 0.0 ELSE std END) / mean END AS rolling_regional_cv,
                n AS rolling_regional_count,
                CASE WHEN n >= {CFG.min_obs_per_window} THEN p90 END AS rolling_regional_p90
         FROM rs)"""


_ROLL_CTES = _roll_ctes(CFG.rolling_window_years)
LONG_WINDOW_YEARS = 12


@register("rolling_regional_stats_long", ("W14",), with_ctes(_roll_ctes(LONG_WINDOW_YEARS), "SELECT * FROM roll"))
def rolling_regional_stats_long(spark, sf_dir):
    """The same statistics over the twelve years before each (region, year)."""
    return X.rolling_regional_stats(_b(spark, sf_dir), "region", "purchase_price", "year", LONG_WINDOW_YEARS, CFG.min_obs_per_window, M)


@register("rolling_regional_stats", ("W13", "W14", "U3"), with_ctes(_ROLL_CTES, "SELECT * FROM roll"))
def rolling_regional_stats(spark, sf_dir):
    """Causal rolling regional price statistics per (region, year)."""
    return X.rolling_regional_stats(_b(spark, sf_dir), "region", "purchase_price", "year",
                                    CFG.rolling_window_years, CFG.min_obs_per_window, M)


@register("rolling_causal_features", ("J7", "W15"), with_ctes(_ROLL_CTES, """
SELECT b.house_id, b.no_rooms, b.date, b.purchase_price, r.rolling_regional_median,
       CASE WHEN r.rolling_regional_p90 IS NOT NULL THEN CAST(b.purchase_price > r.rolling_regional_p90 AS DOUBLE) END AS is_premium_causal,
       b.purchase_price - r.rolling_regional_median AS price_deviation_from_rolling_median
FROM bronze b LEFT JOIN roll r ON b.region = r.region AND b.year_sale = r.year"""))
def rolling_causal_features(spark, sf_dir):
    """J7 + W15: rows with the rolling stats, causal premium flag and deviation."""
    d = X.add_rolling_features(_b(spark, sf_dir), "region", "purchase_price", "year",
                               CFG.rolling_window_years, CFG.min_obs_per_window, M)
    return d.select(*KEY, "rolling_regional_median", "is_premium_causal", "price_deviation_from_rolling_median")


@register("target_encoding_house_type", ("E2", "J10"), with_layers("""
SELECT house_type, (n * m + 10.0 * g) / (n + 10.0) AS house_type_target_encoded FROM (
  SELECT house_type, avg(ln(1 + purchase_price)) AS m, count(purchase_price) AS n FROM bronze WHERE house_type IS NOT NULL GROUP BY house_type)
CROSS JOIN (SELECT avg(ln(1 + purchase_price)) AS g FROM bronze)"""))
def target_encoding_house_type(spark, sf_dir):
    """Smoothed target encoding of house type on log price (fitted table)."""
    b = X.log_target(_b(spark, sf_dir))
    t = X.target_encoding_table(b, "house_type", "log_price", 10.0)
    return t.select("house_type", F.col("_enc").alias("house_type_target_encoded"))


@register("region_encoding", ("E3", "E4", "E6", "J8"), with_layers(f"""
SELECT region, region_price_mean, region_price_std, region_count,
       CASE WHEN region_count >= {100} THEN region_price_mean
            ELSE region_count / {100} * region_price_mean + (1 - region_count / {100}) * g END AS region_target_encoded,
       region_frequency
FROM (SELECT region, avg(ln(1 + purchase_price)) AS region_price_mean, stddev_samp(ln(1 + purchase_price)) AS region_price_std,
             count(purchase_price) AS region_count, count(*) AS region_frequency
      FROM bronze WHERE region IS NOT NULL GROUP BY region)
CROSS JOIN (SELECT avg(ln(1 + purchase_price)) AS g FROM bronze)"""))
def region_encoding(spark, sf_dir):
    """Region target encoding (min 100 samples) and frequency encoding."""
    b = X.log_target(_b(spark, sf_dir))
    t = X.region_target_encoding(b, "log_price")
    f = b.groupBy("region").agg(F.count(F.lit(1)).alias("region_frequency"))
    return t.join(f, "region")


@register("rare_zip_grouping", ("E5",), with_layers("""
SELECT zip_code_grouped, count(*) AS n FROM (
  SELECT CASE WHEN z.k IS NOT NULL AND CAST(z.k AS DOUBLE) / (SELECT count(*) FROM bronze) < 0.01 THEN 'Other' ELSE b.zip_code END
         AS zip_code_grouped
  FROM bronze b LEFT JOIN (SELECT zip_code, count(*) AS k FROM bronze WHERE zip_code IS NOT NULL GROUP BY zip_code) z
       ON b.zip_code = z.zip_code) GROUP BY 1"""))
def rare_zip_grouping(spark, sf_dir):
    """E5: rare zip codes (< 1 % of rows) grouped as 'Other'; counts per group."""
    d = X.group_rare(_b(spark, sf_dir), "zip_code", 0.01)
    return d.groupBy("zip_code_grouped").agg(F.count(F.lit(1)).alias("n"))


@register("one_hot_house_type", ("E1", "U2"), with_layers("""
SELECT house_id, no_rooms, date, purchase_price, """ + ", ".join(
    f"CAST(house_type = '{v}' AS INTEGER) AS house_type_{v}" for v in ("Large", "Medium", "Promo", "Small", "Standard"))
    + " FROM bronze"))
def one_hot_house_type(spark, sf_dir):
    """One-hot house type, first category (alphabetical) dropped."""
    d = X.one_hot(_b(spark, sf_dir), "house_type")
    return d.select(*KEY, *[c for c in d.columns if c.startswith("house_type_")])


def _scale_sql(kind: str) -> str:
    if kind == "standard":
        st = "avg(sqm) AS a1, stddev_pop(sqm) AS b1, avg(sqm_price) AS a2, stddev_pop(sqm_price) AS b2"
        ex = "(sqm - a1) / CASE WHEN b1 = 0 OR b1 IS NULL THEN 1.0 ELSE b1 END AS sqm_scaled, (sqm_price - a2) / CASE WHEN b2 = 0 OR b2 IS NULL THEN 1.0 ELSE b2 END AS sqm_price_scaled"
    elif kind == "minmax":
        st = "min(sqm) AS a1, max(sqm) AS b1, min(sqm_price) AS a2, max(sqm_price) AS b2"
        ex = ("(sqm - a1) / CASE WHEN b1 - a1 = 0 THEN 1.0 ELSE b1 - a1 END * 1.0 + 0.0 AS sqm_minmax, "
              "(sqm_price - a2) / CASE WHEN b2 - a2 = 0 THEN 1.0 ELSE b2 - a2 END * 1.0 + 0.0 AS sqm_price_minmax")
    else:
        st = ("quantile_cont(sqm, 0.5) AS a1, quantile_cont(sqm, 0.75) - quantile_cont(sqm, 0.25) AS b1, "
              "quantile_cont(sqm_price, 0.5) AS a2, quantile_cont(sqm_price, 0.75) - quantile_cont(sqm_price, 0.25) AS b2")
        ex = ("(sqm - a1) / CASE WHEN b1 = 0 OR b1 IS NULL THEN 1.0 ELSE b1 END AS sqm_robust, "
              "(sqm_price - a2) / CASE WHEN b2 = 0 OR b2 IS NULL THEN 1.0 ELSE b2 END AS sqm_price_robust")
    return with_ctes(f"fit AS (SELECT {st} FROM bronze WHERE year_sale <= {CFG.split_last_train_year})",
                     f"SELECT house_id, no_rooms, date, purchase_price, {ex} FROM bronze CROSS JOIN fit")


def _scaled(spark, sf_dir, kind):
    b = _b(spark, sf_dir)
    stats = X.fit_scaler(b.where(F.col("year") <= CFG.split_last_train_year), ["sqm", "sqm_price"], kind, M)
    d = X.apply_scaler(b, stats, ["sqm", "sqm_price"], kind)
    suffix = {"standard": "_scaled", "minmax": "_minmax", "robust": "_robust"}[kind]
    return d.select(*KEY, f"sqm{suffix}", f"sqm_price{suffix}")


@register("standard_scaling", ("E7",), _scale_sql("standard"))
def standard_scaling(spark, sf_dir):
    """Standard scaling (population std) fitted on training years only."""
    return _scaled(spark, sf_dir, "standard")


@register("minmax_scaling", ("E8",), _scale_sql("minmax"))
def minmax_scaling(spark, sf_dir):
    """Min-max scaling fitted on training years only."""
    return _scaled(spark, sf_dir, "minmax")


@register("robust_scaling", ("E9",), _scale_sql("robust"))
def robust_scaling(spark, sf_dir):
    """Robust scaling (median / IQR) fitted on training years only."""
    return _scaled(spark, sf_dir, "robust")


_STRATEGY_COLS = ("sqm", "sqm_price", "no_rooms", "year_build", "purchase_price", "month_sin")


def _strategy_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}, min({c}) AS lo{i}, max({c}) AS hi{i}, skewness({c}) AS g{i}, quantile_cont({c}, 0.5) AS q{i}, "
                      f"quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS r{i}" for i, c in enumerate(_STRATEGY_COLS))
    one = lambda x: f"CASE WHEN {x} = 0 OR {x} IS NULL THEN 1.0 ELSE {x} END"
    out = ", ".join(f"({c} - lo{i}) / {one(f'(hi{i} - lo{i})')} AS {c}_scaled" if c == "month_sin" else
                    f"CASE WHEN abs(g{i}) <= 1 THEN ({c} - m{i}) / {one(f's{i}')} WHEN abs(g{i}) > 1 THEN ({c} - q{i}) / {one(f'r{i}')} ELSE {c} END AS {c}_scaled"
                    for i, c in enumerate(_STRATEGY_COLS))
    return with_ctes(f"b AS (SELECT house_id, date, year_sale, sqm, sqm_price, purchase_price, CAST(no_rooms AS DOUBLE) AS no_rooms, CAST(year_build AS DOUBLE) AS year_build, "
                     f"sin(2 * pi() * month(date) / 12.0) AS month_sin, no_rooms AS rooms FROM bronze), "
                     f"fit AS (SELECT {stats} FROM b WHERE year_sale <= {CFG.split_last_train_year})",
                     f"SELECT house_id, rooms AS no_rooms, date, purchase_price, {out} FROM b CROSS JOIN fit")


@register("strategy_scaling", ("E10",), _strategy_sql())
def strategy_scaling(spark, sf_dir):
    """Standard or robust scaling by each column's skewness, min-max for the cyclic column; fitted on training years."""
    b = _b(spark, sf_dir).withColumn("month_sin", F.sin(2 * math.pi * F.month("date") / 12.0))
    d = X.strategy_scale(b, b.where(F.col("year") <= CFG.split_last_train_year), _STRATEGY_COLS, ("month_sin",), mode=M)
    return d.select(*KEY, *[f"{c}_scaled" for c in _STRATEGY_COLS])


@register("median_imputation", ("E14", "P18"), with_ctes(
    f"""x AS (SELECT *, CASE WHEN no_rooms <> 1 THEN sqm / (no_rooms - 1) END AS extra FROM bronze),
med AS (SELECT quantile_cont(sqm, 0.5) AS m, quantile_cont(extra, 0.5) AS me FROM x WHERE year_sale < {CFG.holdout_start_year})""",
    """SELECT house_id, no_rooms, date, purchase_price, coalesce(sqm, m, 0.0) AS sqm, coalesce(extra, me, 0.0) AS sqm_per_extra_room FROM x CROSS JOIN med"""))
def median_imputation(spark, sf_dir):
    """E14 + P18: sqm and a ratio that is infinite for one room, imputed with the pre-holdout medians."""
    extra = F.when(F.col("no_rooms") == 1, F.lit(math.inf)).otherwise(F.col("sqm") / (F.col("no_rooms") - 1))
    d = X.median_imputation(_b(spark, sf_dir).withColumn("sqm_per_extra_room", extra), ["sqm", "sqm_per_extra_room"], "year", CFG.holdout_start_year, M)
    return d.select(*KEY, "sqm", "sqm_per_extra_room")


@register("temporal_split", ("E15",), with_layers(f"""
SELECT count(*) FILTER (WHERE year_sale <= {CFG.split_last_train_year}) AS train_size,
       count(*) FILTER (WHERE year_sale >= {CFG.split_last_train_year + 1}) AS test_size,
       CAST(count(*) FILTER (WHERE year_sale <= {CFG.split_last_train_year}) AS DOUBLE) / count(*) * 100.0 AS train_pct,
       CAST(count(*) FILTER (WHERE year_sale >= {CFG.split_last_train_year + 1}) AS DOUBLE) / count(*) * 100.0 AS test_pct,
       concat_ws('-', min(year_sale) FILTER (WHERE year_sale <= {CFG.split_last_train_year}),
                      max(year_sale) FILTER (WHERE year_sale <= {CFG.split_last_train_year})) AS train_period,
       concat_ws('-', min(year_sale) FILTER (WHERE year_sale >= {CFG.split_last_train_year + 1}),
                      max(year_sale) FILTER (WHERE year_sale >= {CFG.split_last_train_year + 1})) AS test_period
FROM bronze"""))
def temporal_split(spark, sf_dir):
    """Temporal train/test split summary."""
    return X.temporal_split_summary(_b(spark, sf_dir), "year", CFG.split_last_train_year)


_FOLDS = [(i, te, te + 1) for i, te in enumerate(range(CFG.cv_min_train_end, CFG.cv_max_train_end + 1))
          if te + 1 < CFG.holdout_start_year]


@register("walk_forward_folds", ("E16",), with_layers(
    "SELECT f.fold_id, f.train_end, f.val_year, count(*) FILTER (WHERE b.year_sale <= f.train_end) AS train_size, "
    "count(*) FILTER (WHERE b.year_sale = f.val_year) AS val_size FROM (VALUES "
    + ", ".join(f"({i}, {te}, {v})" for i, te, v in _FOLDS)
    + ") f(fold_id, train_end, val_year) CROSS JOIN bronze b GROUP BY f.fold_id, f.train_end, f.val_year"))
def walk_forward_folds(spark, sf_dir):
    """Expanding walk-forward folds and their sizes."""
    folds = X.fold_table(spark, CFG.cv_min_train_end, CFG.cv_max_train_end, CFG.holdout_start_year)
    return X.walk_forward_sizes(_b(spark, sf_dir), folds, "year")


# Fitted once, stored, applied to later rows --------------------------
HOUSE_TYPES = ("Economy", "Large", "Medium", "Promo", "Small", "Standard")
RARE_AREA_SHARE = 0.04
_STORED: dict = {}


def fitted_steps():
    """The steps of the holdout query, unfitted."""
    from pyspark.ml import Pipeline

    from hearth.operators import fitted as S

    return Pipeline(stages=[
        S.SizeCategories(cols=["sqm", "sqm_price"]), S.MedianImputer(cols=["sqm"]), S.RareCategories(cols=["area"], threshold=RARE_AREA_SHARE),
        S.TargetEncoder(cols=["house_type"], target="purchase_price"), S.RegionEncoder(cols=["region"], target="purchase_price"),
        S.OneHot(cols=["house_type", "zip_code"]), S.Scaler(cols=["sqm", "no_rooms"], kind="standard"), S.Scaler(cols=["sqm_price"], kind="robust"),
        S.Scaler(cols=["year_build"], kind="minmax")])


def stored_steps(spark, sf_dir) -> str:
    """The folder of the steps fitted on the training years (fitted once per session and input)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{_root(spark)}/fitted-steps-{spark.sparkContext.applicationId}-{len(_STORED)}"
        fitted_steps().fit(_b(spark, sf_dir).where(F.col("year") <= CFG.split_last_train_year)).write().overwrite().save(path)
        _STORED[key] = path
    return _STORED[key]


@register("fitted_features_holdout", ("E18", "S16", "E2", "E3", "E4", "E5", "E6", "E7", "E8", "E9", "E14", "F5", "J8", "J10"), with_ctes(f"""
fit AS (SELECT * FROM bronze WHERE year_sale <= {CFG.split_last_train_year}),
fs AS (SELECT quantile_cont(sqm, 0.33) AS s33, quantile_cont(sqm, 0.67) AS s67, quantile_cont(sqm_price, 0.25) AS p25, quantile_cont(sqm_price, 0.5) AS p50,
         quantile_cont(sqm_price, 0.75) AS p75, quantile_cont(sqm, 0.5) AS med, avg(purchase_price) AS gm, count(*) AS n, avg(no_rooms) AS ra, stddev_pop(no_rooms) AS rb,
         min(year_build) AS ya, max(year_build) AS yb FROM fit),
fi AS (SELECT avg(coalesce(sqm, med)) AS sa, stddev_pop(coalesce(sqm, med)) AS sb FROM fit CROSS JOIN fs),
fa AS (SELECT area FROM fit WHERE area IS NOT NULL GROUP BY area HAVING count(*) / (SELECT n FROM fs) >= {RARE_AREA_SHARE}),
fh AS (SELECT house_type, (count(purchase_price) * avg(purchase_price) + 10.0 * (SELECT gm FROM fs)) / (count(purchase_price) + 10.0) AS enc FROM fit
       WHERE house_type IS NOT NULL GROUP BY house_type),
fr AS (SELECT region, avg(purchase_price) AS m, count(*) AS n FROM fit WHERE region IS NOT NULL GROUP BY region)""", f"""
SELECT house_id, b.no_rooms, date, b.purchase_price,
       CASE WHEN b.sqm <= s33 THEN 'Small' WHEN b.sqm <= s67 THEN 'Medium' ELSE 'Large' END AS size_category,
       CASE WHEN sqm_price <= p25 THEN 'Very Efficient' WHEN sqm_price <= p50 THEN 'Efficient' WHEN sqm_price <= p75 THEN 'Average' ELSE 'Premium' END AS sqm_price_category,
       CASE WHEN fa.area IS NOT NULL THEN b.area WHEN b.area IS NOT NULL THEN 'Other' END AS area_grouped,
       coalesce(fh.enc, gm) AS house_type_target_encoded, fr.m AS region_price_mean, fr.n AS region_frequency,
       CASE WHEN fr.n >= 100 THEN fr.m ELSE fr.n / 100.0 * fr.m + (1 - fr.n / 100.0) * gm END AS region_target_encoded,
       {", ".join(f"CASE WHEN b.house_type = '{h}' THEN 1 ELSE 0 END AS house_type_{h}" for h in HOUSE_TYPES[1:])},
       (coalesce(b.sqm, med) - sa) / sb AS sqm_scaled, (b.no_rooms - ra) / rb AS no_rooms_scaled, (sqm_price - p50) / (p75 - p25) AS sqm_price_robust,
       (year_build - ya) / CAST(yb - ya AS DOUBLE) AS year_build_minmax
FROM bronze b CROSS JOIN fs CROSS JOIN fi LEFT JOIN fa ON b.area = fa.area LEFT JOIN fh ON b.house_type = fh.house_type LEFT JOIN fr ON b.region = fr.region
WHERE year_sale > {CFG.split_last_train_year}"""))
def fitted_features_holdout(spark, sf_dir):
    """E18 + S16: encoders, thresholds, imputation and scalers fitted on the training years, stored, read back and applied to the later years."""
    from pyspark.ml import PipelineModel

    out = PipelineModel.load(stored_steps(spark, sf_dir)).transform(_b(spark, sf_dir).where(F.col("year") > CFG.split_last_train_year))
    return out.select(*KEY, "size_category", "sqm_price_category", "area_grouped", "house_type_target_encoded", "region_price_mean", "region_frequency",
                      "region_target_encoded", *[f"house_type_{h}" for h in HOUSE_TYPES[1:]], "sqm_scaled", "no_rooms_scaled", "sqm_price_robust", "year_build_minmax")
