"""Medallion queries: Bronze, Silver, CPI, the five Gold KPIs, STL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.config import DRIVER_CONFIG as CFG
from hearth.config import MIN_ELASTICITY_OBS
from hearth.operators import gold, stl
from hearth.functions.quantile import attach_quantiles
from hearth.operators.silver import FLAGS, cpi_chain
from hearth.plans.layers import bronze_table, figures, price_index_table, silver_table
from hearth.plans.registry import register
from hearth.functions.scalar import round_to
from hearth.plans.sql import r, with_ctes, with_layers

BRONZE_COLS = ("house_id", "house_type", "sales_type", "region", "area", "zip_code", "purchase_price", "sqm",
               "sqm_price", "no_rooms", "year_build", "year_sale", "quarter_id")


@register("bronze_enforced", ("S1", "P1", "P2", "P3"), with_layers(
    "SELECT " + ", ".join(r(c) + f" AS {c}" if c in ("purchase_price", "sqm", "sqm_price") else c for c in BRONZE_COLS)
    + ', ' + r('"dk_ann_infl_rate%"') + ' AS infl_pct FROM bronze'))
def bronze_enforced(spark, sf_dir):
    """Bronze rows: title-cased strings, padded zips, typed numbers, quarter keys."""
    b = bronze_table(spark, sf_dir, CFG)
    return b.select(*BRONZE_COLS, F.col("dk_ann_infl_rate%").alias("infl_pct"))


@register("silver_flags", ("P4", "P5", "P6", "P7", "P8", "P9", "J1", "J2", "W2"), with_layers(
    "SELECT house_id, region, quarter_id, zip_code, house_type, "
    + ", ".join(FLAGS) + ", " + r("cpi_index_q") + " AS cpi_index_q, "
    + r("real_purchase_price") + " AS real_purchase_price, " + r("real_sqm_price") + " AS real_sqm_price FROM silver"))
def silver_flags(spark, sf_dir):
    """Silver rows with the quality flags and real (deflated) prices."""
    s = silver_table(spark, sf_dir, CFG)
    return s.select("house_id", "region", "quarter_id", "zip_code", "house_type", *FLAGS,
                    "cpi_index_q", "real_purchase_price", "real_sqm_price")


@register("cpi_index", ("A1", "W1"), with_layers(
    f"SELECT quarter_id, {r('dk_ann_infl_rate_pct')} AS dk_ann_infl_rate_pct, {r('cpi_index_q', 8)} AS cpi_index_q FROM cpi"),
    digits=None)
def cpi_index(spark, sf_dir):
    """Quarterly median inflation and chained CPI."""
    c = cpi_chain(bronze_table(spark, sf_dir, CFG), CFG)
    return c.select("quarter_id", round_to("dk_ann_infl_rate_pct", 4).alias("dk_ann_infl_rate_pct"),
                    round_to("cpi_index_q", 8).alias("cpi_index_q"))


@register("silver_flag_counts", ("S9", "A29", "J11"), with_layers(
    "SELECT count(*) AS output_row_count, "
    + ", ".join(f"sum(CAST({f} AS BIGINT)) AS n_{f}" for f in FLAGS) + " FROM silver"))
def silver_flag_counts(spark, sf_dir):
    """Silver manifest figures: rows and true count of every flag, as the write of Silver counted them (J11: as many rows as Bronze)."""
    silver_table(spark, sf_dir, CFG)
    seen = figures(spark, "silver", sf_dir, repr(CFG))
    return spark.createDataFrame([(seen["rows"], *[seen[f] for f in FLAGS])], ", ".join(["output_row_count long", *[f"n_{f} long" for f in FLAGS]]))


@register("silver_quality_by_quarter", ("A29", "W2"), with_layers("""
SELECT quarter_id, count(*) AS n_sales, quantile_cont(purchase_price, 0.5) AS nominal_median, quantile_cont(real_purchase_price, 0.5) AS real_median,
       quantile_cont(sqm_price, 0.5) AS nominal_sqm_median, quantile_cont(real_sqm_price, 0.5) AS real_sqm_median
FROM silver GROUP BY quarter_id"""))
def silver_quality_by_quarter(spark, sf_dir):
    """Sales and nominal against real medians of every quarter."""
    s = silver_table(spark, sf_dir, CFG)
    wanted = {"purchase_price": "nominal_median", "real_purchase_price": "real_median", "sqm_price": "nominal_sqm_median", "real_sqm_price": "real_sqm_median"}
    return attach_quantiles(s.groupBy("quarter_id").agg(F.count(F.lit(1)).alias("n_sales")), s, ["quarter_id"], {c: [(0.5, n)] for c, n in wanted.items()})


PRICE_INDEX_SQL_CTES = f"""
pi_q AS (SELECT region, quarter_id, quantile_cont(real_sqm_price, 0.5) AS real_sqm_price_median, count(*) AS n_transactions
         FROM clean WHERE real_sqm_price IS NOT NULL AND region IS NOT NULL AND quarter_id IS NOT NULL GROUP BY region, quarter_id),
pi_b AS (SELECT region, quantile_cont(real_sqm_price, 0.5) AS _base_median
         FROM clean WHERE real_sqm_price IS NOT NULL AND region IS NOT NULL AND quarter_id IS NOT NULL AND year_sale = {CFG.base_index_year}
         GROUP BY region),
price_index AS (SELECT q.region, q.quarter_id, q.real_sqm_price_median, q.n_transactions,
                       q.real_sqm_price_median / b._base_median * 100.0 AS price_index,
                       CAST(substr(q.quarter_id, 1, 4) AS INTEGER) AS year_sale,
                       CAST(substr(q.quarter_id, 7, 1) AS INTEGER) AS quarter_num
                FROM pi_q q LEFT JOIN pi_b b ON q.region = b.region)"""


@register("kpi_price_index", ("A2", "A3", "J4", "P11", "F16", "P19"), with_ctes(
    PRICE_INDEX_SQL_CTES,
    f"SELECT region, quarter_id, {r('real_sqm_price_median')} AS real_sqm_price_median, n_transactions, "
    f"{r('price_index')} AS price_index, year_sale, quarter_num FROM price_index"))
def kpi_price_index(spark, sf_dir):
    """KPI 1: regional real sqm-price index (base year = 100)."""
    return price_index_table(spark, sf_dir, CFG)


@register("kpi_transaction_volume", ("A4", "W4"), with_layers(
    """SELECT region, quarter_id, house_type, n_transactions,
              CAST(substr(quarter_id, 1, 4) AS INTEGER) AS year_sale, CAST(substr(quarter_id, 7, 1) AS INTEGER) AS quarter_num,
              round_even(CAST(n_transactions AS DOUBLE) / sum(n_transactions) OVER (PARTITION BY region, substr(quarter_id, 1, 4)) * 100.0, 2)
                AS pct_of_annual_total
       FROM (SELECT region, quarter_id, house_type, count(*) AS n_transactions FROM silver
             WHERE region IS NOT NULL AND quarter_id IS NOT NULL AND house_type IS NOT NULL
             GROUP BY region, quarter_id, house_type)"""))
def kpi_transaction_volume(spark, sf_dir):
    """KPI 2: transactions by region, quarter and house type with annual share."""
    return gold.transaction_volume(silver_table(spark, sf_dir, CFG))


def _shock_sql(col: str) -> str:
    y = f"CAST(substr({col}, 1, 4) AS INTEGER)"
    return "coalesce(" + ", ".join(f"CASE WHEN abs({y} - {s}) <= 1 THEN '{s}' END" for s in CFG.macro_shock_years) + ")"


DRAWDOWN_SQL_CTES = PRICE_INDEX_SQL_CTES + f""",
dd0 AS (SELECT region, quarter_id, price_index,
               row_number() OVER (PARTITION BY region ORDER BY quarter_id) - 1 AS i,
               max(price_index) OVER (PARTITION BY region ORDER BY quarter_id ROWS UNBOUNDED PRECEDING) AS cm
        FROM price_index),
dd1 AS (SELECT *, (price_index - cm) / cm AS dd,
               lag(cm) OVER (PARTITION BY region ORDER BY quarter_id) AS prev_cm FROM dd0),
dd2 AS (SELECT *,
               last_value(CASE WHEN dd < {CFG.drawdown_enter} THEN 1 WHEN dd > {CFG.drawdown_exit} THEN 0 END IGNORE NULLS)
                 OVER (PARTITION BY region ORDER BY quarter_id ROWS UNBOUNDED PRECEDING) AS st,
               last_value(CASE WHEN price_index = cm AND (prev_cm IS NULL OR cm > prev_cm) THEN i END IGNORE NULLS)
                 OVER (PARTITION BY region ORDER BY quarter_id ROWS UNBOUNDED PRECEDING) AS peak_i
        FROM dd1),
dd2b AS (SELECT *, lag(st) OVER (PARTITION BY region ORDER BY quarter_id) AS prev_st FROM dd2),
dd3 AS (SELECT *, sum(CASE WHEN st = 1 AND coalesce(prev_st, 0) = 0 THEN 1 ELSE 0 END)
                    OVER (PARTITION BY region ORDER BY quarter_id ROWS UNBOUNDED PRECEDING) AS ep
        FROM dd2b),
eps AS (SELECT region, ep, min(peak_i) AS pi, arg_min(i, struct_pack(dd := dd, i := i)) AS ti
        FROM dd3 WHERE st = 1 AND dd IS NOT NULL GROUP BY region, ep)"""

DRAWDOWN_SQL_SELECT = f"""
SELECT e.region, p.quarter_id AS peak_quarter_id, t.quarter_id AS trough_quarter_id,
       {r('p.price_index')} AS peak_index, {r('t.price_index')} AS trough_index,
       {r('round_even(t.dd * 100.0, 2)')} AS drawdown_pct, t.i - e.pi AS drawdown_duration_quarters,
       'All' AS house_type, {_shock_sql('t.quarter_id')} AS macro_shock_label
FROM eps e JOIN dd0 p ON p.region = e.region AND p.i = e.pi
JOIN dd1 t ON t.region = e.region AND t.i = e.ti"""


@register("kpi_drawdown", ("W5", "W6"), with_ctes(DRAWDOWN_SQL_CTES, DRAWDOWN_SQL_SELECT))
def kpi_drawdown(spark, sf_dir):
    """KPI 3: peak-to-trough episodes of the regional index."""
    return gold.drawdown(price_index_table(spark, sf_dir, CFG), CFG)


@register("kpi_volatility", ("W8",), with_ctes(PRICE_INDEX_SQL_CTES, "SELECT region, quarter_id, " + ", ".join(
    f"""{r(f"CASE WHEN count(real_sqm_price_median) OVER (PARTITION BY region ORDER BY quarter_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} "
           f"THEN stddev_samp(real_sqm_price_median) OVER (PARTITION BY region ORDER BY quarter_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END")} AS rolling_{n}q_std"""
    for n in CFG.volatility_windows)
    + ", year_sale, quarter_num FROM price_index"))
def kpi_volatility(spark, sf_dir):
    """KPI 4: rolling 4/8-quarter std of the quarterly median."""
    return gold.volatility(price_index_table(spark, sf_dir, CFG), CFG)


ELASTICITY_SQL_CTES = f"""
yq AS (SELECT quarter_id, quantile_cont("yield_on_mortgage_credit_bonds%", 0.5) AS yield_median FROM silver
       WHERE quarter_id IS NOT NULL GROUP BY quarter_id),
vq AS (SELECT quarter_id, count(*) AS n_transactions FROM silver
       WHERE region IS NOT NULL AND quarter_id IS NOT NULL AND house_type IS NOT NULL GROUP BY quarter_id),
vd AS (SELECT quarter_id, (CAST(n_transactions AS DOUBLE) / lag(n_transactions) OVER (ORDER BY quarter_id) - 1) * 100.0 AS dv FROM vq),
yd AS (SELECT quarter_id, (yield_median - lag(yield_median) OVER (ORDER BY quarter_id)) * 100.0 AS dy FROM yq WHERE yield_median IS NOT NULL),
m2 AS (SELECT v.quarter_id, row_number() OVER (ORDER BY v.quarter_id) AS rn, dv, dy FROM vd v JOIN yd y ON v.quarter_id = y.quarter_id),
lags AS (SELECT unnest({list(CFG.elasticity_lags)}) AS lag_quarters),
pairs AS (SELECT l.lag_quarters, a.quarter_id, a.dv, b.dy AS yl FROM m2 a CROSS JOIN lags l
          LEFT JOIN m2 b ON b.rn = a.rn - l.lag_quarters
          WHERE a.dv IS NOT NULL AND b.dy IS NOT NULL),
res AS (SELECT lag_quarters, regr_slope(dv, yl) AS b, regr_r2(dv, yl) AS r2, regr_sxx(dv, yl) AS sxx, regr_syy(dv, yl) AS syy,
               count(*) AS n_observations, min(quarter_id) AS q0, max(quarter_id) AS q1 FROM pairs GROUP BY lag_quarters)"""
ELASTICITY_SQL = with_ctes(ELASTICITY_SQL_CTES, f"""SELECT 'National' AS region, CAST(lag_quarters AS INTEGER) AS lag_quarters, {r('round_even(b, 4)')} AS beta_ols,
       {r('round_even(sqrt((1 - r2) * syy / ((n_observations - 2) * sxx)), 4)')} AS beta_ols_se, {r('round_even(r2, 4)')} AS r2,
       n_observations, q0 || '–' || q1 AS period_label, 'confounded_OLS' AS causal_warning
FROM res WHERE n_observations >= {MIN_ELASTICITY_OBS}""")


@register("kpi_bond_elasticity", ("A5", "W9", "W10", "W11", "J6"), ELASTICITY_SQL)
def kpi_bond_elasticity(spark, sf_dir):
    """KPI 5: volume/bond-yield elasticity by lag (observational OLS)."""
    s = silver_table(spark, sf_dir, CFG)
    return gold.bond_elasticity(gold.transaction_volume(s), s, CFG)


@register("stl_components", ("W3", "W25"))
def stl_components(spark, sf_dir):
    """STL trend/seasonal/residual of the quarterly median per region (no SQL form)."""
    return stl.stl_per_region(silver_table(spark, sf_dir, CFG), CFG)


@register("kpi_price_index_with_trend", ("J5",))
def kpi_price_index_with_trend(spark, sf_dir):
    """KPI 1 with the STL trend joined on (region, quarter)."""
    s = silver_table(spark, sf_dir, CFG)
    return gold.price_index(s, CFG, stl=stl.stl_per_region(s, CFG))
