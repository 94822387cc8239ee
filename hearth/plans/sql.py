"""DuckDB oracle SQL for the medallion layers (the views ``raw``, ``bronze``,
``silver``, ``clean``), used by ``oracle_sql()`` to check the Spark jobs.

These are independent restatements of each operator's definition in plain
SQL, not the code path the Spark jobs run.
"""

from __future__ import annotations

from hearth.config import DRIVER_CONFIG, EngineConfig
from hearth.sources.tables import RAW_SALES_SQL


def title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower(trim({x})), '(\\p{{L}}+|\\P{{L}}+)', 1), "
            f"lambda t: upper(substr(t, 1, 1)) || substr(t, 2)), '')")


def r(x: str, d: int = 4) -> str:
    m = float(10 ** d)
    return f"(round(CAST({x} AS DOUBLE) * {m}) / {m})"


def layers(cfg: EngineConfig = DRIVER_CONFIG) -> str:
    fam = ", ".join(f"'{s.lower()}'" for s in cfg.family_sale_types)
    lo, hi = cfg.outlier_quantiles
    base = str(cfg.cpi_base_year)
    excl = " AND ".join(f"NOT coalesce({f}, false)" for f in cfg.exclude_flags) or "true"
    return f"""
raw AS ({RAW_SALES_SQL}),
bronze AS (
  SELECT date, house_id,
         {title('house_type')} AS house_type, {title('sales_type')} AS sales_type,
         {title('region')} AS region, {title('area')} AS area,
         CASE WHEN length(trim(zip_code)) < 4 THEN lpad(trim(zip_code), 4, '0') ELSE trim(zip_code) END AS zip_code,
         purchase_price, sqm, sqm_price, no_rooms, year_build,
         "dk_ann_infl_rate%", "yield_on_mortgage_credit_bonds%", "%_change_between_offer_and_purchase",
         CAST(year(date) AS INTEGER) AS year_sale,
         CAST(year(date) AS VARCHAR) || '-Q' || CAST(quarter(date) AS VARCHAR) AS quarter_id
  FROM raw),
zipc AS (SELECT zip_code, count(*) AS _zip_n FROM bronze WHERE zip_code IS NOT NULL GROUP BY zip_code),
pq AS (SELECT house_type, quantile_cont(purchase_price, {lo}) AS _p_lo, quantile_cont(purchase_price, {hi}) AS _p_hi
       FROM bronze WHERE house_type IS NOT NULL GROUP BY house_type),
cpi0 AS (SELECT quarter_id, quantile_cont("dk_ann_infl_rate%", 0.5) AS dk_ann_infl_rate_pct
         FROM bronze WHERE quarter_id IS NOT NULL GROUP BY quarter_id),
cpi AS (SELECT quarter_id, dk_ann_infl_rate_pct,
               CASE WHEN dk_ann_infl_rate_pct IS NOT NULL THEN
                 product(power(1 + dk_ann_infl_rate_pct / 100.0, 0.25)) OVER (ORDER BY quarter_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
               END AS cpi_index_q
        FROM cpi0),
cpib AS (SELECT CASE WHEN max(CASE WHEN substr(quarter_id, 1, 4) = '{base}' THEN 1 ELSE 0 END) = 1
                     THEN arg_max(cpi_index_q, quarter_id) FILTER (WHERE substr(quarter_id, 1, 4) = '{base}')
                     ELSE arg_max(cpi_index_q, quarter_id) END AS _cpi_base
         FROM cpi),
silver AS (
  SELECT b.*,
         coalesce(b.year_sale < 1995, false) AS is_pre_1995_record,
         coalesce(lower(trim(b.sales_type)) IN ({fam}), false) AS is_family_sale,
         coalesce(b.sales_type = '-' OR lower(b.sales_type) = 'nan', false) OR b.sales_type IS NULL AS is_unclassified_sale,
         coalesce(b.sqm IS NULL OR b.sqm <= 0, false) AS is_missing_sqm,
         b.year_build IS NULL AS is_missing_year_build,
         coalesce(z._zip_n < {cfg.low_sample_threshold}, false) AS is_low_sample_cell,
         coalesce(b.purchase_price < pq._p_lo OR b.purchase_price > pq._p_hi, false) AS is_outlier_price,
         c.cpi_index_q,
         b.purchase_price * (cb._cpi_base / c.cpi_index_q) AS real_purchase_price,
         b.sqm_price * (cb._cpi_base / c.cpi_index_q) AS real_sqm_price
  FROM bronze b
  LEFT JOIN zipc z ON b.zip_code = z.zip_code
  LEFT JOIN pq ON b.house_type = pq.house_type
  LEFT JOIN cpi c ON b.quarter_id = c.quarter_id
  CROSS JOIN cpib cb),
clean AS (SELECT * FROM silver WHERE {excl})"""


def with_layers(body: str, cfg: EngineConfig = DRIVER_CONFIG) -> str:
    """The layer views followed by one SELECT statement."""
    return f"WITH {layers(cfg)}\n{body}"


def with_ctes(ctes: str, select: str, cfg: EngineConfig = DRIVER_CONFIG) -> str:
    """The layer views, further CTEs (``name AS (...), ...``) and a SELECT."""
    return f"WITH {layers(cfg)},\n{ctes}\n{select}"
