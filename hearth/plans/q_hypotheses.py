"""Hypothesis-study queries (A27-A28, W16-W22, T1 p, T3, T4, T6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.config import DRIVER_CONFIG as CFG
from hearth.functions.dist import f_pvalue, t_pvalue
from hearth.operators import describe as D
from hearth.operators import hypotheses as H
from hearth.plans.layers import bronze_table, materialize
from hearth.plans.registry import register
from hearth.plans.sql import with_ctes

M = CFG.quantile_mode
# Study parameters for the driver data (the reference's maps name Danish regions
# and types; unmapped values fall back to themselves).
REGION_MAP = {"Europe": "Europe (EU)", "America": "Americas"}
TYPE_MAP = {"Standard": "House", "Medium": "House", "Small": "Apartment", "Economy": "Apartment", "Large": "Summerhouse"}
REGION_A, REGION_B, H2_TYPE = "Europe (EU)", "Asia", "House"
EPISODES = (("E1", "1995-01-01", "1997-12-31"), ("E2", "1997-01-01", "1999-12-31"), ("E3", "1999-01-01", "2001-12-31"))
NORM_FROM = "1992-01-01"
MAX_LAG = 12


def _case_map(col: str, m: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in m.items()) + f" ELSE {col} END"


HYP_CTES = f"""
hb AS (SELECT date, sqm_price, purchase_price, region, house_type, "yield_on_mortgage_credit_bonds%" AS bond_yield,
              "dk_ann_infl_rate%" AS infl_rate, year(date) AS year, quarter(date) AS quarter_num,
              {_case_map('region', REGION_MAP)} AS region_clean, {_case_map('house_type', TYPE_MAP)} AS house_type_clean,
              date_trunc('quarter', date) AS quarter_date
       FROM bronze WHERE sales_type = 'Alm. Salg' AND date IS NOT NULL AND sqm_price IS NOT NULL
                     AND region IS NOT NULL AND house_type IS NOT NULL),
hq AS (SELECT quarter_date, quantile_cont(infl_rate, 0.5) AS r FROM hb GROUP BY quarter_date),
hc AS (SELECT quarter_date, product(power(1 + coalesce(r, 0.0) / 100.0, 0.25))
                OVER (ORDER BY quarter_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cpi_index FROM hq),
hbase AS (SELECT CASE WHEN max(CASE WHEN year(quarter_date) = {CFG.cpi_base_year} THEN 1 ELSE 0 END) = 1
                      THEN arg_max(cpi_index, quarter_date) FILTER (WHERE year(quarter_date) = {CFG.cpi_base_year})
                      ELSE arg_max(cpi_index, quarter_date) END AS b FROM hc),
hd AS (SELECT h.*, h.purchase_price * (hbase.b / hc.cpi_index) AS real_purchase_price,
              h.sqm_price * (hbase.b / hc.cpi_index) AS real_sqm_price
       FROM hb h JOIN hc ON h.quarter_date = hc.quarter_date CROSS JOIN hbase),
hagg AS (SELECT quarter_date, year, quarter_num, region_clean, house_type_clean, count(real_sqm_price) AS transactions,
                avg(bond_yield) AS bond_yield, quantile_cont(real_sqm_price, 0.5) AS price_sqm
         FROM hd GROUP BY quarter_date, year, quarter_num, region_clean, house_type_clean),
hm0 AS (SELECT quarter_date, count(real_sqm_price) AS total_vol, avg(bond_yield) AS bond_yield, min(year) AS year,
               quantile_cont(real_sqm_price, 0.5) AS price_idx FROM hd GROUP BY quarter_date),
hmacro AS (SELECT *, price_idx / coalesce(
                   (SELECT arg_min(price_idx, quarter_date) FROM hm0 WHERE quarter_date >= TIMESTAMP '{NORM_FROM}'),
                   (SELECT arg_min(price_idx, quarter_date) FROM hm0)) * 100.0 AS price_norm FROM hm0),
hm AS (SELECT *, row_number() OVER (ORDER BY quarter_date) AS i FROM hmacro WHERE bond_yield IS NOT NULL),
ccf AS (SELECT l.lag, corr(a.bond_yield, CAST(b.total_vol AS DOUBLE)) AS r
        FROM hm a CROSS JOIN (SELECT unnest(range(0, {MAX_LAG + 1})) AS lag) l JOIN hm b ON b.i = a.i + l.lag GROUP BY l.lag),
bl AS (SELECT arg_min(lag, struct_pack(r := r, l := lag)) AS peak_lag, min(r) AS peak_r FROM ccf),
bl2 AS (SELECT *, CASE WHEN peak_lag > 0 AND peak_lag <= 8 THEN peak_lag ELSE 2 END AS opt_lag FROM bl),
ry AS (SELECT region_clean, quarter_date, price_sqm,
              (price_sqm / lag(price_sqm, 4) OVER (PARTITION BY region_clean ORDER BY quarter_date) - 1) * 100.0 AS yoy
       FROM hagg WHERE house_type_clean = '{H2_TYPE}' AND region_clean IN ('{REGION_A}', '{REGION_B}')),
ryv AS (SELECT *, CASE WHEN count(yoy) OVER w >= 3 THEN stddev_samp(yoy) OVER w END AS yoy_vol4
        FROM ry WINDOW w AS (PARTITION BY region_clean ORDER BY quarter_date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""


def _prep(spark, sf_dir):
    """The study's cleaned, deflated sales (written once per session and input)."""
    return materialize(spark, "hyp_prep", lambda: H.prepare(bronze_table(spark, sf_dir, CFG), REGION_MAP, TYPE_MAP,
                                                             cpi_base_year=CFG.cpi_base_year, mode=M),
                       (sf_dir, repr(CFG), repr(REGION_MAP), repr(TYPE_MAP)))


def _agg(spark, sf_dir):
    """A27 quarterly table shared by the later steps (written once per session and input)."""
    return materialize(spark, "hyp_quarterly", lambda: H.quarterly_by_region_type(_prep(spark, sf_dir), M),
                       (sf_dir, repr(CFG), repr(REGION_MAP), repr(TYPE_MAP)))


@register("hyp_quarterly_agg", ("A27", "P12", "P15", "F17"), with_ctes(HYP_CTES, "SELECT * FROM hagg"))
def hyp_quarterly_agg(spark, sf_dir):
    """Quarterly median real sqm price, count and mean yield by region x type."""
    return _agg(spark, sf_dir)


@register("hyp_national_macro", ("A27", "W16"), with_ctes(HYP_CTES, "SELECT * FROM hmacro"))
def hyp_national_macro(spark, sf_dir):
    """A27 + W16: national quarterly series with the normalised price."""
    return H.national_macro(_prep(spark, sf_dir), NORM_FROM, M)


@register("hyp_national_by_type", ("A28", "W16"), with_ctes(HYP_CTES + """,
nt AS (SELECT house_type_clean, quarter_date, sum(transactions) AS transactions, quantile_cont(price_sqm, 0.5) AS price_sqm
       FROM hagg GROUP BY house_type_clean, quarter_date),
ntb AS (SELECT house_type_clean, coalesce(arg_min(price_sqm, quarter_date) FILTER (WHERE quarter_date >= TIMESTAMP '""" + NORM_FROM + """'),
                                          arg_min(price_sqm, quarter_date)) AS base FROM nt GROUP BY house_type_clean)""",
    "SELECT nt.*, nt.price_sqm / ntb.base * 100.0 AS price_norm FROM nt JOIN ntb ON nt.house_type_clean = ntb.house_type_clean"))
def hyp_national_by_type(spark, sf_dir):
    """National series per house type (median of regional medians)."""
    return H.national_by_type(_agg(spark, sf_dir), NORM_FROM, M)


@register("hyp_cross_correlation", ("W17",), with_ctes(HYP_CTES, """
SELECT CAST(c.lag AS INTEGER) AS lag, c.r, (SELECT count(*) FROM hm) AS n, 1.96 / sqrt((SELECT count(*) FROM hm)) AS ci95 FROM ccf c"""))
def hyp_cross_correlation(spark, sf_dir):
    """Cross-correlation of yield and volume by lag."""
    return H.cross_correlation(H.national_macro(_prep(spark, sf_dir), NORM_FROM, M), MAX_LAG)


@register("hyp_level_ols", ("W17", "W18"), with_ctes(HYP_CTES, """
SELECT CAST(bl2.peak_lag AS INTEGER) AS peak_lag, bl2.peak_r, CAST(bl2.opt_lag AS INTEGER) AS opt_lag,
       regr_slope(CAST(a.total_vol AS DOUBLE), b.bond_yield) AS slope, regr_intercept(CAST(a.total_vol AS DOUBLE), b.bond_yield) AS intercept,
       regr_r2(CAST(a.total_vol AS DOUBLE), b.bond_yield) AS r2, count(*) AS n
FROM hm a CROSS JOIN bl2 JOIN hm b ON b.i = a.i - bl2.opt_lag GROUP BY bl2.peak_lag, bl2.peak_r, bl2.opt_lag"""))
def hyp_level_ols(spark, sf_dir):
    """W17 + W18: most negative lag and the level OLS at the chosen lag."""
    m = H.national_macro(_prep(spark, sf_dir), NORM_FROM, M)
    best = H.best_negative_lag(H.cross_correlation(m, MAX_LAG))
    ols = H.level_ols(m, best)
    return best.join(ols, "opt_lag").select(F.col("peak_lag").cast("int"), "peak_r", F.col("opt_lag").cast("int"),
                                             "slope", "intercept", "r2", "n")


@register("hyp_level_ols_pvalue", ("W18",))
def hyp_level_ols_pvalue(spark, sf_dir):
    """Two-sided p of the level OLS slope (t with n - 2 df; no SQL form)."""
    m = H.national_macro(_prep(spark, sf_dir), NORM_FROM, M)
    o = H.level_ols(m, H.best_negative_lag(H.cross_correlation(m, MAX_LAG)))
    t = F.sqrt(F.try_divide(F.col("r2") * (F.col("n") - 2), 1 - F.col("r2")))  # NULL at r2 = 1
    return o.withColumn("p_value", t_pvalue(t, F.col("n") - 2))


@register("hyp_regional_yoy", ("W19",), with_ctes(HYP_CTES, "SELECT region_clean, quarter_date, price_sqm, yoy, yoy_vol4 FROM ryv"))
def hyp_regional_yoy(spark, sf_dir):
    """YoY change and rolling volatility of the two H2 regions."""
    agg = _agg(spark, sf_dir)
    s = agg.where((F.col("house_type_clean") == H2_TYPE) & F.col("region_clean").isin(REGION_A, REGION_B))
    return H.yoy_and_volatility(s, ["region_clean"]).select("region_clean", "quarter_date", "price_sqm", "yoy", "yoy_vol4")


LEVENE_CTES = HYP_CTES + f""",
cm AS (SELECT quarter_date FROM ryv WHERE yoy IS NOT NULL GROUP BY quarter_date HAVING count(*) = 2),
x AS (SELECT r.region_clean, r.yoy, abs(r.yoy) AS ab FROM ryv r JOIN cm ON r.quarter_date = cm.quarter_date),
xm AS (SELECT region_clean, median(yoy) AS med FROM x GROUP BY region_clean),
xz AS (SELECT x.*, abs(x.yoy - xm.med) AS z FROM x JOIN xm ON x.region_clean = xm.region_clean),
g AS (SELECT region_clean, count(*) AS n, avg(z) AS zm, avg(ab) AS am, var_samp(ab) AS av FROM xz GROUP BY region_clean),
tot AS (SELECT avg(z) AS zall, count(*) AS nn FROM xz),
sw AS (SELECT sum((xz.z - g.zm) * (xz.z - g.zm)) AS sw FROM xz JOIN g ON xz.region_clean = g.region_clean),
lv AS (SELECT (tot.nn - 2) / 1 * (SELECT sum(n * (zm - tot.zall) * (zm - tot.zall)) FROM g) / sw.sw AS levene_w,
              tot.nn - 2 AS levene_df2,
              max(am) FILTER (WHERE region_clean = '{REGION_A}') AS m1, max(am) FILTER (WHERE region_clean = '{REGION_B}') AS m2,
              max(av) FILTER (WHERE region_clean = '{REGION_A}') AS v1, max(av) FILTER (WHERE region_clean = '{REGION_B}') AS v2,
              max(n) FILTER (WHERE region_clean = '{REGION_A}') AS n1, max(n) FILTER (WHERE region_clean = '{REGION_B}') AS n2
       FROM g CROSS JOIN tot CROSS JOIN sw GROUP BY tot.nn, tot.zall, sw.sw)"""


@register("hyp_levene_ttest", ("T3", "T4"), with_ctes(LEVENE_CTES, """
SELECT levene_w, levene_df2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t_stat,
       n1 + n2 - 2 AS t_df FROM lv"""))
def hyp_levene_ttest(spark, sf_dir):
    """T3 + T4: Levene W and pooled t statistic between the two regions."""
    agg = _agg(spark, sf_dir)
    s = agg.where((F.col("house_type_clean") == H2_TYPE) & F.col("region_clean").isin(REGION_A, REGION_B))
    return H.levene_and_ttest(H.yoy_and_volatility(s, ["region_clean"]), "region_clean", REGION_A, REGION_B)


@register("hyp_levene_ttest_pvalues", ("T3", "T4"))
def hyp_levene_ttest_pvalues(spark, sf_dir):
    """T3 + T4 p-values (F(1, N-2) and t tails; no SQL form)."""
    r = hyp_levene_ttest(spark, sf_dir)
    return r.withColumns({"levene_p": f_pvalue(F.col("levene_w"), F.lit(1.0), F.col("levene_df2")),
                          "t_p": t_pvalue(F.col("t_stat"), F.col("t_df"))})


_EP_VALUES = ", ".join(f"('{e}', TIMESTAMP '{s}', TIMESTAMP '{t}')" for e, s, t in EPISODES)


@register("hyp_episode_drawdowns", ("W20", "W21", "W22"), with_ctes(HYP_CTES + f""",
nt AS (SELECT house_type_clean, quarter_date, quantile_cont(price_sqm, 0.5) AS price_sqm FROM hagg GROUP BY house_type_clean, quarter_date),
ep AS (SELECT * FROM (VALUES {_EP_VALUES}) e(episode, s, e)),
w AS (SELECT n.house_type_clean, ep.episode, n.quarter_date, n.price_sqm,
             row_number() OVER (PARTITION BY n.house_type_clean, ep.episode ORDER BY n.quarter_date) - 1 AS pos
      FROM nt n CROSS JOIN ep WHERE n.price_sqm IS NOT NULL AND n.quarter_date >= ep.s AND n.quarter_date <= ep.e),
pk AS (SELECT house_type_clean, episode, arg_min(pos, struct_pack(v := -price_sqm, p := pos)) AS ppos,
              max(price_sqm) AS pval FROM w GROUP BY house_type_clean, episode),
tr AS (SELECT w.house_type_clean, w.episode, pk.ppos, pk.pval, arg_min(w.pos, struct_pack(v := w.price_sqm, p := w.pos)) AS tpos,
              min(w.price_sqm) AS tval
       FROM w JOIN pk ON w.house_type_clean = pk.house_type_clean AND w.episode = pk.episode AND w.pos >= pk.ppos
       GROUP BY w.house_type_clean, w.episode, pk.ppos, pk.pval)""",
    """SELECT house_type_clean, episode, pval AS peak_value, tval AS trough_value, (tval - pval) / pval * 100.0 AS drawdown_pct,
       tpos - ppos AS quarters_to_trough FROM tr"""))
def hyp_episode_drawdowns(spark, sf_dir):
    """Drawdown and speed per house type and episode."""
    agg = _agg(spark, sf_dir)
    nt = H.national_by_type(agg, NORM_FROM, M)
    return H.bounded_drawdowns(nt, ["house_type_clean"], EPISODES).withColumn(
        "quarters_to_trough", F.col("quarters_to_trough").cast("long"))


@register("volume_price_trend", ("T6",), with_ctes("""
vol0 AS (SELECT region, count(purchase_price) AS n_transactions, round_even(avg(sqm_price), 0) AS mean_sqm_price
         FROM bronze WHERE region IS NOT NULL GROUP BY region)""",
    """SELECT regr_slope(mean_sqm_price, log10(CAST(n_transactions AS DOUBLE))) AS slope,
       regr_intercept(mean_sqm_price, log10(CAST(n_transactions AS DOUBLE))) AS intercept,
       regr_r2(mean_sqm_price, log10(CAST(n_transactions AS DOUBLE))) AS r2 FROM vol0"""))
def volume_price_trend(spark, sf_dir):
    """Trend of mean sqm price on log10(volume) across regions."""
    return H.volume_price_trend(D.volume_stats(bronze_table(spark, sf_dir, CFG), "region"))


@register("anova_house_type_pvalue", ("T1",))
def anova_house_type_pvalue(spark, sf_dir):
    """ANOVA F with its p-value (F tail; no SQL form)."""
    a = D.anova_oneway(bronze_table(spark, sf_dir, CFG), "house_type", "purchase_price")
    return a.withColumn("p_value", f_pvalue(F.col("f_stat"), F.col("df_between"), F.col("df_within")))
