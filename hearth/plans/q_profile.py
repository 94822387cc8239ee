"""Profiling / data-quality queries over the Bronze sales table, documents and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.config import DRIVER_CONFIG as CFG
from hearth.operators import normality as N
from hearth.operators import profile as P
from hearth.plans.layers import bronze_table
from hearth.plans.registry import register
from hearth.plans.sql import with_ctes, with_layers
from hearth.sources.tables import read_table

M = CFG.quantile_mode
# Bronze columns profiled (audit columns are per-run values and left out), with their Spark types.
PROFILE_TYPES = {
    "date": "timestamp_ntz", "house_id": "bigint", "house_type": "string", "sales_type": "string", "region": "string",
    "area": "string", "zip_code": "string", "purchase_price": "double", "sqm": "double", "sqm_price": "double",
    "no_rooms": "bigint", "year_build": "bigint", "dk_ann_infl_rate%": "double",
    "yield_on_mortgage_credit_bonds%": "double", "%_change_between_offer_and_purchase": "double",
    "year_sale": "int", "quarter_id": "string",
}
PROFILE_COLS = tuple(PROFILE_TYPES)
NUM_COLS = tuple(c for c, t in PROFILE_TYPES.items() if t in ("double", "bigint", "int"))
CAT_COLS = tuple(c for c, t in PROFILE_TYPES.items() if t == "string")


def q(c: str) -> str:
    return f'"{c}"'


def _prof(spark, sf_dir):
    return bronze_table(spark, sf_dir, CFG).select(*[F.col(f"`{c}`") for c in PROFILE_COLS])


def _union(parts):
    return " UNION ALL ".join(parts)


@register("null_summary", ("Q1",), with_layers(
    "SELECT column_name, n_null, null_percentage, printf('%.2f %%', null_percentage) AS null_percentage_text FROM ("
    + _union(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {q(c)} IS NULL) AS n_null, "
             f"CAST(count(*) FILTER (WHERE {q(c)} IS NULL) AS DOUBLE) / count(*) * 100.0 AS null_percentage FROM bronze"
             for c in PROFILE_COLS) + ") WHERE n_null > 0"))
def null_summary(spark, sf_dir):
    """Q1: null share per column."""
    return P.null_summary(_prof(spark, sf_dir))


@register("rows_with_nulls", ("P14",), with_layers(
    "SELECT count(*) AS n_rows_with_nulls FROM bronze WHERE " + " OR ".join(f"{q(c)} IS NULL" for c in PROFILE_COLS)))
def rows_with_nulls(spark, sf_dir):
    """Number of rows with any null."""
    return P.rows_with_nulls(_prof(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_rows_with_nulls"))


@register("column_profile", ("Q2", "A32"), with_layers(_union(
    f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(DISTINCT {q(c)}) AS n_unique, "
    f"count(*) FILTER (WHERE {q(c)} IS NULL) AS n_missing FROM bronze" for c, t in PROFILE_TYPES.items())))
def column_profile(spark, sf_dir):
    """Q2: dtype, distinct values and missing values per column."""
    return P.column_profile(_prof(spark, sf_dir))


def _dup_sql(cols):
    g = ", ".join(q(c) for c in cols)
    return (f"SELECT n_rows, n_distinct, n_in_duplicate_groups, n_rows - n_distinct AS n_duplicated, "
            f"round_even(CAST(n_rows - n_distinct AS DOUBLE) / n_rows * 100.0, 2) AS duplicate_pct FROM ("
            f"SELECT sum(k) AS n_rows, count(*) AS n_distinct, sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS n_in_duplicate_groups "
            f"FROM (SELECT {g}, count(*) AS k FROM bronze GROUP BY ALL))")


@register("duplicate_rows", ("A30",), with_layers(_dup_sql(PROFILE_COLS)))
def duplicate_rows(spark, sf_dir):
    """Full-row duplicates."""
    return P.duplicate_stats(_prof(spark, sf_dir))


@register("duplicate_keys", ("A31",), with_layers(_dup_sql(("house_id",))))
def duplicate_keys(spark, sf_dir):
    """Duplicates on a key subset (keep=False counts all members)."""
    return P.duplicate_stats(_prof(spark, sf_dir), ["house_id"])


@register("quality_report", ("Q3", "Q4"), with_ctes(
    f"""nn AS ({_union(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {q(c)} IS NULL) AS n_null FROM bronze" for c in PROFILE_COLS)}),
dup AS ({_dup_sql(PROFILE_COLS)})""",
    f"""SELECT (SELECT count(*) FROM bronze) AS n_rows, {len(PROFILE_COLS)} AS n_columns,
       (SELECT count(*) FROM bronze) * {len(PROFILE_COLS)} AS total_cells,
       (SELECT sum(n_null) FROM nn) AS missing_cells,
       (SELECT count(*) FROM nn WHERE n_null > 0) AS columns_with_missing,
       (SELECT n_duplicated FROM dup) AS duplicate_rows,
       CAST((SELECT sum(n_null) FROM nn) AS DOUBLE) / ((SELECT count(*) FROM bronze) * {len(PROFILE_COLS)}) * 100.0 AS missing_percentage,
       CAST((SELECT n_duplicated FROM dup) AS DOUBLE) / (SELECT count(*) FROM bronze) * 100.0 AS duplicate_percentage,
       {len(NUM_COLS)} AS n_numeric_columns, {len(CAT_COLS)} AS n_string_columns,
       {len(PROFILE_COLS) - len(NUM_COLS) - len(CAT_COLS)} AS n_other_columns"""))
def quality_report(spark, sf_dir):
    """Q3/Q4: data-quality report (one row)."""
    return P.quality_report(_prof(spark, sf_dir)).select(
        F.col("n_rows"), F.col("n_columns"), F.col("total_cells"), F.col("missing_cells"),
        F.col("columns_with_missing"), F.col("duplicate_rows"), "missing_percentage", "duplicate_percentage",
        "n_numeric_columns", "n_string_columns", "n_other_columns")


def numeric_profile_sql(src: str, cols) -> tuple[str, str]:
    long = _union(f"SELECT '{c}' AS column_name, CAST({q(c)} AS DOUBLE) AS value FROM {src}" for c in cols)
    ctes = f"""
lng AS ({long}),
nrow AS (SELECT count(*) AS n_rows FROM {src}),
st AS (SELECT column_name, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
              quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS median,
              quantile_cont(value, 0.75) AS q75, quantile_cont(value, 0.9) AS q90, max(value) AS max,
              count(DISTINCT value) AS n_unique, skewness(value) AS skewness, kurtosis(value) AS kurtosis
       FROM lng GROUP BY column_name),
mo AS (SELECT l.column_name, avg(power(l.value - s.mean, 2)) AS m2, avg(power(l.value - s.mean, 3)) AS m3,
              avg(power(l.value - s.mean, 4)) AS m4
       FROM lng l JOIN st s ON l.column_name = s.column_name WHERE l.value IS NOT NULL GROUP BY l.column_name),
oc AS (SELECT l.column_name, count(*) FILTER (WHERE l.value < s.q25 - 1.5 * (s.q75 - s.q25) OR l.value > s.q75 + 1.5 * (s.q75 - s.q25)) AS n_outliers
       FROM lng l JOIN st s ON l.column_name = s.column_name GROUP BY l.column_name),
p0 AS (SELECT s.*, s.q25 - 1.5 * (s.q75 - s.q25) AS lower_bound, s.q75 + 1.5 * (s.q75 - s.q25) AS upper_bound,
              oc.n_outliers, n.n_rows - s.count AS n_missing, n.n_rows,
              s.std / s.mean * 100.0 AS cv, (s.q90 - s.q10) / (s.max - s.min) AS concentration,
              mo.m3 / power(mo.m2, 1.5) AS g1, mo.m4 / (mo.m2 * mo.m2) - 3 AS g2, CAST(s.count AS DOUBLE) AS nd
       FROM st s JOIN oc ON s.column_name = oc.column_name LEFT JOIN mo ON s.column_name = mo.column_name CROSS JOIN nrow n),
p1 AS (SELECT *, nd / 6.0 * (g1 * g1 + g2 * g2 / 4.0) AS jb_stat,
              g1 * sqrt((nd + 1) * (nd + 3) / (6.0 * (nd - 2))) AS y0,
              3.0 * (nd * nd + 27 * nd - 70) * (nd + 1) * (nd + 3) / ((nd - 2.0) * (nd + 5) * (nd + 7) * (nd + 9)) AS beta2,
              (g2 + 3 - 3.0 * (nd - 1) / (nd + 1)) / sqrt(24.0 * nd * (nd - 2) * (nd - 3) / ((nd + 1) * (nd + 1) * (nd + 3) * (nd + 5))) AS xk,
              6.0 * (nd * nd - 5 * nd + 2) / ((nd + 7) * (nd + 9)) * sqrt(6.0 * (nd + 3) * (nd + 5) / (nd * (nd - 2) * (nd - 3))) AS sb1
       FROM p0),
p2 AS (SELECT *, -1 + sqrt(2 * (beta2 - 1)) AS w2, CASE WHEN y0 = 0 THEN 1.0 ELSE y0 END AS y,
              6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS a FROM p1),
p3 AS (SELECT *, 1 / sqrt(0.5 * ln(w2)) AS delta, sqrt(2.0 / (w2 - 1)) AS alpha, 1 + xk * sqrt(2 / (a - 4.0)) AS denom FROM p2),
p4 AS (SELECT *, delta * ln(y / alpha + sqrt((y / alpha) * (y / alpha) + 1)) AS zs,
              ((1 - 2 / (9.0 * a)) - sign(denom) * power((1 - 2.0 / a) / abs(denom), 1 / 3.0)) / sqrt(2 / (9.0 * a)) AS zk FROM p3),
prof AS (SELECT column_name, count, mean, std, min, q10, q25, median, q75, q90, max, n_unique, lower_bound, upper_bound,
                n_outliers, n_missing, skewness, kurtosis, cv, concentration, jb_stat,
                CASE WHEN count >= 8 THEN zs * zs + zk * zk END AS k2_stat,
                exp(-jb_stat / 2.0) AS jb_p, exp(-(CASE WHEN count >= 8 THEN zs * zs + zk * zk END) / 2.0) AS normal_p,
                cv > 50 AS high_variability, abs(skewness) > 1 AS needs_transformation,
                n_outliers > n_rows * 0.05 AS outlier_treatment_needed,
                exp(-(CASE WHEN count >= 8 THEN zs * zs + zk * zk END) / 2.0) >= 0.05 AS is_normal
         FROM p4)"""
    return ctes, "SELECT * FROM prof"


_NP_CTES, _NP_SEL = numeric_profile_sql("bronze", NUM_COLS)


@register("numeric_profile", ("Q5", "Q6", "Q7"), with_ctes(_NP_CTES, _NP_SEL))
def numeric_profile(spark, sf_dir):
    """Q5-Q7: numeric column profile with shape, outliers and normality tests."""
    return P.numeric_profile(_prof(spark, sf_dir), NUM_COLS, mode=M)


def _vc_sql(src: str, cols) -> str:
    long = _union(f"SELECT '{c}' AS column_name, CAST({q(c)} AS VARCHAR) AS value FROM {src}" for c in cols)
    return f"""vc0 AS (SELECT column_name, value, count(*) AS n FROM ({long}) WHERE value IS NOT NULL GROUP BY column_name, value),
vc AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY column_name) AS proportion FROM vc0)"""


@register("categorical_profile", ("Q8",), with_ctes(_vc_sql("bronze", CAT_COLS), """
SELECT column_name, count(*) AS n_unique, sum(n) AS n_non_null, arg_min(value, struct_pack(a := -n, b := value)) AS mode,
       max(proportion) AS top_category_prop, -sum(proportion * ln(proportion)) AS shannon_diversity,
       max(proportion) > 0.5 AS high_concentration, count(*) > 50 AS high_cardinality, count(*) > 20 AS needs_grouping
FROM vc GROUP BY column_name"""))
def categorical_profile(spark, sf_dir):
    """Q8: categorical column profile."""
    return P.categorical_profile(_prof(spark, sf_dir), CAT_COLS)


@register("discrete_value_counts", ("Q9",), with_ctes(_vc_sql("bronze", ("no_rooms",)), "SELECT * FROM vc"))
def discrete_value_counts(spark, sf_dir):
    """Q9: value counts and proportions of a discrete column."""
    return P.value_counts(_prof(spark, sf_dir), ["no_rooms"])


@register("top_zip_with_other", ("K5", "Q10"), with_ctes(
    _vc_sql("bronze", ("zip_code",)) + ",\nr AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS rk, count(*) OVER () AS k FROM vc)",
    "SELECT CASE WHEN k > 10 AND rk >= 10 THEN 'other' ELSE value END AS category, sum(proportion) AS proportion, sum(n) AS n "
    "FROM r GROUP BY 1"))
def top_zip_with_other(spark, sf_dir):
    """K5/Q10: top zip codes plus 'other'."""
    return P.top_n_with_other(_prof(spark, sf_dir), "zip_code", 10)


@register("pareto_house_type", ("K6",), with_ctes(_vc_sql("bronze", ("house_type",)), """
SELECT value, n, proportion, row_number() OVER (ORDER BY n DESC, value) AS rank,
       sum(proportion) OVER (ORDER BY n DESC, value ROWS UNBOUNDED PRECEDING) AS cumulative_proportion FROM vc"""))
def pareto_house_type(spark, sf_dir):
    """K6: Pareto table of house types."""
    return P.pareto(_prof(spark, sf_dir), "house_type").drop("column_name")


@register("word_frequency", ("Q11",), """
SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS word FROM documents)
WHERE length(word) > 0 GROUP BY word ORDER BY n DESC, word LIMIT 100""")
def word_frequency(spark, sf_dir):
    """Q11: most frequent words of the documents (whole texts)."""
    return P.word_frequency(read_table(spark, sf_dir, "documents"), "text", 100)


@register("outlier_extremes", ("K4", "U1"), """
WITH qq AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
o AS (SELECT e.value FROM events e CROSS JOIN qq WHERE e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1))
SELECT * FROM (SELECT 'largest' AS side, value FROM o ORDER BY value DESC LIMIT 3)
UNION ALL SELECT * FROM (SELECT 'smallest' AS side, value FROM o ORDER BY value LIMIT 3)""")
def outlier_extremes(spark, sf_dir):
    """K4: three largest and three smallest IQR outliers of event values."""
    return P.outlier_extremes(read_table(spark, sf_dir, "events"), "value", 3, mode=M)


@register("price_histogram", ("Q17",), with_ctes(
    "mm AS (SELECT min(purchase_price) AS lo, max(purchase_price) AS hi FROM bronze)", """
SELECT bin, lo + bin * (hi - lo) / 50 AS bin_start, lo + (bin + 1) * (hi - lo) / 50 AS bin_end, count(*) AS n FROM (
  SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((purchase_price - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin, lo, hi
  FROM bronze CROSS JOIN mm WHERE purchase_price IS NOT NULL AND NOT isnan(purchase_price)) GROUP BY bin, lo, hi"""))
def price_histogram(spark, sf_dir):
    """Q17: 50-bin histogram of price."""
    return P.histogram(_prof(spark, sf_dir), "purchase_price", 50)


@register("price_percentiles", ("Q17",), with_layers(
    "SELECT " + ", ".join(f"quantile_cont(purchase_price, {p}) AS p{int(round(p * 100))}" for p in P.PERCENTILES) + " FROM bronze"))
def price_percentiles(spark, sf_dir):
    """Q17: percentile vector of price."""
    return P.percentile_vector(_prof(spark, sf_dir), "purchase_price", mode=M)


@register("price_boxplot", ("Q17",), with_ctes("""
bx AS (SELECT house_type, count(purchase_price) AS n, min(purchase_price) AS low, quantile_cont(purchase_price, 0.25) AS q1, quantile_cont(purchase_price, 0.5) AS median,
         quantile_cont(purchase_price, 0.75) AS q3, max(purchase_price) AS high FROM bronze WHERE house_type IS NOT NULL GROUP BY house_type)""", """
SELECT x.*, w.whisker_low, w.whisker_high, w.n_beyond FROM bx x JOIN (
  SELECT b.house_type, min(purchase_price) FILTER (WHERE purchase_price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
         max(purchase_price) FILTER (WHERE purchase_price BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
         count(*) FILTER (WHERE purchase_price NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_beyond
  FROM bronze b JOIN bx USING (house_type) WHERE purchase_price IS NOT NULL GROUP BY b.house_type) w USING (house_type)"""))
def price_boxplot(spark, sf_dir):
    """Q17: five numbers, whiskers and outliers of price by house type."""
    return P.boxplot_table(bronze_table(spark, sf_dir, CFG), "purchase_price", "house_type", M)


_CORR_COLS = ("purchase_price", "sqm", "sqm_price", "no_rooms", "year_build", "dk_ann_infl_rate%", "yield_on_mortgage_credit_bonds%")


@register("correlation_pairs", ("Q16",), with_layers(_union(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE)) AS r, "
    f"abs(corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE))) AS abs_r FROM bronze"
    for i, a in enumerate(_CORR_COLS) for b in _CORR_COLS[i + 1:])))
def correlation_pairs(spark, sf_dir):
    """Q16: pairwise correlations of the numeric columns."""
    return P.correlation_pairs(_prof(spark, sf_dir), _CORR_COLS)


@register("correlation_gate", ("Q20", "P17"), with_layers(
    "SELECT *, coalesce(abs_r > 0.9, false) AS too_correlated FROM (" + _union(
        f"SELECT '{c}' AS feature, corr(CAST({q(c)} AS DOUBLE), purchase_price) AS r, "
        f"abs(corr(CAST({q(c)} AS DOUBLE), purchase_price)) AS abs_r FROM bronze" for c in _CORR_COLS[1:])
    + ")"))
def correlation_gate(spark, sf_dir):
    """Q20: every feature's correlation with the target, and whether it is too high (|r| > 0.9)."""
    return P.correlation_gate(_prof(spark, sf_dir), _CORR_COLS[1:], "purchase_price", 0.90)


@register("events_numeric_profile", ("Q5", "Q6"), "WITH " + ",\n".join(
    [numeric_profile_sql("events", ("value", "user_id"))[0].strip()]) + "\n" + numeric_profile_sql("events", ("value", "user_id"))[1])
def events_numeric_profile(spark, sf_dir):
    """Q5-Q6 on the events table."""
    return P.numeric_profile(read_table(spark, sf_dir, "events"), ["value", "user_id"], mode=M)


@register("layer_assertions", ("Q19",), with_layers(f"""
SELECT bool_and(length(zip_code) = 4) AS zip_len_ok,
       bool_and(regexp_matches(quarter_id, '^\\d{{4}}-Q[1-4]$')) AS quarter_id_ok,
       bool_and(year_sale BETWEEN 1990 AND 2030) AS year_range_ok,
       count(DISTINCT region) AS n_regions, min(year_sale) AS min_year, max(year_sale) AS max_year FROM bronze"""))
def layer_assertions(spark, sf_dir):
    """Q19: Bronze assertion checks (zip length, quarter_id pattern, ranges)."""
    b = _prof(spark, sf_dir)
    return b.agg(
        F.bool_and(F.length("zip_code") == 4).alias("zip_len_ok"),
        F.bool_and(F.col("quarter_id").rlike(r"^\d{4}-Q[1-4]$")).alias("quarter_id_ok"),
        F.bool_and(F.col("year_sale").between(1990, 2030)).alias("year_range_ok"),
        F.count_distinct("region").alias("n_regions"), F.min("year_sale").alias("min_year"),
        F.max("year_sale").alias("max_year"))


_SW_COLS = ("purchase_price", "sqm", "sqm_price", "year_build", "%_change_between_offer_and_purchase")


@register("shapiro_wilk", ("Q7",), with_ctes(N.shapiro_wilk_sql("bronze", _SW_COLS), "SELECT * FROM sw"), digits=8)
def shapiro_wilk(spark, sf_dir):
    """Q7: Shapiro-Wilk statistic of the numeric columns over all rows."""
    return N.shapiro_wilk(bronze_table(spark, sf_dir, CFG), _SW_COLS)


@register("shapiro_wilk_pvalue", ("Q7",))
def shapiro_wilk_pvalue(spark, sf_dir):
    """Q7: the statistic's p-value and verdict."""
    return N.shapiro_wilk_p(N.shapiro_wilk(bronze_table(spark, sf_dir, CFG), _SW_COLS))


_T7_COLS = ("purchase_price", "sqm", "sqm_price", "no_rooms", "year_build", "year_sale", "age_at_sale", "property_age")
_T7_SQL = "x AS (SELECT *, year_sale - year_build AS age_at_sale, 2024 - year_build AS property_age FROM bronze)"


@register("high_correlation_pairs", ("T7",), with_ctes(_T7_SQL, "SELECT * FROM (" + _union(
    f"SELECT '{a}' AS var1, '{b}' AS var2, abs(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))) AS correlation FROM x"
    for i, a in enumerate(_T7_COLS) for b in _T7_COLS[i + 1:]) + ") WHERE correlation > 0.95"))
def high_correlation_pairs(spark, sf_dir):
    """Pairs of numeric columns with an absolute correlation above 0.95."""
    b = bronze_table(spark, sf_dir, CFG).withColumns({"age_at_sale": F.col("year_sale") - F.col("year_build"), "property_age": 2024 - F.col("year_build")})
    return P.high_correlation_pairs(b, _T7_COLS)
