"""Data-quality and univariate profiling.

Columns are profiled together: the table is unpivoted to a narrow
(column, value) form with one ``explode`` and every statistic is one grouped
aggregation keyed by the column name, so a profile of p columns is one pass
plus one quantile pass, not p passes. Skewness and kurtosis are the
bias-adjusted G1 / G2 of pandas, derived from Spark's population moments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.functions.quantile import group_quantiles, rank_within_groups, running_sum
from hearth.functions.stats import grouped_stats, safe_corr
from hearth.sources.scratch import attach, stored

# --- fixed values (reference thresholds) ------------------------------------
HIGH_VARIABILITY_CV = 50
SKEW_TRANSFORM = 1
OUTLIER_SHARE = 0.05
IQR_FACTOR = 1.5
HIGH_CONCENTRATION = 0.5
HIGH_CARDINALITY = 50
NEEDS_GROUPING = 20
NORMAL_ALPHA = 0.05
PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
HIST_BINS = 50
# -----------------------------------------------------------------------------

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value double) rows; NaN is treated as missing."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), _c(c).cast("double").alias("value")) for c in cols])
    out = df.select(F.explode(arr).alias("_kv")).select("_kv.column_name", "_kv.value")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def long_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), _c(c).cast("string").alias("value")) for c in cols])
    return df.select(F.explode(arr).alias("_kv")).select("_kv.column_name", "_kv.value")


def null_summary(df: DataFrame) -> DataFrame:
    """Q1: null share (%) per column, only columns with nulls, sorted desc, with the formatted text."""
    n = F.count(F.lit(1))
    row = df.agg(n.alias("_n"), *[F.sum(_c(c).isNull().cast("long")).alias(c) for c in df.columns])
    stack = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("n_null")) for c in df.columns])
    long = row.select("_n", F.explode(stack).alias("_s")).select("_s.column_name", "_s.n_null", "_n")
    long = long.withColumn("null_percentage", F.col("n_null") / F.col("_n") * 100.0).where(F.col("n_null") > 0)
    return long.select("column_name", "n_null", "null_percentage",
                       F.format_string("%.2f %%", F.col("null_percentage")).alias("null_percentage_text")).orderBy(
        F.desc("null_percentage"), "column_name")


def rows_with_nulls(df: DataFrame) -> DataFrame:
    """The rows having at least one null."""
    cond = F.lit(False)
    for c in df.columns:
        cond = cond | _c(c).isNull()
    return df.where(cond)


def column_profile(df: DataFrame) -> DataFrame:
    """Q2: dtype, distinct non-null values and missing count per column."""
    aggs = []
    for c in df.columns:
        aggs += [F.count_distinct(_c(c)).alias(f"u::{c}"), F.sum(_c(c).isNull().cast("long")).alias(f"m::{c}")]
    row = df.agg(*aggs)
    types = dict(df.dtypes)
    stack = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("dtype"),
                               F.col(f"`u::{c}`").alias("n_unique"), F.col(f"`m::{c}`").alias("n_missing"))
                      for c in df.columns])
    return row.select(F.explode(stack).alias("_s")).select("_s.*")


def duplicate_stats(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A30 / A31 (one row): rows, distinct rows (or distinct keys), rows that
    repeat an earlier one (``duplicated()``), all members of duplicated
    groups (``keep=False``) and the duplicate percentage (round 2).

    Only hashes of the rows are shuffled. A hash that comes once is a row of its own; the rows of the others are compared
    by their values."""
    cols = list(keys) if keys else df.columns
    plain = {n for n, t in df.dtypes if t in ("double", "float")}
    d = df.select(*[_c(c) for c in cols]).withColumn("_row_hash", F.xxhash64(*[_c(c) + F.lit(0.0) if c in plain else _c(c) for c in cols]))
    seen = stored(d.groupBy("_row_hash").agg(F.count(F.lit(1)).alias("_k")))
    single = seen.where("_k = 1").agg(F.count(F.lit(1)).alias("_k")).select(F.col("_k"), F.col("_k").alias("_g"))
    again = attach(d, seen.where("_k > 1").select("_row_hash"), "_row_hash", "left_semi").groupBy(*[_c(c) for c in cols]).agg(F.count(F.lit(1)).alias("_k"))
    g = single.where("_k > 0").unionByName(again.select("_k", F.lit(1).cast("long").alias("_g")))
    s = g.agg(F.sum("_k").alias("n_rows"), F.coalesce(F.sum("_g"), F.lit(0).cast("long")).alias("n_distinct"),
              F.sum(F.when((F.col("_k") > 1) & (F.col("_g") == 1), F.col("_k")).otherwise(0)).alias("n_in_duplicate_groups"))
    s = s.withColumn("n_duplicated", F.col("n_rows") - F.col("n_distinct"))
    return s.withColumn("duplicate_pct", F.bround(F.col("n_duplicated") / F.col("n_rows") * 100.0, 2))


def quality_report(df: DataFrame) -> DataFrame:
    """Q3 / Q4 (one row): cells, missing cells and %, columns with missing,
    duplicate rows and %, numeric / string / other column counts."""
    nulls = [F.sum(_c(c).isNull().cast("long")) for c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*nulls).alias("_nulls"))
    dup = duplicate_stats(df).select("n_duplicated")
    n_num = len(numeric_columns(df))
    n_str = len(categorical_columns(df))
    out = row.crossJoin(dup).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        (F.col("n_rows") * len(df.columns)).alias("total_cells"),
        F.aggregate("_nulls", F.lit(0).cast("long"), lambda a, x: a + x).alias("missing_cells"),
        F.size(F.filter("_nulls", lambda x: x > 0)).alias("columns_with_missing"),
        F.col("n_duplicated").alias("duplicate_rows"),
    )
    return out.withColumns({
        "missing_percentage": F.col("missing_cells") / F.col("total_cells") * 100.0,
        "duplicate_percentage": F.col("duplicate_rows") / F.col("n_rows") * 100.0,
        "n_numeric_columns": F.lit(n_num), "n_string_columns": F.lit(n_str),
        "n_other_columns": F.lit(len(df.columns) - n_num - n_str),
    })


def _adj_skew(g1: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def _adj_kurt(g2: Column, n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def dagostino_k2(g1: Column, g2: Column, n: Column) -> Column:
    """D'Agostino-Pearson K^2 from population skewness g1, excess kurtosis g2 and n."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    zs = delta * F.log(y / alpha + F.sqrt((y / alpha) ** 2 + 1))
    b2 = g2 + 3
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + x * F.sqrt(2 / (a - 4.0))
    term2 = F.signum(denom) * F.pow((1 - 2.0 / a) / F.abs(denom), 1 / 3.0)
    zk = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    return zs * zs + zk * zk


def numeric_profile(df: DataFrame, cols: Sequence[str] | None = None, mode: str = "exact") -> DataFrame:
    """Q5 + Q6 + Q7: per numeric column: describe() figures, adjusted skewness
    and kurtosis, CV %, IQR outliers, concentration (p90 - p10) / range,
    D'Agostino K^2 and Jarque-Bera with chi^2(2) p-values, and the flags."""
    cols = list(cols or numeric_columns(df))
    long = long_numeric(df, cols)
    specs = [("count", "count", "value"), ("mean", "mean", "value"), ("std", "std", "value"), ("min", "min", "value"),
             ("q10", "q10", "value"), ("q25", "q25", "value"), ("median", "median", "value"), ("q75", "q75", "value"),
             ("q90", "q90", "value"), ("max", "max", "value")]
    st = grouped_stats(long, ["column_name"], specs, mode)
    mom = long.where(F.col("value").isNotNull()).groupBy("column_name").agg(
        F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2"),
        F.count_distinct("value").alias("n_unique"))
    n_rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    st = st.join(mom, "column_name", "left").crossJoin(F.broadcast(n_rows))
    iqr = F.col("q75") - F.col("q25")
    st = st.withColumns({"lower_bound": F.col("q25") - IQR_FACTOR * iqr, "upper_bound": F.col("q75") + IQR_FACTOR * iqr})
    bounds = st.select("column_name", "lower_bound", "upper_bound")
    out_cnt = (long.join(F.broadcast(bounds), "column_name")
               .groupBy("column_name").agg(F.count_if((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))).alias("n_outliers")))
    st = st.join(out_cnt, "column_name", "left")
    n = F.col("count")
    st = st.withColumns({
        "n_missing": F.col("n_rows") - F.col("count"),
        "skewness": _adj_skew(F.col("_g1"), n),
        "kurtosis": _adj_kurt(F.col("_g2"), n),
        "cv": F.try_divide(F.col("std"), F.col("mean")) * 100.0,
        "concentration": F.try_divide(F.col("q90") - F.col("q10"), F.col("max") - F.col("min")),
        "jb_stat": n.cast("double") / 6.0 * (F.col("_g1") ** 2 + F.col("_g2") ** 2 / 4.0),
        "k2_stat": F.when(n >= 8, dagostino_k2(F.col("_g1"), F.col("_g2"), n)),
    })
    st = st.withColumns({
        "jb_p": F.exp(-F.col("jb_stat") / 2.0), "normal_p": F.exp(-F.col("k2_stat") / 2.0),
        "high_variability": F.col("cv") > HIGH_VARIABILITY_CV,
        "needs_transformation": F.abs(F.col("skewness")) > SKEW_TRANSFORM,
        "outlier_treatment_needed": F.col("n_outliers") > F.col("n_rows") * OUTLIER_SHARE,
    })
    st = st.withColumn("is_normal", F.col("normal_p") >= NORMAL_ALPHA)
    return st.drop("_g1", "_g2", "n_rows")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, n, proportion) with proportions over non-null values (Q9)."""
    long = long_strings(df, cols).where(F.col("value").isNotNull())
    c = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    total = F.broadcast(c.groupBy("column_name").agg(F.sum("n").alias("_all")))  # one row per name in cols
    return c.join(total, "column_name").select("column_name", "value", "n", (F.col("n") / F.col("_all")).alias("proportion"))


def categorical_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Q8: per string column: distinct values, mode and its share, Shannon
    diversity, and the concentration / cardinality flags."""
    cols = list(cols or categorical_columns(df))
    vc = value_counts(df, cols)
    agg = vc.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("n_non_null"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
        F.max("proportion").alias("top_category_prop"),
        (-F.sum(F.col("proportion") * F.log(F.col("proportion")))).alias("shannon_diversity"),
    )
    return agg.withColumns({
        "high_concentration": F.col("top_category_prop") > HIGH_CONCENTRATION,
        "high_cardinality": F.col("n_unique") > HIGH_CARDINALITY,
        "needs_grouping": F.col("n_unique") > NEEDS_GROUPING,
    })


def top_n_with_other(df: DataFrame, col: str, top_n: int = 10) -> DataFrame:
    """K5 / Q10: proportions of the top_n - 1 values plus 'other' when there
    are more than top_n values (ties broken by value); else all values. Only
    the top_n rows are ever ordered (TakeOrderedAndProject); the rest is summed."""
    vc = value_counts(df, [col]).drop("column_name")
    tot = vc.agg(F.count(F.lit(1)).alias("_k"), F.sum("n").alias("_n"), F.sum("proportion").alias("_p"))
    top = vc.orderBy(F.desc("n"), "value").limit(top_n)
    top = top.withColumn("_rk", F.row_number().over(Window.orderBy(F.desc("n"), "value"))).crossJoin(F.broadcast(tot))
    kept = top.where((F.col("_k") <= top_n) | (F.col("_rk") < top_n)).select(F.col("value").alias("category"), "proportion", "n")
    head = top.where(F.col("_rk") < top_n).agg(F.sum("n").alias("_hn"), F.sum("proportion").alias("_hp"))
    other = tot.where(F.col("_k") > top_n).crossJoin(head).select(
        F.lit("other").alias("category"), (F.col("_p") - F.coalesce(F.col("_hp"), F.lit(0.0))).alias("proportion"),
        (F.col("_n") - F.coalesce(F.col("_hn"), F.lit(0))).alias("n"))
    return kept.unionByName(other)


def pareto(df: DataFrame, col: str) -> DataFrame:
    """K6 + W7: categories by count desc with their rank and cumulative
    proportion (distributed prefix sum over the global order, no single-partition window)."""
    vc = value_counts(df, [col]).drop("column_name")
    r = rank_within_groups(vc, [], [F.desc("n"), F.col("value")]).withColumn("rank", F.col("_rank") + 1).drop("_rank", "_n")
    return running_sum(r, [], [F.col("rank")], "proportion", "cumulative_proportion")


def word_frequency(df: DataFrame, col: str, top: int = 100) -> DataFrame:
    """Q11: lower-cased whitespace tokens of a text column, most frequent first."""
    words = df.select(F.explode(F.split(F.lower(_c(col)), r"\s+")).alias("word")).where(F.length("word") > 0)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(top)


def outlier_extremes(df: DataFrame, col: str, k: int = 3, mode: str = "exact") -> DataFrame:
    """K4: the k largest and k smallest IQR outliers of a column."""
    q = group_quantiles(df, [], col, [0.25, 0.75], ["_q1", "_q3"], mode)
    d = df.select(_c(col).cast("double").alias("value")).crossJoin(F.broadcast(q))
    iqr = F.col("_q3") - F.col("_q1")
    o = d.where((F.col("value") < F.col("_q1") - IQR_FACTOR * iqr) | (F.col("value") > F.col("_q3") + IQR_FACTOR * iqr))
    hi = o.orderBy(F.desc("value")).limit(k).select(F.lit("largest").alias("side"), "value")
    lo = o.orderBy("value").limit(k).select(F.lit("smallest").alias("side"), "value")
    return hi.unionByName(lo)


def histogram(df: DataFrame, col: str, bins: int = HIST_BINS) -> DataFrame:
    """Q17: equal-width histogram between min and max (last bin closed), like numpy."""
    x = _c(col).cast("double")
    mm = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    d = df.select(x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")).crossJoin(F.broadcast(mm))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(
        F.least(F.floor((F.col("v") - F.col("_lo")) / width), F.lit(bins - 1))).cast("int")
    h = d.groupBy(b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return h.select("bin", (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
                    (F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_end"), "n")


def percentile_vector(df: DataFrame, col: str, probs: Sequence[float] = PERCENTILES, mode: str = "exact") -> DataFrame:
    """Q17: percentile vector (one row, columns p1 ... p99) and boxplot numbers."""
    names = [f"p{int(round(p * 100))}" for p in probs]
    return group_quantiles(df, [], col, probs, names, mode)


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Q16: Pearson r of every column pair in one aggregation, long form (a < b)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[safe_corr(_c(a), _c(b)).alias(f"{a}||{b}") for a, b in pairs])
    stack = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"`{a}||{b}`").alias("r"))
                      for a, b in pairs])
    return row.select(F.explode(stack).alias("_s")).select("_s.*").withColumn("abs_r", F.abs("r"))


def boxplot_table(df: DataFrame, value: str, by: str, mode: str = "exact") -> DataFrame:
    """Q17: what a box plot shows of each group: quartiles, the values furthest out within 1.5 quartile ranges, and the rows beyond."""
    d = df.select(F.col(by).alias(by), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    st = grouped_stats(d, [by], [("n", "count", "v"), ("low", "min", "v"), ("q1", "q25", "v"), ("median", "median", "v"), ("q3", "q75", "v"), ("high", "max", "v")], mode)
    reach = IQR_FACTOR * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    out = attach(d, st.select(by, "q1", "q3"), by, "inner").groupBy(by).agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("n_beyond"))
    return st.join(out, by)


def high_correlation_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """The column pairs whose absolute correlation is above ``threshold``."""
    return correlation_pairs(df, cols).where(F.col("abs_r") > threshold).select(F.col("col_a").alias("var1"), F.col("col_b").alias("var2"), F.col("abs_r").alias("correlation"))


class GateError(ValueError):
    """A feature set that must not reach a model."""


def check_features(df: DataFrame, features: Sequence[str], target: str, limit: float, required: Sequence[str] = (), forbidden: Sequence[str] = ()) -> None:
    """Q20: raise unless every required column is there, no forbidden one is, and no feature's |r| with the target is above ``limit``."""
    missing, bad = sorted(set(required) - set(features)), sorted(set(forbidden) & set(features))
    if missing or bad:
        raise GateError(f"missing: {missing}; forbidden: {bad}")
    close = correlation_gate(df, features, target, limit).where("too_correlated").select("feature", "r").collect()  # one row a feature at most
    if close:
        raise GateError("too close to the target: " + ", ".join(f"{r['feature']} ({r['r']:.4f})" for r in close))


def correlation_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Q16 / Q20: r of each column with the target."""
    row = df.agg(*[safe_corr(_c(c), _c(target)).alias(c) for c in cols])
    stack = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("r")) for c in cols])
    return row.select(F.explode(stack).alias("_s")).select("_s.*").withColumn("abs_r", F.abs("r"))


def correlation_gate(df: DataFrame, cols: Sequence[str], target: str, limit: float = 0.90) -> DataFrame:
    """Q20: every feature's |r| with the target and whether it exceeds ``limit``."""
    return correlation_with_target(df, cols, target).withColumn("too_correlated", F.coalesce(F.col("abs_r") > limit, F.lit(False)))
