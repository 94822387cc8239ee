"""Leak-guarded feature engineering.

Every transform is a column expression over the fact table. Whole-table
statistics (quantile thresholds, min/max, global means, per-category
encodings) are computed once as small DataFrames and joined back: scalars by a
broadcast cross join of one row, per-category tables by an equi-join whose
broadcast is decided by AQE on the measured size. Fitted statistics are
returned as tables so they can be stored and re-applied (fit / transform).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.config import (
    CRISIS_YEARS,
    FORBIDDEN_FEATURES,
    MARKET_PHASES,
    MAX_CATEGORIES_ONEHOT,
    RARE_CATEGORY_THRESHOLD,
    TARGET_ENCODING_MIN_SAMPLES,
)
from hearth.functions.quantile import rank_within_groups, scalar_quantiles, sorted_blocks
from hearth.functions.stats import grouped_stats
from hearth.sources.scratch import attach

# --- fixed values (reference labels) ----------------------------------------
SEASONS = {12: "Winter", 1: "Winter", 2: "Winter", 3: "Spring", 4: "Spring", 5: "Spring",
           6: "Summer", 7: "Summer", 8: "Summer", 9: "Autumn", 10: "Autumn", 11: "Autumn"}
DAY_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
AGE_CATEGORIES = ((0, "Future/Error"), (5, "New (0-5 years)"), (15, "Modern (6-15 years)"),
                  (30, "Established (16-30 years)"), (50, "Mature (31-50 years)"))
AGE_OTHER = "Historic (50+ years)"
VINTAGES = ((1900, "Historic"), (1950, "Pre-War"), (1980, "Post-War"), (2000, "Late Century"))
VINTAGE_OTHER = "Modern"
ROOM_CATEGORIES = ((2, "1-2 rooms"), (4, "3-4 rooms"))
ROOM_OTHER = "5+ rooms"
SIZE_LABELS = ("Small", "Medium", "Large")
SQM_PRICE_LABELS = ("Very Efficient", "Efficient", "Average", "Premium")
# -----------------------------------------------------------------------------

ROLLING_COLUMNS = ("rolling_regional_mean", "rolling_regional_median", "rolling_regional_std",
                   "rolling_regional_cv", "rolling_regional_count", "rolling_regional_p90")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# F1 / F2 / F3 -----------------------------------------------------------------
def date_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = _c(date_col)
    season = F.element_at(F.array(*[F.lit(SEASONS[m]) for m in range(1, 13)]), F.month(d))
    return df.withColumns({
        "year_sale": F.year(d), "month_sale": F.month(d), "day_sale": F.dayofmonth(d),
        "dayofweek_sale": F.weekday(d), "quarter_sale": F.quarter(d), "season_sale": season,
        "dayname_sale": F.element_at(F.array(*[F.lit(x) for x in DAY_NAMES]), F.weekday(d) + 1),
    })


def cyclic_features(df: DataFrame, date_col: str = "date") -> DataFrame:
    d = _c(date_col)
    two_pi = 2 * 3.141592653589793
    start = df.agg(F.min(F.year(d)).alias("_y0"))
    out = df.crossJoin(F.broadcast(start)).withColumns({
        "month_sin": F.sin(two_pi * F.month(d) / 12), "month_cos": F.cos(two_pi * F.month(d) / 12),
        "dayofweek_sin": F.sin(two_pi * F.weekday(d) / 7), "dayofweek_cos": F.cos(two_pi * F.weekday(d) / 7),
        "quarter_sin": F.sin(two_pi * F.quarter(d) / 4), "quarter_cos": F.cos(two_pi * F.quarter(d) / 4),
        "years_since_start": F.year(d) - F.col("_y0"),
    })
    return out.drop("_y0")


# F4 --------------------------------------------------------------------------
def _ladder(x: Column, steps, other: str, op: str = "<=") -> Column:
    e = None
    for bound, label in steps:
        cond = (x < bound) if op == "<" else (x <= bound)
        e = F.when(cond, label) if e is None else e.when(cond, label)
    return e.otherwise(other)  # NULL compares false and lands here, as NaN does in pandas


def property_age_features(df: DataFrame, year_built_col: str = "year_build", reference_year: int = 2024) -> DataFrame:
    yb = _c(year_built_col)
    age = F.lit(reference_year) - yb
    first, *rest = AGE_CATEGORIES
    age_cat = F.when(age < first[0], first[1])
    for bound, label in rest:
        age_cat = age_cat.when(age <= bound, label)
    return df.withColumns({
        "property_age": age,
        "decade_built": F.floor(yb / 10) * 10,
        "decade_built_label": F.concat((F.floor(yb / 10) * 10).cast("string"), F.lit("s")),
        "age_category": age_cat.otherwise(AGE_OTHER),
        "vintage_category": _ladder(yb, VINTAGES, VINTAGE_OTHER, "<"),
    })


# F5 / F7 / W23 ---------------------------------------------------------------
def average_rank_pct(df: DataFrame, col: str, out: str) -> DataFrame:
    """Pandas ``rank(pct=True)`` (average rank of ties / non-null count),
    through the skew-proof global rank; NULL stays NULL."""
    v = df.select(_c(col).alias("_v")).where(F.col("_v").isNotNull())
    r = rank_within_groups(v, [], ["_v"])
    ties = r.groupBy("_v").agg(F.min("_rank").alias("_lo"), F.max("_rank").alias("_hi"), F.first("_n").alias("_n"))
    ties = ties.select(F.col("_v").alias("_tv"), ((F.col("_lo") + F.col("_hi")) / 2.0 + 1) / F.col("_n")).toDF("_tv", out)
    return df.join(ties, _c(col) == F.col("_tv"), "left").drop("_tv")


def size_features(df: DataFrame, sqm_col: str = "sqm", rooms_col: str = "no_rooms", mode: str = "exact",
                  with_percentile: bool = True) -> DataFrame:
    s, r = _c(sqm_col), _c(rooms_col)
    thr = scalar_quantiles(df, sqm_col, [0.33, 0.67], ["_s33", "_s67"], mode)
    out = df.crossJoin(F.broadcast(thr))
    cols = {
        "rooms_category": _ladder(r, ROOM_CATEGORIES, ROOM_OTHER),
        "size_category": F.when(s <= F.col("_s33"), SIZE_LABELS[0]).when(s <= F.col("_s67"), SIZE_LABELS[1]).otherwise(SIZE_LABELS[2]),
        "sqm_per_room": F.try_divide(s, r.cast("double")),
    }
    if "sqm_price" in df.columns:
        pq = scalar_quantiles(df, "sqm_price", [0.25, 0.5, 0.75], ["_p25", "_p50", "_p75"], mode)
        out = out.crossJoin(F.broadcast(pq))
        p = F.col("sqm_price")
        cols["sqm_price_category"] = (F.when(p <= F.col("_p25"), SQM_PRICE_LABELS[0]).when(p <= F.col("_p50"), SQM_PRICE_LABELS[1])
                                      .when(p <= F.col("_p75"), SQM_PRICE_LABELS[2]).otherwise(SQM_PRICE_LABELS[3]))
    out = out.withColumns(cols).drop("_s33", "_s67", "_p25", "_p50", "_p75")
    if with_percentile and "sqm_price" in df.columns:
        out = average_rank_pct(out, "sqm_price", "sqm_price_percentile")
    return out


def sqm_per_room_safe(df: DataFrame, sqm_col: str = "sqm", rooms_col: str = "no_rooms") -> DataFrame:
    """rooms equal to 0 count as 1."""
    r = _c(rooms_col)
    return df.withColumn("sqm_per_room", _c(sqm_col) / F.when(r == 0, 1).otherwise(r))


# F8 / F10 / F11 / F12 / F13 --------------------------------------------------
def log_target(df: DataFrame, price_col: str = "purchase_price", out: str = "log_price") -> DataFrame:
    return df.withColumn(out, F.log1p(_c(price_col)))


def log_transform(df: DataFrame, cols: Sequence[str], add_constant: float = 1.0) -> DataFrame:
    """log1p when the column's minimum is <= 0, else log(x + c); the
    minimum is a one-row aggregate cross-joined, so no driver round trip."""
    mins = df.agg(*[F.min(_c(c)).alias(f"_min_{i}") for i, c in enumerate(cols)])
    out = df.crossJoin(F.broadcast(mins))
    out = out.withColumns({f"{c}_log": F.when(F.col(f"_min_{i}") <= 0, F.log1p(_c(c))).otherwise(F.log(_c(c) + add_constant))
                           for i, c in enumerate(cols)})
    return out.drop(*[f"_min_{i}" for i in range(len(cols))])


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]], operation: str = "multiply", sep: str = "_x_") -> DataFrame:
    """``<a><sep><b>`` of every pair whose columns are there; dividing adds 1e-8 to the divisor."""
    ops = {"multiply": lambda a, b: a * b, "add": lambda a, b: a + b,
           "divide": lambda a, b: a / (b + 1e-8), "subtract": lambda a, b: a - b}
    f = ops[operation]
    return df.withColumns({f"{a}{sep}{b}": f(_c(a), _c(b)) for a, b in pairs if a in df.columns and b in df.columns})


def safe_interactions(df: DataFrame, house_types: Sequence[str] = ("Villa", "Apartment")) -> DataFrame:
    """age x dummies of the given house types, sqm_per_room squared, rooms x sqm."""
    cols = {}
    if "property_age" in df.columns and "house_type" in df.columns:
        for h in house_types:
            cols[f"age_x_{h.lower()}"] = F.col("property_age") * (F.col("house_type") == h).cast("int")
    if "sqm_per_room" in df.columns:
        cols["sqm_per_room_sq"] = F.col("sqm_per_room") ** 2
    if "no_rooms" in df.columns and "sqm" in df.columns:
        cols["rooms_x_sqm"] = F.col("no_rooms") * F.col("sqm")
    return df.withColumns(cols)


def market_phase_features(df: DataFrame, year_col: str = "year") -> DataFrame:
    """time trend (min-max of year), crisis flag, market phase (first
    matching range) and one dummy per phase present."""
    y = _c(year_col)
    mm = df.agg(F.min(y).alias("_ymin"), F.max(y).alias("_ymax"))
    out = df.crossJoin(F.broadcast(mm))
    phase = None
    for name, lo, hi in MARKET_PHASES:
        phase = F.when((y >= lo) & (y <= hi), name) if phase is None else phase.when((y >= lo) & (y <= hi), name)
    out = out.withColumns({
        "time_trend": (y - F.col("_ymin")) / F.greatest(F.col("_ymax") - F.col("_ymin"), F.lit(1)),
        "crisis_period": y.isin(list(CRISIS_YEARS)).cast("int"),
        "market_phase": phase.otherwise("other"),
    }).drop("_ymin", "_ymax")
    return out.withColumns({f"phase_{name}": (F.col("market_phase") == name) for name, _, _ in MARKET_PHASES}
                           | {"phase_other": F.col("market_phase") == "other"})


# W12 -------------------------------------------------------------------------
def rate_features(df: DataFrame, rate_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Ratios and spreads of each pair of rates, and lag 1 / 2 of each
    rate in an explicit (date, key) order (the reference relies on row order)."""
    cols = {}
    for i, a in enumerate(rate_cols):
        for b in rate_cols[i + 1:]:
            cols[f"{a}_{b}_ratio"] = F.try_divide(_c(a), _c(b))
            cols[f"{a}_{b}_spread"] = _c(a) - _c(b)
    out = df.withColumns(cols)
    return global_lags(out, rate_cols, order_cols, (1, 2))


def global_lags(df: DataFrame, cols: Sequence[str], order_cols: Sequence[str], lags=(1, 2)) -> DataFrame:
    """``lag(c, k)`` over one global order without a single-partition window:
    the rows are range-sorted once, each sorted part is lagged on its own, and
    the first rows of a part get theirs from the last rows of the parts before
    it (a few rows a part, broadcast)."""
    most = max(lags)
    s, _ = sorted_blocks(df, [], [_c(c) for c in order_cols])
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    part = Window.partitionBy("_pid").orderBy("_mid")
    at = {k: F.lag(F.struct(*[_c(c) for c in cols]), k).over(part) for k in lags}
    out = s.withColumns({f"_lag{k}": x for k, x in at.items()} | {"_pos": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})
    # the parts' last rows, each with its number of rows from the end of its part
    sizes = s.groupBy("_pid").agg(F.max("_mid").alias("_last"), F.count(F.lit(1)).alias("_size"))
    ends = s.join(F.broadcast(sizes), "_pid").where(F.col("_mid") > F.col("_last") - most).select("_pid", "_mid", F.struct(*[_c(c) for c in cols]).alias("_v"))
    tails = ends.groupBy("_pid").agg(F.array_sort(F.collect_list(F.struct((-F.col("_mid")).alias("m"), F.col("_v").alias("v")))).alias("_t"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    tails = tails.withColumn("_before", F.slice(F.reverse(F.array_sort(F.transform(F.flatten(F.collect_list("_t").over(before)), lambda x: F.struct((-x["m"]).alias("m"), x["v"].alias("v"))))), 1, most))
    out = out.join(F.broadcast(tails.select("_pid", "_before")), "_pid", "left")
    value = {k: F.when(F.col("_pos") >= k, F.col(f"_lag{k}")).otherwise(F.try_element_at("_before", (F.lit(k) - F.col("_pos")).cast("int"))["v"]) for k in lags}
    return out.select(*df.columns, *[value[k][c].alias(f"{c}_lag{k}") for k in lags for c in cols])


# W13 / W14 / W15 -------------------------------------------------------------
def rolling_regional_stats(df: DataFrame, region_col: str = "region", price_col: str = "purchase_price",
                           year_col: str = "year", window_years: int = 3, min_obs: int = 20,
                           mode: str = "exact") -> DataFrame:
    """For every (region, year) present, stats of the prices of years
    [year - k, year - 1]: each sale is sent to the k later reference years
    (``explode(sequence)``, k is a parameter, not data-driven), kept only where
    that (region, reference year) exists, then grouped. No range join.
    Below ``min_obs`` observations everything but the count is NULL."""
    keys = df.select(_c(region_col).alias("_r"), _c(year_col).cast("int").alias("_y")).dropna().distinct()
    src = df.select(_c(region_col).alias("_r"), _c(year_col).cast("int").alias("_sy"), _c(price_col).cast("double").alias("_p"))
    src = src.where(F.col("_r").isNotNull() & F.col("_sy").isNotNull() & F.col("_p").isNotNull() & ~F.isnan("_p"))
    ex = src.withColumn("_y", F.explode(F.sequence(F.col("_sy") + 1, F.col("_sy") + window_years))).drop("_sy")
    ex = ex.join(keys, ["_r", "_y"])
    st = grouped_stats(ex, ["_r", "_y"], [("n", "size", "_p"), ("mean", "mean", "_p"), ("median", "median", "_p"),
                                           ("std", "std", "_p"), ("p90", "q0.9", "_p")], mode)
    j = keys.join(st, ["_r", "_y"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    ok = n >= min_obs
    std = F.when(n == 1, F.lit(0.0)).otherwise(F.col("std"))
    return j.select(
        F.col("_r").alias(region_col), F.col("_y").alias(year_col),
        F.when(ok, F.col("mean")).alias("rolling_regional_mean"),
        F.when(ok, F.col("median")).alias("rolling_regional_median"),
        F.when(ok, std).alias("rolling_regional_std"),
        F.when(ok, F.when(F.col("mean") != 0, std / F.col("mean"))).alias("rolling_regional_cv"),
        n.alias("rolling_regional_count"),
        F.when(ok, F.col("p90")).alias("rolling_regional_p90"),
    )


def add_rolling_features(df: DataFrame, region_col: str = "region", price_col: str = "purchase_price",
                         year_col: str = "year", window_years: int = 3, min_obs: int = 20, mode: str = "exact") -> DataFrame:
    """W13 + J7 + W15: rolling stats joined on (region, year), the causal
    premium flag and the deviation from the rolling median."""
    base = df.drop(*[c for c in ROLLING_COLUMNS if c in df.columns])
    roll = rolling_regional_stats(base, region_col, price_col, year_col, window_years, min_obs, mode)
    out = attach(base, roll, [region_col, year_col])
    p90, med = F.col("rolling_regional_p90"), F.col("rolling_regional_median")
    return out.withColumns({
        "rolling_regional_median_v2": med,
        "is_premium_causal": F.when(p90.isNotNull(), (_c(price_col) > p90).cast("double")),
        "price_deviation_from_rolling_median": _c(price_col) - med,
    })


# E1-E5 -----------------------------------------------------------------------
def one_hot(df: DataFrame, col: str, drop_first: bool = True, prefix: str | None = None,
            max_categories: int = 1000) -> DataFrame:
    """One 0/1 column per category (sorted), first dropped. The category
    list is read once and must stay below ``max_categories``."""
    vals = [r[0] for r in df.select(_c(col)).where(_c(col).isNotNull()).distinct().orderBy(col).limit(max_categories + 1).collect()]
    if len(vals) > max_categories:
        raise ValueError(f"{col} has more than {max_categories} categories; use target or frequency encoding")
    if drop_first:
        vals = vals[1:]
    p = prefix or col
    return df.withColumns({f"{p}_{v}": (_c(col) == F.lit(v)).cast("int") for v in vals})


def target_encoding_table(df: DataFrame, col: str, target: str, smoothing: float = 10.0) -> DataFrame:
    """E2 fit: (category, smoothed mean) with (n*mean + s*global)/(n + s), plus the global mean."""
    g = df.where(_c(col).isNotNull()).groupBy(_c(col).alias(col)).agg(F.avg(target).alias("_m"), F.count(_c(target)).alias("_n"))
    gm = df.agg(F.avg(target).alias("_global"))
    g = g.crossJoin(F.broadcast(gm))
    return g.select(col, ((F.col("_n") * F.col("_m") + smoothing * F.col("_global")) / (F.col("_n") + smoothing)).alias("_enc"), "_global")


def apply_target_encoding(df: DataFrame, col: str, table: DataFrame, out: str | None = None) -> DataFrame:
    """E2 transform: unseen or NULL categories get the global mean."""
    out = out or f"{col}_target_encoded"
    gm = table.agg(F.first("_global").alias("_g"))
    j = attach(df, table.drop("_global"), col).crossJoin(F.broadcast(gm))
    return j.withColumn(out, F.coalesce(F.col("_enc"), F.col("_g"))).drop("_enc", "_g")


def region_target_encoding(df: DataFrame, target: str, region_col: str = "region",
                           min_samples: int = TARGET_ENCODING_MIN_SAMPLES) -> DataFrame:
    """E3 fit: region mean / std / count and the encoding: mean when count >=
    min_samples, else count/min_samples weight towards the global mean."""
    g = df.where(_c(region_col).isNotNull()).groupBy(region_col).agg(
        F.avg(target).alias("region_price_mean"), F.stddev_samp(target).alias("region_price_std"),
        F.count(_c(target)).alias("region_count"))
    gm = df.agg(F.avg(target).alias("_g"))
    g = g.crossJoin(F.broadcast(gm))
    w = F.col("region_count") / min_samples
    enc = F.when(F.col("region_count") >= min_samples, F.col("region_price_mean")).otherwise(
        w * F.col("region_price_mean") + (1 - w) * F.col("_g"))
    return g.withColumn("region_target_encoded", enc).drop("_g")


def frequency_encoding(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raw category counts (aggregated, then joined; NULL stays NULL)."""
    out = df
    for c in cols:
        f = df.where(_c(c).isNotNull()).groupBy(_c(c).alias(c)).agg(F.count(F.lit(1)).alias(f"{c}_frequency"))
        out = attach(out, f, c)
    return out


def group_rare(df: DataFrame, col: str, threshold: float = RARE_CATEGORY_THRESHOLD, other_label: str = "Other",
               denominator: str = "all") -> DataFrame:
    """E5: categories with a share below ``threshold`` become ``other_label``;
    the share is over all rows (``all``) or over non-null rows (``non_null``)."""
    counts = df.where(_c(col).isNotNull()).groupBy(_c(col).alias(col)).agg(F.count(F.lit(1)).alias("_k"))
    tot = df.agg((F.count(F.lit(1)) if denominator == "all" else F.count(_c(col))).alias("_tot"))
    rare = counts.crossJoin(F.broadcast(tot)).select(col, (F.col("_k") / F.col("_tot") < threshold).alias("_rare"))
    out = attach(df, rare, col)
    return out.withColumn(f"{col}_grouped", F.when(F.coalesce(F.col("_rare"), F.lit(False)), F.lit(other_label)).otherwise(_c(col))).drop("_rare")


# E7-E9 / E14 -----------------------------------------------------------------
def fit_scaler(fit_df: DataFrame, cols: Sequence[str], kind: str = "standard", mode: str = "exact") -> DataFrame:
    """One-row table of fitted statistics (standard: mean, population std;
    minmax: min, max; robust: median, q25, q75)."""
    if kind == "standard":
        return fit_df.agg(*[F.avg(_c(c)).alias(f"{c}__a") for c in cols], *[F.stddev_pop(_c(c)).alias(f"{c}__b") for c in cols])
    if kind == "minmax":
        return fit_df.agg(*[F.min(_c(c)).alias(f"{c}__a") for c in cols], *[F.max(_c(c)).alias(f"{c}__b") for c in cols])
    if kind == "robust":
        specs = []
        for c in cols:
            specs += [(f"{c}__a", "median", c), (f"{c}__q25", "q25", c), (f"{c}__q75", "q75", c)]
        st = grouped_stats(fit_df, [], specs, mode)
        return st.select(*[F.col(f"`{c}__a`") for c in cols],
                         *[(F.col(f"`{c}__q75`") - F.col(f"`{c}__q25`")).alias(f"{c}__b") for c in cols])
    raise ValueError(kind)


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str], kind: str = "standard",
                 feature_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    suffix = {"standard": "_scaled", "minmax": "_minmax", "robust": "_robust"}[kind]
    out = df.crossJoin(F.broadcast(stats))
    exprs = {}
    for c in cols:
        a, b = F.col(f"`{c}__a`"), F.col(f"`{c}__b`")
        if kind == "minmax":
            lo, hi = feature_range
            rng = F.when(b - a == 0, F.lit(1.0)).otherwise(b - a)
            exprs[f"{c}{suffix}"] = (_c(c) - a) / rng * (hi - lo) + lo
        else:
            scale = F.when((b == 0) | b.isNull(), F.lit(1.0)).otherwise(b)
            exprs[f"{c}{suffix}"] = (_c(c) - a) / scale
    return out.withColumns(exprs).drop(*[x for x in stats.columns])


def median_imputation(df: DataFrame, cols: Sequence[str], year_col: str = "year", holdout_start: int = 2023,
                      mode: str = "exact") -> DataFrame:
    """E14 + P18: medians from pre-holdout rows only (0 when a column has none), filled into NULL, NaN and infinite values."""
    clean = lambda c: F.when(F.abs(_c(c).cast("double")) < float("inf"), _c(c))
    fit = df.where(_c(year_col) < holdout_start).select(*[clean(c).alias(c) for c in cols])
    med = grouped_stats(fit, [], [(f"{c}__med", "median", c) for c in cols], mode)
    out = df.crossJoin(F.broadcast(med)).withColumns({c: F.coalesce(clean(c), F.col(f"`{c}__med`"), F.lit(0.0)) for c in cols})
    return out.drop(*[f"{c}__med" for c in cols])


# E15 / E16 -------------------------------------------------------------------
def temporal_split_summary(df: DataFrame, year_col: str = "year", last_train_year: int = 2017,
                           test_start_year: int | None = None) -> DataFrame:
    """E15 (one row): train <= last_train_year, test >= test_start_year: sizes, % and periods."""
    ts = test_start_year if test_start_year is not None else last_train_year + 1
    y = _c(year_col)
    tr, te = y <= last_train_year, y >= ts
    s = df.agg(F.count(F.lit(1)).alias("_n"), F.count_if(tr).alias("train_size"), F.count_if(te).alias("test_size"),
               F.min(F.when(tr, y)).alias("_tr0"), F.max(F.when(tr, y)).alias("_tr1"),
               F.min(F.when(te, y)).alias("_te0"), F.max(F.when(te, y)).alias("_te1"))
    return s.select("train_size", "test_size",
                    (F.col("train_size") / F.col("_n") * 100.0).alias("train_pct"),
                    (F.col("test_size") / F.col("_n") * 100.0).alias("test_pct"),
                    F.concat_ws("-", "_tr0", "_tr1").alias("train_period"),
                    F.concat_ws("-", "_te0", "_te1").alias("test_period"))


def fold_table(spark, min_train_end: int, max_train_end: int, holdout_start: int) -> DataFrame:
    """(fold_id, train_end, val_year) of the expanding walk-forward folds."""
    rows = []
    for i, te in enumerate(range(min_train_end, max_train_end + 1)):
        if te + 1 >= holdout_start:
            break
        rows.append((i, te, te + 1))
    return spark.createDataFrame(rows, "fold_id int, train_end int, val_year int")


def walk_forward_sizes(df: DataFrame, folds: DataFrame, year_col: str = "year") -> DataFrame:
    """Rows per fold role from one aggregation per year; the handful of
    fold definitions is attached to each per-year row as an array."""
    fl = folds.collect()  # a few (fold_id, train_end, val_year) rows
    arr = F.array(*[F.struct(F.lit(f.fold_id).alias("fold_id"), F.lit(f.train_end).alias("train_end"),
                             F.lit(f.val_year).alias("val_year")) for f in fl])
    per_year = df.groupBy(_c(year_col).alias("_y")).agg(F.count(F.lit(1)).alias("_k"))
    j = per_year.withColumn("_f", F.explode(arr)).select("_y", "_k", "_f.*")
    return j.groupBy("fold_id", "train_end", "val_year").agg(
        F.sum(F.when(F.col("_y") <= F.col("train_end"), F.col("_k")).otherwise(0)).alias("train_size"),
        F.sum(F.when(F.col("_y") == F.col("val_year"), F.col("_k")).otherwise(0)).alias("val_size"))



# P16 / P17 -------------------------------------------------------------------



class LeakageError(ValueError):
    pass


def leak_guard(columns: Sequence[str], forbidden: Sequence[str] = FORBIDDEN_FEATURES) -> None:
    """Fail when any forbidden column is present."""
    bad = sorted(set(columns) & set(forbidden))
    if bad:
        raise LeakageError(f"forbidden feature columns present: {bad}")


def cardinalities(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Distinct counts of the candidate categorical columns (one small row to the driver)."""
    if not cols:
        return {}
    row = df.agg(*[F.count_distinct(_c(c)).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


def encode_categoricals(df: DataFrame, cols: Sequence[str], target: str, region_col: str = "region") -> DataFrame:
    """One-hot for columns with at most 10 categories (except region);
    region gets target and frequency encoding."""
    card = cardinalities(df, [c for c in cols if c != region_col])
    out = df
    for c, k in card.items():
        if k <= MAX_CATEGORIES_ONEHOT:
            out = one_hot(out, c, drop_first=True, max_categories=MAX_CATEGORIES_ONEHOT)
    if region_col in df.columns:
        enc = region_target_encoding(df, target, region_col).select(region_col, "region_target_encoded", "region_price_mean", "region_count")
        out = attach(out, enc, region_col)
        out = frequency_encoding(out, [region_col])
    return out



# F6 / F14 / E18 ---------------------------------------------------------------
ROOM_SIZE_LABELS = ("Small", "Medium", "Large", "XLarge")


def size_features_b(df: DataFrame, sqm_col: str = "sqm", rooms_col: str = "no_rooms", mode: str = "exact") -> DataFrame:
    """rooms cut at 2 / 4 / 6 (right-closed), size tertiles at q33 / q67,
    or, when those coincide, equal-count tertiles of the row order by size
    (ties by position, via the skew-proof global rank); sqm per room and
    rooms per sqm."""
    s, r = _c(sqm_col), _c(rooms_col)
    rooms_cat = F.when(r <= 2, ROOM_SIZE_LABELS[0]).when(r <= 4, ROOM_SIZE_LABELS[1]).when(r <= 6, ROOM_SIZE_LABELS[2]) \
        .when(r.isNotNull(), ROOM_SIZE_LABELS[3])
    thr = scalar_quantiles(df, sqm_col, [0.33, 0.67], ["_s33", "_s67"], mode)
    out = df.crossJoin(F.broadcast(thr))
    by_value = F.when(s <= F.col("_s33"), SIZE_LABELS[0]).when(s <= F.col("_s67"), SIZE_LABELS[1]).when(s.isNotNull(), SIZE_LABELS[2])
    out = out.withColumns({"rooms_category": rooms_cat, "size_category": by_value,
                           "sqm_per_room": F.try_divide(s, r.cast("double")),
                           "rooms_sqm_ratio": F.try_divide(r.cast("double"), s)})
    degenerate = thr.where(F.col("_s33") >= F.col("_s67")).count() > 0  # one row
    if degenerate:
        v = out.where(s.isNotNull()).withColumn("_row", F.monotonically_increasing_id())
        rk = rank_within_groups(v, [], [s, F.col("_row")])
        tert = F.when(F.col("_rank") < F.col("_n") / 3.0, SIZE_LABELS[0]).when(
            F.col("_rank") < 2 * F.col("_n") / 3.0, SIZE_LABELS[1]).otherwise(SIZE_LABELS[2])
        out = rk.withColumn("size_category", tert).drop("_rank", "_n", "_row").unionByName(
            out.where(s.isNull()), allowMissingColumns=True)
    return out.drop("_s33", "_s67")


LEGACY_LEAK_COLUMNS = ("price_per_sqm", "price_zscore", "price_category", "is_premium", "price_deviation_from_median")


def drop_legacy_leaks(df: DataFrame) -> DataFrame:
    """remove columns of the older pipeline that were computed from the target."""
    return df.drop(*[c for c in LEGACY_LEAK_COLUMNS if c in df.columns])


def save_stats(stats: DataFrame, path: str) -> None:
    """Store fitted statistics (scaler / encoder tables) as Parquet."""
    stats.write.mode("overwrite").parquet(path)


def load_stats(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


# E10 -------------------------------------------------------------------------
def strategy_scale(df: DataFrame, fit_df: DataFrame, cols: Sequence[str], cyclic: Sequence[str] = (), skew_limit: float = 1.0,
                   suffix: str = "_scaled", mode: str = "exact") -> DataFrame:
    """Each column by its skewness in ``fit_df`` (bias-corrected, as pandas):
    standard up to ``skew_limit``, robust beyond; columns in ``cyclic`` go
    through min-max to [0, 1] after that, which undoes the first step's shift
    and scale. A column without a skewness (constant, fewer than three values)
    stays as it is. One row of statistics is broadcast."""
    specs = []
    for c in cols:
        specs += [(f"{c}__n", "count", c), (f"{c}__m", "mean", c), (f"{c}__lo", "min", c), (f"{c}__hi", "max", c),
                  (f"{c}__q50", "median", c), (f"{c}__q25", "q25", c), (f"{c}__q75", "q75", c)]
    fit = fit_df.select(*[_c(c).cast("double").alias(c) for c in cols])
    st = grouped_stats(fit, [], specs, mode).crossJoin(F.broadcast(fit.agg(
        *[F.stddev_pop(_c(c)).alias(f"{c}__s") for c in cols], *[F.skewness(F.when(~F.isnan(_c(c)), _c(c))).alias(f"{c}__g") for c in cols])))
    out = df.crossJoin(F.broadcast(st))
    exprs = {}
    for c in cols:
        n, m, s, lo, hi, q25, q50, q75, g = (F.col(f"`{c}__{k}`") for k in ("n", "m", "s", "lo", "hi", "q25", "q50", "q75", "g"))
        skew = F.try_divide(F.sqrt(n * (n - 1.0)) * g, n - 2.0)
        one = lambda x: F.when((x == 0) | x.isNull(), F.lit(1.0)).otherwise(x)
        if c in cyclic:
            exprs[f"{c}{suffix}"] = (_c(c) - lo) / one(hi - lo)
        else:
            exprs[f"{c}{suffix}"] = F.when(F.abs(skew) <= skew_limit, (_c(c) - m) / one(s)).when(
                F.abs(skew) > skew_limit, (_c(c) - q50) / one(q75 - q25)).otherwise(_c(c))
    return out.withColumns(exprs).drop(*st.columns)
