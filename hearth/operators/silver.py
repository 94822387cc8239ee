"""Silver: quality flags that never drop rows (P4-P9), CPI chain and deflation
(A1, W1, W2, J2) and the postal-centroid join (J3).

Per-group statistics (zip counts, house-type price quantiles, quarterly
inflation medians) are aggregated first, written, measured and joined back by
broadcast if they fit, so no group is ever buffered by a window over the fact
table and the fact isn't shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.config import EngineConfig
from hearth.functions.quantile import group_quantiles
from hearth.functions.scalar import all_false_if_null
from hearth.sources.scratch import attach

FLAG_PREFIX = "is_"
FLAGS = ("is_pre_1995_record", "is_family_sale", "is_unclassified_sale", "is_missing_sqm", "is_missing_year_build",
         "is_low_sample_cell", "is_outlier_price")


def add_quality_flags(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    family = [s.lower() for s in cfg.family_sale_types]
    st = F.col("sales_type")
    out = df.withColumns({
        "is_pre_1995_record": all_false_if_null(F.col("year_sale") < 1995),
        "is_family_sale": all_false_if_null(F.lower(F.trim(st)).isin(family)),
        "is_unclassified_sale": all_false_if_null((st == "-") | (F.lower(st) == "nan")) | st.isNull(),
        "is_missing_sqm": all_false_if_null(F.col("sqm").isNull() | (F.col("sqm") <= 0)),
        "is_missing_year_build": F.col("year_build").isNull(),
    })
    # zip cell size over the whole history: aggregate, then join back
    zc = (df.where(F.col("zip_code").isNotNull()).groupBy("zip_code")
          .agg(F.count(F.lit(1)).alias("_zip_n")))
    out = attach(out, zc, "zip_code").withColumn(
        "is_low_sample_cell", all_false_if_null(F.col("_zip_n") < cfg.low_sample_threshold)).drop("_zip_n")
    lo_p, hi_p = cfg.outlier_quantiles
    pq = group_quantiles(df.where(F.col("house_type").isNotNull()), ["house_type"], "purchase_price",
                         [lo_p, hi_p], ["_p_lo", "_p_hi"], cfg.quantile_mode)
    out = attach(out, pq, "house_type")
    price = F.col("purchase_price")
    out = out.withColumn("is_outlier_price", all_false_if_null((price < F.col("_p_lo")) | (price > F.col("_p_hi"))))
    return out.drop("_p_lo", "_p_hi")


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(FLAG_PREFIX)]


def cpi_chain(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Quarterly CPI: median annual inflation per quarter, quarterly factor
    (1+r/100)^0.25, running product in quarter order. A quarter without a rate
    has a NULL index and the chain continues past it. One row per quarter, so
    the global ordered window runs on ~4 rows per year."""
    q = group_quantiles(df.where(F.col("quarter_id").isNotNull()), ["quarter_id"], "dk_ann_infl_rate%", [0.5],
                        ["dk_ann_infl_rate_pct"], cfg.quantile_mode)
    quarters = df.where(F.col("quarter_id").isNotNull()).select("quarter_id").distinct()
    q = quarters.join(q, "quarter_id", "left")
    factor = F.pow(F.lit(1.0) + F.col("dk_ann_infl_rate_pct") / 100.0, 0.25)
    w = Window.orderBy("quarter_id").rowsBetween(Window.unboundedPreceding, 0)
    return q.select(
        "quarter_id", "dk_ann_infl_rate_pct",
        F.when(F.col("dk_ann_infl_rate_pct").isNotNull(), F.product(factor).over(w)).alias("cpi_index_q"),
    )


def cpi_base(cpi: DataFrame, base_year: int) -> DataFrame:
    """One row: CPI of the last quarter of ``base_year``; without such quarters,
    of the last quarter overall."""
    in_base = F.substring("quarter_id", 1, 4) == str(base_year)
    return cpi.agg(
        F.when(F.max(in_base.cast("int")) == 1,
               F.max_by(F.when(in_base, F.col("cpi_index_q")), F.when(in_base, F.col("quarter_id"))))
        .otherwise(F.max_by("cpi_index_q", "quarter_id")).alias("_cpi_base"))


def deflate(df: DataFrame, cpi: DataFrame, base_year: int) -> DataFrame:
    """real = nominal * (cpi_base / cpi_index_q) for price and sqm price."""
    base = cpi_base(cpi, base_year)
    small = cpi.select("quarter_id", "cpi_index_q").crossJoin(F.broadcast(base))
    small = small.withColumn("_deflator", F.col("_cpi_base") / F.col("cpi_index_q")).drop("_cpi_base")
    # one row per quarter: bounded by the calendar, safe to broadcast
    out = df.join(F.broadcast(small), "quarter_id", "left")
    return out.withColumns({
        "real_purchase_price": (F.col("purchase_price") * F.col("_deflator")).cast("double"),
        "real_sqm_price": (F.col("sqm_price") * F.col("_deflator")).cast("double"),
    }).drop("_deflator")


def one_centroid_per_zip(centroids: DataFrame) -> DataFrame:
    """The centroid of each zip code, of several the one with the first municipality name (none comes last)."""
    return (centroids.where(F.col("zip_code").isNotNull())
            .groupBy("zip_code")
            .agg(F.min(F.struct(F.col("municipality_name").isNull(), "municipality_name", "lat", "lon")).alias("_g"))
            .select("zip_code", "_g.lat", "_g.lon", "_g.municipality_name"))


def join_postal_centroids(df: DataFrame, centroids: DataFrame) -> DataFrame:
    """Left join of one centroid row per zip (``one_centroid_per_zip``); ``geo_join_status`` = matched / unmatched by
    lat. A table with repeated zips multiplies sales; writing the result with its expected rows fails then."""
    out = attach(df, centroids, "zip_code")
    return out.withColumn("geo_join_status", F.when(F.col("lat").isNull(), "unmatched").otherwise("matched"))


def silver(bronze_df: DataFrame, cfg: EngineConfig = EngineConfig(), centroids: DataFrame | None = None) -> DataFrame:
    out = add_quality_flags(bronze_df, cfg)
    out = deflate(out, cpi_chain(bronze_df, cfg), cfg.cpi_base_year)
    if centroids is not None:
        out = join_postal_centroids(out, one_centroid_per_zip(centroids))
    return out


def report_flags(df: DataFrame, iqr_factor: float = 3.0, mode: str = "exact") -> DataFrame:
    """P10: the profiling report's flags, none of which drops a row: city
    NULL -> 'Unknown', macro rates missing, sales type classifiable, build
    year before 1800, preliminary period (before 1995) and extreme price /
    sqm-price outliers outside [Q1 - 3 IQR, Q3 + 3 IQR] of the whole column."""
    out = df
    if "city" in df.columns:
        out = out.withColumn("city", F.coalesce(F.col("city"), F.lit("Unknown")))
    q = group_quantiles(df, [], "purchase_price", [0.25, 0.75], ["_p1", "_p3"], mode).crossJoin(
        group_quantiles(df, [], "sqm_price", [0.25, 0.75], ["_s1", "_s3"], mode))
    out = out.crossJoin(F.broadcast(q))

    def outside(c, lo, hi):
        iqr = F.col(hi) - F.col(lo)
        return all_false_if_null((F.col(c) < F.col(lo) - iqr_factor * iqr) | (F.col(c) > F.col(hi) + iqr_factor * iqr))

    return out.withColumns({
        "macro_nulo": F.col("dk_ann_infl_rate%").isNull() | F.col("yield_on_mortgage_credit_bonds%").isNull(),
        "sales_type_valido": ~all_false_if_null(F.col("sales_type") == "-"),
        "year_build_flag": all_false_if_null(F.col("year_build") < 1800),
        "periodo_preliminar": all_false_if_null(F.year("date") < 1995),
        "purchase_price_outlier": outside("purchase_price", "_p1", "_p3"),
        "sqm_price_outlier": outside("sqm_price", "_s1", "_s3"),
    }).drop("_p1", "_p3", "_s1", "_s3")


def complete_cases(df: DataFrame, cols=None, min_year_build: int = 1800, min_price: float = 100_000,
                   max_price: float = 50_000_000) -> DataFrame:
    """The report's cleaning rules: build year >= 1800, price within
    [100 k, 50 M], then rows without any NULL in ``cols`` (all columns by default)."""
    out = df.where((F.col("year_build") >= min_year_build) & F.col("purchase_price").between(min_price, max_price))
    return out.na.drop(subset=list(cols) if cols else None)
