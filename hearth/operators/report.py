"""Summaries and reports.

Report tables are long (section, metric, value) rows built from small
aggregates, so every figure stays a Spark value until the sink.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.stats import grouped_stats
from hearth.operators import profile as P

# --- fixed values (recommendation rules) ------------------------------------
MISSING_HIGH, MISSING_MEDIUM = 50.0, 10.0
SKEW_HIGH = 2.0
OUTLIER_PCT = 5.0
CARD_HIGH, CARD_MEDIUM = 50, 10
RANGE_RATIO = 100.0
# -----------------------------------------------------------------------------


def _kv(section: str, pairs: Sequence[tuple[str, Column]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(k).alias("metric"), v.cast("double").alias("value"))
                               for k, v in pairs]))


def business_insights(df: DataFrame, mode: str = "exact") -> DataFrame:
    """Q13 (one row): price median / mean / cv, sqm median and q75, most
    common room count, share of the top region, build-year quartiles."""
    st = grouped_stats(df, [], [("price_median", "median", "purchase_price"), ("price_mean", "mean", "purchase_price"),
                               ("_std", "std", "purchase_price"), ("sqm_median", "median", "sqm"), ("sqm_q75", "q75", "sqm"),
                               ("year_build_q25", "q25", "year_build"), ("year_build_median", "median", "year_build"),
                               ("year_build_q75", "q75", "year_build")], mode)
    rooms = (df.where(F.col("no_rooms").isNotNull()).groupBy("no_rooms").agg(F.count(F.lit(1)).alias("_k"))
             .agg(F.min_by("no_rooms", F.struct(-F.col("_k"), F.col("no_rooms"))).alias("rooms_mode")))
    reg = df.where(F.col("region").isNotNull()).groupBy("region").agg(F.count(F.lit(1)).alias("_k"))
    top = reg.agg((F.max("_k") / F.sum("_k") * 100.0).alias("top_region_share"),
                  F.min_by("region", F.struct(-F.col("_k"), F.col("region"))).alias("top_region"))
    return st.crossJoin(rooms).crossJoin(top).select(
        "price_median", "price_mean", (F.col("_std") / F.col("price_mean") * 100.0).alias("price_cv"), "sqm_median", "sqm_q75",
        "rooms_mode", "top_region", "top_region_share", "year_build_q25", "year_build_median", "year_build_q75")


def executive_summary(df: DataFrame, mode: str = "exact") -> DataFrame:
    """Long KPI table: totals, median price by house type and by
    region with their share of sales, and the sales channels by volume."""
    tot = df.agg(F.count(F.lit(1)).alias("n"))
    overall = grouped_stats(df, [], [("median", "median", "purchase_price"), ("mean", "mean", "purchase_price")], mode)
    parts = [overall.crossJoin(tot).select(_kv("overall", [("transactions", F.col("n")), ("median_price", F.col("median")),
                                                            ("mean_price", F.col("mean"))]))]
    for key, section in (("house_type", "by_house_type"), ("region", "by_region"), ("sales_type", "by_sales_type")):
        g = grouped_stats(df, [key], [("n", "size", "purchase_price"), ("median", "median", "purchase_price")], mode)
        g = g.crossJoin(F.broadcast(tot.withColumnRenamed("n", "_tot")))
        parts.append(g.select(F.explode(F.array(
            F.struct(F.lit(section).alias("section"), F.concat(F.col(key), F.lit(":median_price")).alias("metric"), F.col("median").cast("double").alias("value")),
            F.struct(F.lit(section).alias("section"), F.concat(F.col(key), F.lit(":share_pct")).alias("metric"), (F.col("n") / F.col("_tot") * 100.0).alias("value")),
        ))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("col.section", "col.metric", "col.value")


def univariate_summary(num_profile: DataFrame, cat_profile: DataFrame, null_pct: DataFrame) -> DataFrame:
    """Q12 (one row) from the column profiles: column counts, mean missing %,
    skewed columns, columns with > 5 % IQR outliers, high cardinality, low diversity."""
    n = num_profile.agg(F.count(F.lit(1)).alias("n_numeric"),
                        F.count_if(F.abs("skewness") > 1).alias("n_skew_gt1"), F.count_if(F.abs("skewness") > 2).alias("n_skew_gt2"),
                        F.count_if(F.col("n_outliers") / (F.col("count") + F.col("n_missing")) * 100.0 > OUTLIER_PCT).alias("n_outlier_gt5pct"))
    c = cat_profile.agg(F.count(F.lit(1)).alias("n_categorical"), F.count_if(F.col("n_unique") > CARD_HIGH).alias("n_card_gt50"),
                        F.count_if(F.col("shannon_diversity") < 1).alias("n_shannon_lt1"))
    m = null_pct.agg(F.avg("null_pct").alias("mean_missing_pct"))
    return n.crossJoin(c).crossJoin(m)


def recommendations(num_profile: DataFrame, cat_profile: DataFrame, null_pct: DataFrame) -> DataFrame:
    """Q14: rule table (kind, column, detail) over the profile statistics."""
    miss = null_pct.select(
        F.when(F.col("null_pct") > MISSING_HIGH, "drop_or_impute_high_missing").when(F.col("null_pct") > MISSING_MEDIUM, "impute_missing").alias("kind"),
        F.col("column_name"), F.format_string("missing %.2f %%", F.col("null_pct")).alias("detail"))
    skew = num_profile.select(F.when(F.abs("skewness") > SKEW_HIGH, "transform_skewed").alias("kind"), "column_name",
                              F.format_string("skewness %.3f", F.col("skewness")).alias("detail"))
    outl = num_profile.select(
        F.when(F.col("n_outliers") / (F.col("count") + F.col("n_missing")) * 100.0 > OUTLIER_PCT, "treat_outliers").alias("kind"),
        "column_name", F.format_string("%d IQR outliers", F.col("n_outliers")).alias("detail"))
    # one rule over all columns: the widest column's range against the narrowest one's
    span = num_profile.agg(F.max(F.col("max") - F.col("min")).alias("hi"), F.min(F.col("max") - F.col("min")).alias("lo"), F.count(F.lit(1)).alias("k"))
    rng = span.select(F.when((F.col("k") > 1) & (F.col("hi") > RANGE_RATIO * F.col("lo")), "scale_different_ranges").alias("kind"),
                      F.lit("*").alias("column_name"), F.format_string("widest range %.1f, narrowest %.1f", F.col("hi"), F.col("lo")).alias("detail"))
    card = cat_profile.select(F.when(F.col("n_unique") > CARD_HIGH, "encode_high_cardinality")
                              .when(F.col("n_unique") > CARD_MEDIUM, "group_rare_categories").alias("kind"),
                              "column_name", F.format_string("%d categories", F.col("n_unique")).alias("detail"))
    out = miss.unionByName(skew).unionByName(outl).unionByName(rng).unionByName(card)
    return out.where(F.col("kind").isNotNull())


def column_null_pct(df: DataFrame) -> DataFrame:
    """(column_name, null_pct) for every column (one aggregate)."""
    s = P.null_summary(df)
    allc = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    return allc.join(s.select("column_name", F.col("null_percentage").alias("null_pct")), "column_name", "left").fillna(0.0, ["null_pct"])


def complete_analysis(df: DataFrame, mode: str = "exact") -> dict[str, DataFrame]:
    """Q15: the analysis facade: quality, profiles, summary, recommendations."""
    num = P.numeric_profile(df, mode=mode)
    cat = P.categorical_profile(df)
    nul = column_null_pct(df)
    return {"quality": P.quality_report(df), "numeric": num, "categorical": cat,
            "summary": univariate_summary(num, cat, nul), "recommendations": recommendations(num, cat, nul)}


def format_stats(df: DataFrame, money_cols: Sequence[str], pct_cols: Sequence[str] = (), count_cols: Sequence[str] = ()) -> DataFrame:
    """display strings: thousands separators, DKK suffix, percentages."""
    return df.withColumns({**{c: F.concat(F.format_number(F.col(c), 0), F.lit(" DKK")) for c in money_cols},
                           **{c: F.concat(F.format_number(F.col(c), 1), F.lit("%")) for c in pct_cols},
                           **{c: F.format_number(F.col(c), 0) for c in count_cols}})


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """U4: added / removed / retyped columns between two frames (metadata only)."""
    a, b = dict(before.dtypes), dict(after.dtypes)
    rows = [("added", c, b[c]) for c in after.columns if c not in a]
    rows += [("removed", c, a[c]) for c in before.columns if c not in b]
    rows += [("retyped", c, f"{a[c]} -> {b[c]}") for c in after.columns if c in a and a[c] != b[c]]
    return before.sparkSession.createDataFrame(rows, "change string, column_name string, dtype string")


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation factors without an intercept (uncentred), from
    the p x p Gram matrix aggregated by Spark in one pass; the small inverse
    is taken on the driver. VIF_i = G_ii * (G^-1)_ii."""
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).na.drop()
    p = len(cols)
    row = d.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    inv = np.linalg.pinv(g)
    rows = [(c, float(g[i, i] * inv[i, i])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "variable string, vif double")

