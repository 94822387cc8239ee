"""Sources, sinks, manifests, report flags, summaries (S2-S16, P10, P13, F6, F14,
F18, A26, Q12-Q15, Q18, U4, T7, E18)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.config import DRIVER_CONFIG as CFG
from hearth.operators import features as X
from hearth.operators import gold, report, stl
from hearth.operators.silver import FLAGS, complete_cases, join_postal_centroids, one_centroid_per_zip, report_flags
from hearth.plans.layers import _root, _slug, bronze_table, figures, price_index_table, silver_table
from hearth.plans.q_medallion import DRAWDOWN_SQL_CTES, ELASTICITY_SQL_CTES
from hearth.plans.registry import register
from hearth.plans.sql import with_ctes, with_layers
from hearth.sources import io
from hearth.sources.tables import read_table

M = CFG.quantile_mode


def _out(spark, name: str) -> str:
    return f"{_root(spark)}/{name}-{spark.sparkContext.applicationId}"


CSV_SCHEMA = T.StructType([T.StructField("date", T.TimestampNTZType()), T.StructField("region", T.StringType()),
                           T.StructField("house_type", T.StringType()), T.StructField("purchase_price", T.DoubleType())])


@register("csv_export_validate", ("S2", "S3", "S15"), with_layers("""
SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT region) AS n_regions,
       min(purchase_price) AS min_price, max(purchase_price) AS max_price FROM bronze"""))
def csv_export_validate(spark, sf_dir):
    """S15 -> S3 -> S2: export sales to ';'-separated CSV, read it back with an explicit schema, validate."""
    path = _out(spark, "sales-csv")
    io.write_csv(bronze_table(spark, sf_dir, CFG).select("date", "region", "house_type", "purchase_price"), path, sep=";")
    return io.validate_load(io.read_csv(spark, path, sep=";", schema=CSV_SCHEMA))


def _landed_postal_json(spark, sf_dir) -> str:
    """Postal-code records in the landed JSON shape, derived from customer x nation."""
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    z = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy((F.col("c_custkey") % 1000).cast("string").alias("nr")).agg(
        F.min("c_acctbal").alias("_lo"), F.max("c_acctbal").alias("_hi"), F.min("n_name").alias("_m"))
    rec = z.select("nr", F.concat(F.lit("Postal "), F.col("nr")).alias("navn"),
                   F.array(F.col("_lo") / 100.0, F.col("_hi") / 100.0).alias("visueltcenter"),
                   F.array(F.struct(F.col("_m").alias("navn"))).alias("kommuner"))
    path = _out(spark, "postal-json")
    rec.write.mode("overwrite").json(path)
    return path


CENTROIDS_SQL = """
cz AS (SELECT CAST(c.c_custkey % 1000 AS VARCHAR) AS nr, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1),
cent AS (SELECT CASE WHEN length(nr) < 4 THEN lpad(nr, 4, '0') ELSE nr END AS zip_code,
                CAST(lo / 100.0 AS FLOAT) AS lon, CAST(hi / 100.0 AS FLOAT) AS lat FROM cz)"""


@register("postal_geo_join", ("S4", "J3"), with_ctes(CENTROIDS_SQL, """SELECT CASE WHEN c.lat IS NULL THEN 'unmatched' ELSE 'matched' END AS geo_join_status, count(*) AS n,
       round(CAST(avg(c.lat) AS DOUBLE), 2) AS mean_lat, round(CAST(avg(c.lon) AS DOUBLE), 2) AS mean_lon
FROM silver s LEFT JOIN cent c ON s.zip_code = c.zip_code GROUP BY 1"""))
def postal_geo_join(spark, sf_dir):
    """S4 + J3: parse the landed postal JSON and left-join the centroids on zip code; coverage."""
    cent = io.postal_centroids(spark, _landed_postal_json(spark, sf_dir))
    g = join_postal_centroids(silver_table(spark, sf_dir, CFG), one_centroid_per_zip(cent))
    return g.groupBy("geo_join_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("lat").cast("double")), 2).alias("mean_lat"),
                                            F.round(F.avg(F.col("lon").cast("double")), 2).alias("mean_lon"))


SILVER_CAVEATS = ("inflation is an annual rate given per quarter; the index compounds (1 + r)^0.25 a quarter",
                  "zip codes without a centroid stay unmatched")
GOLD_CAVEATS = ("bond elasticity is observational OLS, not causal",
                "drawdown episodes enter below -2 % and leave above -1 %")


def _kpis(spark, sf_dir):
    """The five KPI tables by extract name."""
    s, pi = silver_table(spark, sf_dir, CFG), price_index_table(spark, sf_dir, CFG)
    volume = gold.transaction_volume(s)
    return {"kpi_sqm_price_index": pi, "kpi_transaction_volume": volume, "kpi_drawdown": gold.drawdown(pi, CFG),
            "kpi_volatility": gold.volatility(pi, CFG), "kpi_bond_elasticity": gold.bond_elasticity(volume, s, CFG)}


_EXTRACTS: dict = {}


def _extracts(spark, sf_dir):
    """The typed extracts, written once per session and input; figures of each write."""
    root = _out(spark, "extracts") + f"-{_slug(sf_dir)}"
    if root not in _EXTRACTS:
        _EXTRACTS[root] = io.write_extracts(_kpis(spark, sf_dir), root)
    return _EXTRACTS[root]


_KPI_ROWS_SQL = """vol AS (SELECT region, quarter_id, house_type FROM silver WHERE region IS NOT NULL AND quarter_id IS NOT NULL AND house_type IS NOT NULL
        GROUP BY region, quarter_id, house_type),
kpi AS (SELECT 'kpi_sqm_price_index' AS table_name, count(*) AS n_rows, 7 AS n_columns FROM price_index
        UNION ALL SELECT 'kpi_transaction_volume', count(*), 7 FROM vol
        UNION ALL SELECT 'kpi_drawdown', count(*), 9 FROM eps
        UNION ALL SELECT 'kpi_volatility', count(*), 6 FROM price_index
        UNION ALL SELECT 'kpi_bond_elasticity', count(*), 8 FROM res WHERE n_observations >= 10)"""


@register("silver_manifest", ("S8", "S9", "J11", "J3"), with_ctes(CENTROIDS_SQL, f"""
SELECT (SELECT count(*) FROM bronze) AS source_row_count, count(*) AS output_row_count, {", ".join(f"sum(CAST({f} AS BIGINT)) AS n_{f}" for f in FLAGS)},
       count(c.lat) AS geo_matched, round_even(count(c.lat) / count(*) * 100.0, 1) AS geo_coverage_pct,
       (SELECT count(*) FROM (SELECT region FROM silver WHERE region IS NOT NULL AND quarter_id IS NOT NULL GROUP BY region HAVING count(DISTINCT quarter_id) >= 8)) AS stl_regions
FROM silver s LEFT JOIN cent c ON s.zip_code = c.zip_code"""))
def silver_manifest(spark, sf_dir):
    """S8 + S9 + J11: Silver with centroids written by the row-count invariant; the manifest's figures are those of the write."""
    bronze_table(spark, sf_dir, CFG)
    n = figures(spark, "bronze", sf_dir)["rows"]
    s = silver_table(spark, sf_dir, CFG)
    geo = join_postal_centroids(s, one_centroid_per_zip(io.postal_centroids(spark, _landed_postal_json(spark, sf_dir))))
    path = _out(spark, "silver-geo")
    seen = io.write_observed(geo, path, {f"n_{f}": F.sum(F.col(f).cast("long")) for f in FLAGS} | {"geo_matched": F.count_if(F.col("geo_join_status") == "matched")}, n)
    regions = stl.stl_per_region(s, CFG).select("region").distinct().count()
    fig = {k: v for k, v in seen.items() if k != "rows"} | {"geo_coverage_pct": round(seen["geo_matched"] / seen["rows"] * 100.0, 1) if seen["rows"] else 0.0, "stl_regions": regions}
    io.write_manifest(io.manifest(geo, "silver", path, seen["rows"], n, fig, SILVER_CAVEATS), f"{path}-manifest")
    m = spark.read.schema("source_row_count long, output_row_count long, figures map<string,double>").json(f"{path}-manifest")
    whole = [*[f"n_{f}" for f in FLAGS], "geo_matched"]
    return m.select("source_row_count", "output_row_count", *[F.col("figures")[k].cast("long").alias(k) for k in whole],
                    F.col("figures")["geo_coverage_pct"].alias("geo_coverage_pct"), F.col("figures")["stl_regions"].cast("long").alias("stl_regions"))


@register("layer_manifests", ("S6", "S7", "S8", "S11", "S12", "J11"), with_layers(
    "SELECT true AS all_present, (SELECT count(*) FROM bronze) AS bronze_rows, (SELECT count(*) FROM silver) AS silver_rows, true AS rows_match"))
def layer_manifests(spark, sf_dir):
    """Write Bronze / Silver / Gold manifests and the KPI catalogue as
    JSON, read the canonical manifest path (legacy fallback) and validate row counts."""
    b, s = bronze_table(spark, sf_dir, CFG), silver_table(spark, sf_dir, CFG)
    seen_b, seen_s = figures(spark, "bronze", sf_dir), figures(spark, "silver", sf_dir, repr(CFG))
    root = _out(spark, "manifests")
    io.write_manifest(io.manifest(b, "bronze", "bronze", seen_b["rows"]), f"{root}/bronze")
    io.write_manifest(io.manifest(s, "silver", "silver", seen_s["rows"], seen_b["rows"], {f"n_{f}": seen_s[f] for f in FLAGS}, SILVER_CAVEATS), f"{root}/silver")
    _gold_manifest(spark, sf_dir, f"{root}/gold")
    io.kpi_definitions(spark).coalesce(1).write.mode("overwrite").json(f"{root}/kpi_definitions")
    io.read_first_existing(spark, [f"{root}/gold_v2", f"{root}/gold"], "json").count()
    return io.validate_manifests(spark, f"{root}/bronze", f"{root}/silver", f"{root}/gold", strict=True)


def _gold_manifest(spark, sf_dir, path):
    seen = _extracts(spark, sf_dir)
    rows = [(k, v["rows"], v["path"], list(GOLD_CAVEATS)) for k, v in seen.items()]
    spark.createDataFrame(rows, "kpi string, rows long, path string, caveats array<string>").coalesce(1).write.mode("overwrite").json(path)


@register("gold_manifest", ("S10",), with_ctes(DRAWDOWN_SQL_CTES + "," + ELASTICITY_SQL_CTES + ",\n" + _KPI_ROWS_SQL,
                                               f"SELECT table_name AS kpi, n_rows AS rows, {len(GOLD_CAVEATS)} AS n_caveats FROM kpi"))
def gold_manifest(spark, sf_dir):
    """Rows of all five KPI tables from their manifest, with its caveats."""
    path = _out(spark, "gold-manifest")
    _gold_manifest(spark, sf_dir, path)
    m = spark.read.schema("kpi string, rows long, caveats array<string>").json(path)
    return m.select("kpi", "rows", F.size("caveats").alias("n_caveats"))


@register("typed_extracts", ("S13",), with_ctes(DRAWDOWN_SQL_CTES + "," + ELASTICITY_SQL_CTES + ",\n" + _KPI_ROWS_SQL, "SELECT * FROM kpi"))
def typed_extracts(spark, sf_dir):
    """Each KPI table cast to the BI type map and written as its own Parquet dataset, then read back."""
    rows = []
    for name, seen in _extracts(spark, sf_dir).items():
        back = spark.read.parquet(seen["path"])
        rows.append((name, back.count(), len(back.columns)))
    return spark.createDataFrame(rows, "table_name string, n_rows long, n_columns int")


@register("stratified_sample_counts", ("S14",), with_layers("""
SELECT region, year_sale, CAST(round_even(count(*) * 0.1, 0) AS BIGINT) AS n FROM silver GROUP BY region, year_sale
HAVING round_even(count(*) * 0.1, 0) > 0"""))
def stratified_sample_counts(spark, sf_dir):
    """Exact 10 % sample of each (region, year) stratum; rows per stratum."""
    smp = io.stratified_sample(silver_table(spark, sf_dir, CFG).drop("_bronze_ingest_ts"), ["region", "year_sale"], 0.10, 42)
    return smp.groupBy("region", "year_sale").agg(F.count(F.lit(1)).alias("n"))


@register("report_flags", ("P10",), with_ctes("""
q AS (SELECT quantile_cont(purchase_price, 0.25) AS p1, quantile_cont(purchase_price, 0.75) AS p3,
             quantile_cont(sqm_price, 0.25) AS s1, quantile_cont(sqm_price, 0.75) AS s3 FROM bronze)""", """
SELECT count(*) FILTER (WHERE "dk_ann_infl_rate%" IS NULL OR "yield_on_mortgage_credit_bonds%" IS NULL) AS n_macro_nulo,
       count(*) FILTER (WHERE NOT coalesce(sales_type = '-', false)) AS n_sales_type_valido,
       count(*) FILTER (WHERE coalesce(year_build < 1800, false)) AS n_year_build_flag,
       count(*) FILTER (WHERE coalesce(year(date) < 1995, false)) AS n_periodo_preliminar,
       count(*) FILTER (WHERE purchase_price < p1 - 3.0 * (p3 - p1) OR purchase_price > p3 + 3.0 * (p3 - p1)) AS n_purchase_price_outlier,
       count(*) FILTER (WHERE sqm_price < s1 - 3.0 * (s3 - s1) OR sqm_price > s3 + 3.0 * (s3 - s1)) AS n_sqm_price_outlier
FROM bronze CROSS JOIN q"""))
def report_flags_counts(spark, sf_dir):
    """P10: counts of the report's quality flags."""
    f = report_flags(bronze_table(spark, sf_dir, CFG), 3.0, M)
    return f.agg(*[F.count_if(F.col(c)).alias(f"n_{c}") for c in ("macro_nulo", "sales_type_valido", "year_build_flag",
                                                                   "periodo_preliminar", "purchase_price_outlier", "sqm_price_outlier")])


_CC_COLS = ("house_id", "house_type", "sales_type", "region", "zip_code", "purchase_price", "sqm", "sqm_price", "no_rooms", "year_build")


@register("complete_cases", ("P13",), with_layers(
    "SELECT count(*) AS n_rows, sum(purchase_price) AS total_price FROM bronze WHERE year_build >= 1800 "
    "AND purchase_price BETWEEN 100000 AND 50000000 AND " + " AND ".join(f"{c} IS NOT NULL" for c in _CC_COLS)))
def complete_cases_query(spark, sf_dir):
    """Rows kept by the complete-case cleaning rules."""
    c = complete_cases(bronze_table(spark, sf_dir, CFG), _CC_COLS)
    return c.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("purchase_price").alias("total_price"))


@register("size_features_b", ("F6", "F14"), with_ctes(
    "thr AS (SELECT quantile_cont(sqm, 0.33) AS s33, quantile_cont(sqm, 0.67) AS s67 FROM bronze)", """
SELECT rooms_category, size_category, count(*) AS n, sum(sqm_per_room) AS sum_sqm_per_room, sum(rooms_sqm_ratio) AS sum_rooms_sqm_ratio FROM (
  SELECT CASE WHEN no_rooms <= 2 THEN 'Small' WHEN no_rooms <= 4 THEN 'Medium' WHEN no_rooms <= 6 THEN 'Large'
              WHEN no_rooms IS NOT NULL THEN 'XLarge' END AS rooms_category,
         CASE WHEN sqm <= s33 THEN 'Small' WHEN sqm <= s67 THEN 'Medium' WHEN sqm IS NOT NULL THEN 'Large' END AS size_category,
         CASE WHEN no_rooms <> 0 THEN sqm / no_rooms END AS sqm_per_room, CASE WHEN sqm <> 0 THEN no_rooms / sqm END AS rooms_sqm_ratio
  FROM bronze CROSS JOIN thr) GROUP BY 1, 2"""))
def size_features_b(spark, sf_dir):
    """room and size categories (second feature set) with ratios; rows per category pair."""
    d = X.size_features_b(X.drop_legacy_leaks(bronze_table(spark, sf_dir, CFG)), mode=M)
    return d.groupBy("rooms_category", "size_category").agg(F.count(F.lit(1)).alias("n"), F.sum("sqm_per_room").alias("sum_sqm_per_room"),
                                                            F.sum("rooms_sqm_ratio").alias("sum_rooms_sqm_ratio"))


def _exec_sql() -> str:
    parts = ["""SELECT 'overall' AS section, 'transactions' AS metric, CAST(count(*) AS DOUBLE) AS value FROM bronze""",
             """SELECT 'overall', 'median_price', quantile_cont(purchase_price, 0.5) FROM bronze""",
             """SELECT 'overall', 'mean_price', avg(purchase_price) FROM bronze"""]
    for key, section in (("house_type", "by_house_type"), ("region", "by_region"), ("sales_type", "by_sales_type")):
        parts.append(f"SELECT '{section}', {key} || ':median_price', quantile_cont(purchase_price, 0.5) FROM bronze "
                     f"WHERE {key} IS NOT NULL GROUP BY {key}")
        parts.append(f"SELECT '{section}', {key} || ':share_pct', CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM bronze) * 100.0 "
                     f"FROM bronze WHERE {key} IS NOT NULL GROUP BY {key}")
    return with_layers(" UNION ALL ".join(parts))


@register("executive_summary", ("A26", "Q18"), _exec_sql())
def executive_summary(spark, sf_dir):
    """Long KPI table of the headline results."""
    return report.executive_summary(bronze_table(spark, sf_dir, CFG), M)


@register("business_insights", ("Q13",), with_layers("""
SELECT quantile_cont(purchase_price, 0.5) AS price_median, avg(purchase_price) AS price_mean,
       stddev_samp(purchase_price) / avg(purchase_price) * 100.0 AS price_cv,
       quantile_cont(sqm, 0.5) AS sqm_median, quantile_cont(sqm, 0.75) AS sqm_q75,
       (SELECT arg_min(no_rooms, struct_pack(a := -k, b := no_rooms)) FROM (SELECT no_rooms, count(*) AS k FROM bronze
         WHERE no_rooms IS NOT NULL GROUP BY no_rooms)) AS rooms_mode,
       (SELECT arg_min(region, struct_pack(a := -k, b := region)) FROM (SELECT region, count(*) AS k FROM bronze
         WHERE region IS NOT NULL GROUP BY region)) AS top_region,
       (SELECT max(k) / sum(k) * 100.0 FROM (SELECT region, count(*) AS k FROM bronze WHERE region IS NOT NULL GROUP BY region)) AS top_region_share,
       quantile_cont(year_build, 0.25) AS year_build_q25, quantile_cont(year_build, 0.5) AS year_build_median,
       quantile_cont(year_build, 0.75) AS year_build_q75 FROM bronze"""))
def business_insights(spark, sf_dir):
    """Q13: headline business figures."""
    return report.business_insights(bronze_table(spark, sf_dir, CFG), M)


_PROFILE = ("house_type", "sales_type", "region", "area", "zip_code", "purchase_price", "sqm", "sqm_price", "no_rooms", "year_build")


@register("univariate_summary", ("Q12", "Q15"))
def univariate_summary(spark, sf_dir):
    """Q12 + Q15: one-row univariate summary from the complete analysis facade."""
    a = report.complete_analysis(bronze_table(spark, sf_dir, CFG).select(*_PROFILE), M)
    return a["summary"]


@register("preprocessing_recommendations", ("Q14",))
def preprocessing_recommendations(spark, sf_dir):
    """Q14: preprocessing recommendations from the profile rules."""
    a = report.complete_analysis(bronze_table(spark, sf_dir, CFG).select(*_PROFILE), M)
    return a["recommendations"]


@register("formatted_regional_stats", ("F18",))
def formatted_regional_stats(spark, sf_dir):
    """regional stats with display formatting."""
    from hearth.operators import describe as D

    v = D.volume_stats(bronze_table(spark, sf_dir, CFG), "region")
    return report.format_stats(v, ["total_value", "mean_sqm_price"], ["market_share", "cumulative_share"], ["n_transactions"])


@register("schema_diff_bronze_silver", ("U4",))
def schema_diff_bronze_silver(spark, sf_dir):
    """U4: columns added by Silver over Bronze."""
    return report.schema_diff(bronze_table(spark, sf_dir, CFG), silver_table(spark, sf_dir, CFG))


@register("vif_numeric", ("T7",))
def vif_numeric(spark, sf_dir):
    """Uncentred VIF of the numeric sales columns."""
    cols = ["sqm", "no_rooms", "year_build", "dk_ann_infl_rate%", "yield_on_mortgage_credit_bonds%"]
    return report.vif(bronze_table(spark, sf_dir, CFG), cols)


@register("scaler_roundtrip_holdout", ("E18",), with_ctes(
    f"fit AS (SELECT avg(sqm) AS a1, stddev_pop(sqm) AS b1 FROM bronze WHERE year_sale <= {CFG.split_last_train_year})",
    f"""SELECT house_id, no_rooms, date, purchase_price, (sqm - a1) / CASE WHEN b1 = 0 OR b1 IS NULL THEN 1.0 ELSE b1 END AS sqm_scaled
FROM bronze CROSS JOIN fit WHERE year_sale > {CFG.split_last_train_year}"""))
def scaler_roundtrip_holdout(spark, sf_dir):
    """Scaler statistics fitted on training years, stored, reloaded and applied to later rows."""
    b = bronze_table(spark, sf_dir, CFG)
    stats = X.fit_scaler(b.where(F.col("year_sale") <= CFG.split_last_train_year), ["sqm"], "standard")
    path = _out(spark, "scaler-stats")
    X.save_stats(stats, path)
    new = b.where(F.col("year_sale") > CFG.split_last_train_year)
    return X.apply_scaler(new, X.load_stats(spark, path), ["sqm"], "standard").select(
        "house_id", "no_rooms", "date", "purchase_price", "sqm_scaled")


@register("column_name_repair", ("S5",), with_layers('SELECT region, count(*) AS n, avg("dk_ann_infl_rate%") AS mean_infl FROM bronze GROUP BY region'))
def column_name_repair(spark, sf_dir):
    """A CSV landed with record-set-prefixed, %25-encoded headers and
    byte-literal strings, repaired on read."""
    b = bronze_table(spark, sf_dir, CFG).select(
        F.col("house_id").alias("sales/house_id"), F.concat(F.lit("b'"), F.col("region"), F.lit("'")).alias("sales/region"),
        F.col("dk_ann_infl_rate%").alias("sales/dk_ann_infl_rate%25"))
    path = _out(spark, "landed-csv")
    io.write_csv(b, path)
    back = io.decode_byte_strings(io.repair_column_names(io.read_csv(spark, path)), ["region"])
    return back.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.avg("`dk_ann_infl_rate%`").alias("mean_infl"))
