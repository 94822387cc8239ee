"""Readers for the given tables and the ``sales`` fact view built from them.

tables onto the 19-column sales schema. ``raw_sales`` is that mapping, before
Bronze: strings in their raw case, zip codes unpadded, dates as timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")



def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x orders x customer x nation x region x part -> raw sales rows.

    nation/region are fixed-size (25/5 rows) and broadcast, last, so that their names aren't shuffled; orders get their
    nation before they meet lineitem, which is shuffled by order and by part only. These joins are left to the planner (AQE
    turns them into broadcasts when the runtime size of the dimension allows, sort-merge otherwise)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    oc = o.join(c, o.o_custkey == c.c_custkey)
    j = (
        li.join(p, li.l_partkey == p.p_partkey)
        .join(oc, li.l_orderkey == oc.o_orderkey)
        .join(F.broadcast(geo), oc.c_nationkey == geo.n_nationkey)
    )
    prio = F.col("o_orderpriority")
    return j.select(
        F.col("o_orderdate").alias("date"),
        F.col("l_orderkey").alias("house_id"),
        F.col("p_type").alias("house_type"),
        F.when(prio == "4-NOT SPECIFIED", "-").when(prio == "5-LOW", "Familiehandel").otherwise("Alm. Salg").alias("sales_type"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("area"),
        (F.col("c_custkey") % 1000).cast("string").alias("zip_code"),
        F.col("l_extendedprice").alias("purchase_price"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 2), F.lit(None)).otherwise(F.col("l_quantity")).cast("double").alias("sqm"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("sqm_price"),
        F.col("l_linenumber").cast("long").alias("no_rooms"),
        (F.lit(1950) + F.col("p_size")).cast("long").alias("year_build"),
        (F.lit(100.0) * F.col("l_tax")).alias("dk_ann_infl_rate%"),
        (F.lit(100.0) * F.col("l_discount")).alias("yield_on_mortgage_credit_bonds%"),
        (F.lit(100.0) * (F.col("l_tax") - F.col("l_discount"))).alias("%_change_between_offer_and_purchase"),
    )


# The same mapping for the DuckDB oracle (tables are pre-registered views there).
RAW_SALES_SQL = """
SELECT o.o_orderdate AS date,
       l.l_orderkey AS house_id,
       p.p_type AS house_type,
       CASE o.o_orderpriority WHEN '4-NOT SPECIFIED' THEN '-' WHEN '5-LOW' THEN 'Familiehandel' ELSE 'Alm. Salg' END AS sales_type,
       r.r_name AS region,
       n.n_name AS area,
       CAST(c.c_custkey % 1000 AS VARCHAR) AS zip_code,
       l.l_extendedprice AS purchase_price,
       CAST(CASE WHEN l.l_returnflag = 'R' AND l.l_quantity <= 2 THEN NULL ELSE l.l_quantity END AS DOUBLE) AS sqm,
       l.l_extendedprice / l.l_quantity AS sqm_price,
       CAST(l.l_linenumber AS BIGINT) AS no_rooms,
       CAST(1950 + p.p_size AS BIGINT) AS year_build,
       100.0 * l.l_tax AS "dk_ann_infl_rate%",
       100.0 * l.l_discount AS "yield_on_mortgage_credit_bonds%",
       100.0 * (l.l_tax - l.l_discount) AS "%_change_between_offer_and_purchase"
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey
"""
