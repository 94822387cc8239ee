"""Connected components of a link table, and small shared helpers."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import ensure_checkpoint_dir

FILE_ROWS = 1 << 15


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared checkpoint folder and go on from there.

    Columnar and compressed in row groups of 16 MB, so it takes a fraction of a row checkpoint and little memory. The
    tables of an application share one folder, which goes when Python exits. ``rows`` is about how many rows there are
    at most: neighbouring partitions then go into one file until there is one for ``FILE_ROWS`` rows or for each core,
    whichever are more.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hearth-llm/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ROOTS: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is None:  # the session has ended; its folder is the cluster's to clean
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, rows: int | None = None) -> DataFrame:
    """``(id, component)`` for every id in ``links``; the component is its smallest id.

    Alternating large-star and small-star rounds: each round is two grouped
    minima and two joins over the links, which only get fewer. The frame is
    written every round and stays distributed; the driver sees one
    fingerprint of the round. Links with a null end and self links are ignored
    (a self link still names its id). ``rows`` is the number of links, if known.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    edges = cut(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    last, rows = None, edges.count()
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), rows)
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == last:
            break
        last, rows = mark, mark[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return ids.join(edges.select(F.col("u").alias("id"), "v"), "id", "left").select(
        "id", F.coalesce("v", "id").alias("component"))


HOT_SHARE = 1000
BROADCAST_BYTES = 32 << 20


def fitting(small: DataFrame, row_bytes: int = 32, size: Column | None = None) -> DataFrame:
    """``small`` (a written table), marked for broadcast if its rows take ``BROADCAST_BYTES`` at most.

    Its size is its rows times ``row_bytes``, or the sum of ``size`` over them.
    Beyond the bound it comes back as it is and Spark shuffles the join.
    """
    held = small.count() * row_bytes if size is None else small.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(small) if held <= BROADCAST_BYTES else small


def spread_join(rows: DataFrame, groups: DataFrame, key: str, hot: Column) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (a written table, one narrow row a key) that no frequent key holds up.

    Groups that fit are broadcast. Otherwise ``hot`` marks those of one
    ``HOT_SHARE``-th of all rows or more: there are ``HOT_SHARE`` of them at
    most, whatever the input, so they are broadcast and only the rows of the
    other keys are shuffled.
    """
    if groups.count() * 64 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(groups), key, "left")
    few = groups.where(hot)
    at_once = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return at_once.unionByName(rest.join(groups.where(~hot), key, "left").select(at_once.columns))
