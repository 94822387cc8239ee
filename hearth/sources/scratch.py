"""Intermediate tables in the cluster's shared checkpoint folder, and joins that broadcast by measured size.

The tables of an application lie in one folder that goes when Python exits.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hearth.session import ensure_checkpoint_dir

#: A side of a join is broadcast up to this many bytes of its values.
BROADCAST_BYTES = 32 << 20
_ROW_BYTES = 24
_ROOTS: set[str] = set()
_FIXED = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def new_path(spark: SparkSession) -> str:
    """A path of its own in the application's scratch folder."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hearth-scratch/{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(remove, spark, root)
    return f"{root}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the cluster's file system; nothing happens once the session has ended."""
    if spark.sparkContext._jsc is None:
        return
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet and read back."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_bytes(df: DataFrame) -> Column:
    """Bytes that a row's values take (text and binary by their length, nested ones by their JSON)."""
    total = F.lit(_ROW_BYTES)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in _FIXED:
            total = total + _FIXED[kind]
        elif kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith("decimal"):
            total = total + 16
        else:
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return total.cast("long")


def stored_with_size(df: DataFrame) -> tuple[DataFrame, int, int]:
    """``df`` written once, its rows and its values' bytes, both counted while it is written."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(value_bytes(df)).alias("bytes")))
    return out, seen.get["rows"], seen.get["bytes"] or 0


def attach(big: DataFrame, small: DataFrame, on: str | Sequence[str], how: str = "left", limit: int = BROADCAST_BYTES) -> DataFrame:
    """``big`` joined to ``small``, which is written and measured first.

    Up to ``limit`` bytes it is broadcast and ``big`` isn't shuffled; beyond, Spark shuffles both and
    splits skewed keys at run time.
    """
    table, _, size = stored_with_size(small)
    return big.join(F.broadcast(table) if size <= limit else table, on, how)
