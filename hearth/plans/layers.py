"""Medallion layers as written tables.

Bronze and Silver are written once per (application, input, parameters) as
Parquet under the shared checkpoint folder (``spark.checkpoint.dir``) and read
back: every downstream KPI then starts from a pruned, pushed-down scan instead
of re-running the joins and the flag statistics, and lost executors never
force a recomputation of the whole lineage. Silver is partitioned by
``year_sale`` so year filters prune files.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.config import DRIVER_CONFIG, EngineConfig
from hearth.operators import gold
from hearth.operators.bronze import bronze
from hearth.operators.silver import FLAGS, silver
from hearth.session import ensure_checkpoint_dir
from hearth.sources.io import write_observed
from hearth.sources.tables import raw_sales

_WRITTEN: dict[str, dict] = {}


def _root(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + "/hearth-layers"


def _slug(sf_dir: str) -> str:
    """A folder name for an input."""
    return hashlib.sha1(sf_dir.encode()).hexdigest()[:8]


def _path(spark: SparkSession, name: str, *parts) -> str:
    key = hashlib.sha1(repr((spark.sparkContext.applicationId, name, *parts)).encode()).hexdigest()[:16]
    return f"{_root(spark)}/{name}-{key}"


def materialize(spark: SparkSession, name: str, build, key_parts: tuple, partition_by: tuple[str, ...] = (), metrics=None, expected_rows: int | None = None) -> DataFrame:
    """The table ``build()`` gives, written on first use (see ``write_observed`` for the last two)."""
    path = _path(spark, name, *key_parts)
    if path not in _WRITTEN:
        _WRITTEN[path] = write_observed(build(), path, metrics, expected_rows, partition_by)
    return spark.read.parquet(path)


def bronze_table(spark: SparkSession, sf_dir: str, cfg: EngineConfig = DRIVER_CONFIG) -> DataFrame:
    return materialize(spark, "bronze", lambda: bronze(raw_sales(spark, sf_dir), source_file="sales"), (sf_dir,), ("year_sale",))


def silver_table(spark: SparkSession, sf_dir: str, cfg: EngineConfig = DRIVER_CONFIG) -> DataFrame:
    """Silver; writing it fails unless it has exactly the rows of Bronze. The flags are counted on the way."""
    b = bronze_table(spark, sf_dir, cfg)
    rows = figures(spark, "bronze", sf_dir)["rows"]
    flags = {f: F.sum(F.col(f).cast("long")) for f in FLAGS}
    return materialize(spark, "silver", lambda: silver(b, cfg), (sf_dir, repr(cfg)), ("year_sale",), flags, rows)


def figures(spark: SparkSession, name: str, *key_parts) -> dict:
    """What the write of a layer counted."""
    return _WRITTEN[_path(spark, name, *key_parts)]


def price_index_table(spark: SparkSession, sf_dir: str, cfg: EngineConfig = DRIVER_CONFIG) -> DataFrame:
    """KPI 1, which KPI 3 and 4 start from."""
    return materialize(spark, "price-index", lambda: gold.price_index(silver_table(spark, sf_dir, cfg), cfg), (sf_dir, repr(cfg)))
