"""The row-count invariant, observed writes, measured joins, and the driver contract without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sales(spark, n=40):
    return spark.range(n).select(F.col("id").alias("house_id"), F.format_string("%04d", F.col("id") % 7).alias("zip_code"), (2000 + F.col("id") % 3).cast("int").alias("year_sale"))


def test_silver_write_fails_on_a_repeated_zip(spark, tmp_path):
    from hearth.operators.silver import join_postal_centroids, one_centroid_per_zip
    from hearth.sources import io

    cent = spark.createDataFrame([("0001", 55.0, 9.0, "b"), ("0001", 56.0, 9.5, "a"), ("0002", 57.0, 10.0, None), (None, 1.0, 1.0, "x")],
                                 "zip_code string, lat double, lon double, municipality_name string")
    good, bad = f"{tmp_path}/good", f"{tmp_path}/bad"
    metrics = {"matched": F.count_if(F.col("geo_join_status") == "matched"), "years": F.max("year_sale")}
    got = io.write_observed(join_postal_centroids(sales(spark), one_centroid_per_zip(cent)), good, metrics, 40, ("year_sale",))
    assert got == {"rows": 40, "matched": 12, "years": 2002}
    back = spark.read.parquet(good)
    assert back.count() == 40 and {(r.zip_code, r.lat) for r in back.where("lat IS NOT NULL").collect()} == {("0001", 56.0), ("0002", 57.0)}
    with pytest.raises(io.RowCountError):
        io.write_observed(join_postal_centroids(sales(spark), cent), bad, metrics, 40)
    assert not os.path.exists(bad)
    assert io.write_observed(sales(spark).limit(0), bad, None, 0) == {"rows": 0}


def test_manifests_that_disagree_raise(spark, tmp_path):
    from hearth.sources import io

    for layer, rows in (("bronze", 5), ("silver", 4), ("gold", 3)):
        io.write_manifest(io.manifest(sales(spark), layer, "x", rows, figures={"n": 1.5}, caveats=["c"]), f"{tmp_path}/{layer}")
    paths = [f"{tmp_path}/{x}" for x in ("bronze", "silver", "gold")]
    r = io.validate_manifests(spark, *paths).first()
    assert (r.all_present, r.bronze_rows, r.silver_rows, r.rows_match) == (True, 5, 4, False)
    with pytest.raises(io.RowCountError):
        io.validate_manifests(spark, *paths, strict=True)
    with pytest.raises(FileNotFoundError):
        io.validate_manifests(spark, paths[0], paths[1], f"{tmp_path}/none", strict=True)


def test_joins_broadcast_by_measured_size(spark):
    from hearth.sources.scratch import attach, stored_with_size

    small = spark.range(5).select(F.format_string("%04d", F.col("id")).alias("zip_code"), F.lit("é" * 10).alias("name"))
    _, rows, size = stored_with_size(small)
    assert rows == 5 and size == 5 * (24 + 4 + 20)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    held, not_held = attach(sales(spark), small, "zip_code", limit=size), attach(sales(spark), small, "zip_code", limit=size - 1)
    assert "BroadcastHashJoin" in plan(held) and sorted(map(tuple, held.collect())) == sorted(map(tuple, not_held.collect()))
    hinted = [d._jdf.queryExecution().analyzed().toString().count("ResolvedHint (strategy=broadcast)") for d in (held, not_held)]
    assert hinted == [1, 0]
    assert attach(sales(spark), small.limit(0), "zip_code").where("name IS NOT NULL").count() == 0


def test_extracts_of_some_tables(spark, tmp_path):
    from hearth.sources import io

    tables = {"a": sales(spark), "b": sales(spark).limit(3)}
    assert {k: v["rows"] for k, v in io.write_extracts(tables, str(tmp_path), ["b"]).items()} == {"b": 3}
    with pytest.raises(KeyError):
        io.write_extracts(tables, str(tmp_path), ["c"])


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_library_loads_without_the_optional_subpackage(tmp_path, pipeline_stays):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if pipeline_stays else ["corpus_pipeline.py"])))
    code = "import __spark_entry__ as E; q, o = E.queries(), E.oracle_sql(); assert len(q) > 100 and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=os.environ | {"PYTHONPATH": str(copy)})
