"""Files that intermediate tables are written into."""

from pyspark.sql import functions as F


def test_small_tables_are_few_files_whatever_the_partitions(spark, monkeypatch):
    from hearth.llm import graph

    cores, held = spark.sparkContext.defaultParallelism, {}
    conf = {"spark.sql.shuffle.partitions": "97", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        held[k] = spark.conf.get(k)
        spark.conf.set(k, v)
    try:
        links = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 3).alias("b"))
        found = graph.connected_components(links)
        assert len(found.inputFiles()) <= max(cores, 1)
        assert {(r.id, r.component) for r in found.collect()} == {(i, i - i % 3) for i in range(3000)}

        monkeypatch.setattr(graph, "FILE_ROWS", 50)  # files grow with the rows, and no row is lost
        many = graph.cut(spark.range(3000).repartition("id"), 3000)
        assert max(cores, 1) <= len(many.inputFiles()) <= max(cores, 60) and many.agg(F.sum("id")).first()[0] == 3000 * 2999 // 2
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
