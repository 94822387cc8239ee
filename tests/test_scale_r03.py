"""Steps that must not shuffle, sort or compute more than they need."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from hearth.functions.quantile import quantile_table
from hearth.operators import features, models, profile, text
from hearth.plans.registry import QUERIES, load_all
from hearth.sources import io, scratch


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_quantiles_shuffle_only_wanted_buckets(spark):
    d = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 1.5 - 700).alias("x"))
    q = quantile_table(d, ["g"], {"x": [(0.5, "m"), (0.9, "n")]})
    assert "LeftSemi" in _plan(q)
    want = d.groupBy("g").agg(F.percentile("x", 0.5).alias("m"), F.percentile("x", 0.9).alias("n"))
    assert {tuple(round(v, 9) for v in r) for r in q.collect()} == {tuple(round(v, 9) for v in r) for r in want.collect()}


def test_partitioned_layer_is_written_without_a_shuffle(spark):
    path = scratch.new_path(spark)
    io.write_observed(spark.range(0, 40, 1, 4).select("id", (F.col("id") % 2).alias("y")), path, partition_by=("y",))
    back = spark.read.parquet(path)
    assert back.count() == 40 and len(back.inputFiles()) == 8


def test_sample_sorts_only_the_range_of_the_cut(spark, monkeypatch):
    d = spark.range(20000).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 2).alias("s"))
    sorted_rows = []
    rank = io.rank_within_groups
    monkeypatch.setattr(io, "rank_within_groups", lambda df, *a: (sorted_rows.append(df.count()), rank(df, *a))[1])
    got = io.stratified_sample(d, ["s"], 0.1)
    assert sum(sorted_rows) < 1000
    h = d.withColumn("h", F.xxhash64("id", "s", F.lit(42))).collect()
    for s in (None, 0, 1):
        rows = sorted((r.h, r.id) for r in h if r.s == s)
        assert {r.id for r in got.collect() if r.s == s} == {i for _, i in rows[:round(len(rows) * 0.1)]}
    assert io.stratified_sample(d, ["s"], 1.0).count() == 20000
    assert io.stratified_sample(d, ["s"], 0.0).count() == 0


def test_lags_need_no_join_by_position(spark, monkeypatch):
    monkeypatch.setattr(features, "rank_within_groups", None)  # positions aren't asked for
    d = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    out = features.global_lags(d.repartition(7), ["v"], ["k"], (1, 2))
    assert "SortMergeJoin" not in _plan(out)
    for r in out.collect():
        assert (r.v_lag1, r.v_lag2) == (r.v - 2 if r.k > 0 else None, r.v - 4 if r.k > 1 else None)


def test_duplicates_compare_only_rows_with_repeated_hashes(spark, monkeypatch):
    d = spark.createDataFrame([(1, None, 0.0), (1, None, -0.0), (2, "a", 1.0), (3, None, 1.0), (3, None, 1.0), (3, None, 1.0), (4, "b", None)], "a int, b string, c double")
    compared = []
    attach = profile.attach
    monkeypatch.setattr(profile, "attach", lambda *a: (compared.append(attach(*a)), compared[-1])[1])
    r = profile.duplicate_stats(d).first()
    assert (r.n_rows, r.n_distinct, r.n_duplicated, r.n_in_duplicate_groups) == (7, 4, 3, 5)
    assert compared[0].count() == 5


def test_rare_categories_do_not_shuffle_the_rows(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # the measured size decides
    monkeypatch.setattr(features, "attach", lambda *a: (spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"), scratch.attach(*a))[1], raising=True)
    d = spark.range(1000).select(F.concat(F.lit("z"), (F.col("id") % 200).cast("string")).alias("z"))
    out = features.group_rare(d.union(d.limit(0)), "z", 0.5)
    assert "BroadcastHashJoin" in _plan(out) and out.where("z_grouped <> 'Other'").count() == 0


def test_terms_are_counted_inside_each_row(spark):
    rows = [(1, "a aa bb aa bb"), (2, None), (3, "cc"), (3, "cc dd"), (None, "ee"), (None, "ee ff"), (4, ". .")]
    got = {(r.i, r.term): r.tf for r in text.terms(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    assert got == {(1, "aa"): 2, (1, "bb"): 2, (1, "aa bb"): 2, (1, "bb aa"): 1, (3, "cc"): 2, (3, "dd"): 1, (3, "cc dd"): 1,
                   (None, "ee"): 2, (None, "ff"): 1, (None, "ee ff"): 1}
    toks = [["x", "y", "x", "y"], [], ["y"]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9]), pa.array(toks, pa.list_(pa.string()))], names=["_id", "_t"])
    out = Counter()
    for b in text._gram_counts(iter([batch])):
        out.update({(r["_id"], r["term"]): r["tf"] for r in b.to_pylist()})
    assert out == {(7, "x"): 2, (7, "y"): 2, (7, "x y"): 2, (7, "y x"): 1, (9, "y"): 1}


def test_tokens_counted_at_once_are_few():
    toks = [[f"w{(i * j) % 997}" for j in range(2000)] for i in range(1, 301)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(toks, pa.list_(pa.string()))], names=["_id", "_t"])
    parts, rows = list(text._gram_counts(iter([batch]))), Counter()
    assert len(parts) > 3 and max(b.num_rows for b in parts) <= 2 << 17
    for b in parts:
        rows.update(b.column("_id").to_pylist())
    assert rows == {i: len(set(t)) + len(set(zip(t, t[1:]))) for i, t in enumerate(toks)}


def test_totals_are_those_of_the_terms(spark):
    rows = [(1, "a aa bb aa bb"), (2, None), (3, "cc"), (3, "cc aa"), (None, "ee"), (None, "ee bb"), (4, ". ."), (5, "bb cc aa bb")] * 2 + [(6, "aa bb"), (7, "AA bb cc")]
    docs = spark.createDataFrame(rows, "i long, t string").repartition(3)
    terms = text.terms(docs, "i", "t").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total_tf"))
    got = text.term_totals(docs, "i", "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, terms.collect()))
    one = {r.term: (r.df, r.total_tf) for r in text.term_totals(docs.where("i > 5"), "i", "t").collect()}
    assert one == {"aa": (2, 2), "bb": (2, 2), "cc": (1, 1), "aa bb": (2, 2), "bb cc": (1, 1)}


def _topics(spark, n):
    return spark.createDataFrame([(i, " ".join(f"w{(i * m + j) % 23} x{i % 5}" for j, m in enumerate((1, 3, 7, 7, 11)))) for i in range(n)] + [(3, "w1 w2 w1"), (None, "w4 w5"), (900, None)], "doc_id long, text string").repartition(3)


def test_vectors_are_the_weights_of_each_text(spark):
    docs = _topics(spark, 50)
    vocab = scratch.stored(text.fit_vocabulary(text.term_totals(docs, "doc_id", "text"), docs.agg(F.count(F.lit(1)).alias("n")), 60))
    want = {(r.doc_id, r.term): r.w for r in text.weights(text.terms(docs, "doc_id", "text"), vocab, "doc_id").collect()}
    got = {(r.doc_id, r.term): r.w for r in text.text_weights(docs, "doc_id", "text", vocab).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and any(k[0] == 3 for k in got)
    names = [r.term for r in vocab.orderBy(F.desc("df"), "term").collect()]
    rows = text.text_vectors(docs, "doc_id", "text", vocab).collect()
    assert len(rows) == len({r.doc_id for r in rows}) and all(list(r.t) == sorted(r.t) for r in rows)
    assert {(r.doc_id, names[t]) for r in rows for t in r.t} == want.keys()


def test_norms_and_means_of_stored_vectors(spark, tmp_path):
    docs = _topics(spark, 40)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.where("doc_id < 6").selectExpr("doc_id AS item_id", "text").write.parquet(f"{tmp_path}/benchmark.parquet")
    load_all()
    norms = QUERIES["tfidf_doc_norms"](spark, str(tmp_path))
    assert "Exchange" not in _plan(norms)  # one row a document is there already
    rows = {r.doc_id: r for r in norms.collect()}
    want = Counter(r.doc_id for r in text.fit_tfidf(docs)[1].collect())
    assert {i: r.n_terms for i, r in rows.items()} == want and all(abs(r.sum_w2 - 1) < 1e-4 for r in rows.values())
    recs = QUERIES["text_recommendations"](spark, str(tmp_path)).collect()
    mean = {r.item_id: r for r in QUERIES["text_mean_similarity"](spark, str(tmp_path)).collect()}
    assert mean.keys() == {0, 1, 2, 3, 4, 5} and all(r.n_recommendations == 3 for r in mean.values())
    assert all(abs(r.mean_similarity - sum(x.similarity for x in recs if x.item_id == i) / 3) < 2e-6 for i, r in mean.items())
    assert all(any(x.doc_id == i and x.similarity == 1.0 for x in recs if x.item_id == i) for i in (0, 1, 2))


def test_recommendations_of_vectors_equal_those_of_joined_terms(spark, monkeypatch):
    docs = _topics(spark, 90)
    vocab, dw = text.fit_tfidf(docs, max_features=80)
    asked = docs.where("doc_id % 9 = 0 OR doc_id = 900").withColumnRenamed("doc_id", "q")
    dv, qv = (scratch.stored(text.text_vectors(d, i, "text", vocab)) for d, i in ((docs, "doc_id"), (asked, "q")))
    key = lambda r: (r.q, r["rank"], r.doc_id, round(r.similarity, 9))
    want = sorted(map(key, text.recommend(text.text_weights(asked, "q", "text", vocab), dw, "q", "doc_id", 3).collect()))
    assert len(want) == 30
    monkeypatch.setattr(text, "recommend", None)
    for common, scores, products in ((1024, 1 << 18, 1 << 20), (5, 40, 3), (0, 1, 1 << 20)):
        for name, v in (("COMMON", common), ("SCORES", scores), ("_PRODUCTS", products)):
            monkeypatch.setattr(text, name, v)
        rows = [r for b in text._by_queries(qv.withColumnRenamed("q", "id").toArrow(), 3)(iter(dv.withColumnRenamed("doc_id", "id").toArrow().to_batches())) for r in b.to_pylist()]
        got = []
        for q in {r["_q"] for r in rows}:
            best = sorted((-r["similarity"], r["_d"]) for r in rows if r["_q"] == q)[:3]
            got += [(q, i + 1, d, round(-s, 9)) for i, (s, d) in enumerate(best)]
        assert sorted(got) == want
    assert sorted(map(key, text.recommend_vectors(qv, dv, "q", "doc_id", 3).collect())) == want
    monkeypatch.undo()
    monkeypatch.setattr(text, "BROADCAST_BYTES", 0)
    assert sorted(map(key, text.recommend_vectors(qv, dv, "q", "doc_id", 3).collect())) == want


def test_search_for_some_documents_equals_the_search_for_all(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), ((F.col("id") * m + m) % 17).cast("string")) for m in (1, 3, 5, 30)]).alias("text"))
    _, dw = text.fit_tfidf(docs)
    classes = text.text_classes(docs, "doc_id", "text")
    monkeypatch.setattr(text, "SEARCH_DOCS", 7)
    monkeypatch.setattr(text, "BLOCK_DOCS", 4)
    some, _ = text.nearest_documents(dw, classes, "doc_id", 3, docs.where("doc_id % 10 = 0").select("doc_id"))
    monkeypatch.setattr(text, "BLOCK_DOCS", 512)
    every, _ = text.nearest_documents(dw, classes, "doc_id", 3)
    key = lambda r: (r.doc_id, r.rank, r.near_doc_id, round(r.similarity, 9))
    assert sorted(map(key, some.collect())) == sorted(key(r) for r in every.collect() if r.doc_id % 10 == 0)


def test_metrics_apply_the_model_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(models, "stored", lambda df: (kept.append(1), scratch.stored(df))[1])
    m = models.regression_metrics(spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "label double, prediction double")).first()
    assert kept and m.n == 3 and abs(m.mae - 0.5) < 1e-12 and m.medae == 0.5
