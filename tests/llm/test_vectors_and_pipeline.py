"""Embedding near-duplicates and the corpus pipeline against brute force; every query of the subpackage is registered."""

import math
import zlib

import brute
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def vectors():
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 8))
    rows = [(i, (base[i % 20] + r.normal(size=8) * 0.05 * (i % 4)).tolist(), i % 2) for i in range(160)]
    rows += [(200 + i, base[0].tolist(), 0) for i in range(40)]  # copies
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [math.nan] + [1.0] * 7, 0), (303, [None] + [1.0] * 7, 0), (304, [math.inf] + [1.0] * 7, 0),
             (305, base[0].tolist(), None), (306, base[0][:4].tolist(), 0), (307, (base[0][:4] * 3).tolist(), 0), (308, [], 0), (309, (base[0] * 1e-9).tolist(), 0),
             (None, base[0].tolist(), 0), (200, base[0].tolist(), 0)]
    return rows


def brute_vectors(rows, threshold=0.98):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]

    def near(i, j):
        (_, a, p), (_, b, q) = rows[i], rows[j]
        return ok[i] and ok[j] and p == q and len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold

    links = [(i, j) for i in range(len(rows)) for j in range(i) if near(i, j)]
    n = np.bincount([x for link in links for x in link], minlength=len(rows))
    comp = brute.lowest([r[0] for r in rows], brute.roots(len(rows), links))
    return [(r[0], int(k), c) for r, k, c in zip(rows, n, comp)]


def test_embedding_near_duplicates(spark, monkeypatch):
    from hearth.llm import embedding_dedup as E

    schema = "vec_id bigint, embedding array<double>, label int, cid string, cell string"
    d = spark.createDataFrame([(*r, "x", "y") for r in vectors()], schema).repartition(3)
    want = sorted(brute_vectors(vectors()), key=repr)
    out = E.embedding_near_duplicates(d)
    assert sorted((tuple(r) for r in out.drop("kept").collect()), key=repr) == want
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in out.collect())
    monkeypatch.setattr(E, "MEMBERS", 4)
    monkeypatch.setattr(E, "VISITORS", 8)
    monkeypatch.setattr(E, "_fit", lambda classes, total: {8: E.spherical_kmeans(E._unit(np.random.default_rng(1).normal(size=(99, 8))), 12)})
    assert sorted((tuple(r) for r in E.embedding_near_duplicates(d).drop("kept").collect()), key=repr) == want
    assert E.embedding_near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_components(spark):
    from hearth.llm.graph import connected_components

    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (7, 7), (None, 3), (200, 200)]
    out = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a int, b int")).collect()}
    assert out == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100, 200: 200}


def brute_pipeline(rows):
    """[(id, text, lang, source)] -> sorted [(id, text)] before the last stage."""
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    found = brute.languages([(r[1], r[2]) for r in rows if not held(r[0])], [r[1] for r in rows])
    rows = [r for r, f in zip(rows, found) if f[0] != "und"]
    keep = {w[1] for w in brute.exact([r[:2] for r in rows])}
    rows = [r for r in rows if r[0] in keep]
    first = {i for i, _, c in brute.ngram_components([r[:2] for r in rows]) if i == c}
    rows = [r for r in rows if r[0] in first]
    out = []
    for r, (_, size, _, _, taken) in zip(rows, brute.mix([(r[0], r[1], r[3]) for r in rows])):
        out += [(r[0], r[1])] * (taken // size) + ([(r[0], " ".join(brute.words(r[1])[:taken % size]))] if taken % size else [])
    return sorted(out)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in d.select("doc_id", "text", "lang", "source").collect()]
    out = corpus_pipeline.run(spark, SF).collect()
    want = brute_pipeline(rows)
    assert all(r.round_trip for r in out) and sorted(r.doc_id for r in out) == [w[0] for w in want]

    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = sorted((r.doc_id, lib.decode(np.frombuffer(r.ids, "<u4").tolist())) for r in out)
    assert ids == want


def test_stages_on_empty_and_odd_input(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    some = spark.createDataFrame([(1, None, None, None, None), (2, "abc def", "en", None, 7), (2, "abc def", "en", None, 7), (None, "abc xyz", None, "s", 7), (3, "", "en", "s", 0)], schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), SF).collect() == []
        out = stage(spark, some, SF)
        assert name == "byte_bpe" or out.columns == some.columns
        assert out.count() > 0


def test_registration():
    import __spark_entry__ as entry

    from hearth.llm.queries import ORACLE, QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_near_duplicates_with_null_and_shared_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    say = lambda w, n: " ".join(f"{w}{k}" for k in range(n))
    near = lambda w: [say(w, 60), say(w, 60) + " x", say(w, 60) + " y"]
    rows = [(None, t) for t in near("a")] + [(7, t) for t in near("b")] + [(9, near("c")[0]), (None, near("c")[1]), (3, near("c")[2])] + [(None, None), (11, "alone here")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.ngram_join(spark, docs, SF).collect()]
    assert sorted(i for i, _ in out if i is not None) == [3, 7, 11]
    assert sorted(t is None for i, t in out if i is None) == [False, True] and [t for i, t in out if i is None and t][0] in near("a")


def test_language_stage_without_any_language_keeps_documents(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(k, f"some words {k}", None, "s", 9) for k in range(12)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert corpus_pipeline.language_id(spark, docs, SF).count() == 12
