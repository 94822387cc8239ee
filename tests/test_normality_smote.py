"""Shapiro-Wilk on published samples, exact nearest rows and SMOTE against brute force, ROC and class report, the feature gate."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

# Published sample: weights of eleven men, W = 0.79 (Shapiro and Wilk 1965).
MEN = (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)


def test_shapiro_wilk_of_published_samples(spark):
    from hearth.operators import normality as N

    r = random.Random(1)
    rows = [(float(v), None) for v in MEN] + [(None, r.gauss(0, 1)) for _ in range(400)] + [(math.nan, None)]
    d = spark.createDataFrame(rows, "men double, bell double").repartition(3)
    out = {x.column_name: x for x in N.shapiro_wilk_p(N.shapiro_wilk(d, ["men", "bell"])).collect()}
    assert out["men"].n == 11 and abs(out["men"].w_stat - 0.79) < 0.005 and out["men"].p_value < 0.01 and not out["men"].is_normal
    assert out["bell"].n == 400 and out["bell"].w_stat > 0.99 and out["bell"].is_normal


def test_shapiro_wilk_of_few_and_equal_values(spark):
    from hearth.operators import normality as N

    d = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 2.0), (4.0, 5.0, None)], "a double, b double, c double")
    out = {x.column_name: x.w_stat for x in N.shapiro_wilk(d, ["a", "b", "c"]).collect()}
    assert abs(out["a"] - (math.sqrt(0.5) * 3) ** 2 / (14 / 3)) < 1e-12 and out["b"] is None and out["c"] is None
    q = spark.range(1).select(*[N.normal_quantile(F.lit(p)).alias(f"q{i}") for i, p in enumerate((0.975, 0.5, 1e-3, 1e-12, 0.9))]).first()
    assert np.allclose(q, [1.959963984540054, 0.0, -3.090232306167813, -7.034483825301131, 1.2815515655446004], atol=1e-12)


def points(n=300):
    r = random.Random(3)
    rows = [(i, "ab"[i % 4 == 0], float(r.randint(0, 900)), float(r.randint(0, 12))) for i in range(n)]
    rows += [(1000 + i, "a", 17.0, 3.0) for i in range(40)] + [(2000, "c", 1.0, 1.0), (2001, None, 1.0, 1.0), (2002, "a", None, 1.0)]
    return rows


@pytest.mark.parametrize("slab", [512, 16])
def test_nearest_rows_and_smote(spark, monkeypatch, slab):
    from hearth.operators import models as ML
    from hearth.operators import neighbours as N

    monkeypatch.setattr(N, "SLAB", slab)
    rows = [p for p in points() if p[1] and p[2] is not None]
    d = spark.createDataFrame(points(), "id long, label string, x double, y double").repartition(3)
    near = {r.id: [(v["d"], v["id"]) for v in r.near] for r in N.nearest_rows(d, "id", ["x", "y"], "label", 5).collect()}
    want = {i: sorted(((x - a) ** 2 + (y - b) ** 2, j) for j, m, a, b in rows if m == lab and j != i)[:5] for i, lab, x, y in rows}
    assert near == want
    of = {i: (x, y) for i, _, x, y in rows}
    made = ML.smote(d, "id", ["x", "y"], "label", 5).collect()
    count = {lab: sum(r.label == lab for r in made) for lab in "abc"}
    assert count["a"] == count["b"] and count["c"] == 1  # one row alone has no neighbour
    for r in made:
        if r.gap is not None:
            assert 0 <= r.gap < 1 and r.neighbour_id in [j for _, j in want[r.base_id]]
            assert all(abs(v - (a + (b - a) * r.gap)) < 1e-9 for v, a, b in zip((r.x, r.y), of[r.base_id], of[r.neighbour_id]))
    assert sorted(map(tuple, ML.smote(d.repartition(5), "id", ["x", "y"], "label", 5).collect()), key=repr) == sorted(map(tuple, made), key=repr)
    assert ML.smote(d.limit(0), "id", ["x", "y"], "label", 5).collect() == []


def test_roc_and_class_report(spark):
    from hearth.operators import models as ML

    rows = [(1, 0.9, 1), (0, 0.9, 1), (1, 0.5, 0), (0, 0.1, 0), (1, 0.7, 1)]
    d = spark.createDataFrame(rows, "y int, score double, prediction int")
    assert sorted(tuple(r) for r in ML.roc_points(d, "y").collect()) == [(0.1, 1.0, 1.0), (0.5, 1.0, 0.5), (0.7, 2 / 3, 0.5), (0.9, 1 / 3, 0.5)]
    rep = {r["class"]: tuple(r)[1:] for r in ML.classification_report(d, "y").collect()}
    assert rep["1"] == (2 / 3, 2 / 3, 2 / 3, 3) and rep["0"] == (0.5, 0.5, 0.5, 2)
    assert np.allclose(rep["macro avg"], (7 / 12, 7 / 12, 7 / 12, 5)) and np.allclose(rep["weighted avg"], (0.6, 0.6, 0.6, 5))


def test_feature_gate_raises(spark):
    from hearth.operators import profile as P

    d = spark.range(50).select(F.col("id").cast("double").alias("y"), (F.col("id") * 2.0).alias("same"), (F.col("id") % 3).cast("double").alias("free"))
    P.check_features(d, ["free"], "y", 0.9, required=["free"], forbidden=["same"])
    for features, required, forbidden in ((["free"], ["gone"], []), (["free"], [], ["free"]), (["free", "same"], [], [])):
        with pytest.raises(P.GateError):
            P.check_features(d, features, "y", 0.9, required, forbidden)
    assert [tuple(r)[:2] for r in P.high_correlation_pairs(d, ["y", "same", "free"]).collect()] == [("y", "same")]
