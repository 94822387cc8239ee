"""Fitted feature steps: stored state read in another session, unseen categories, missing values."""

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

SCHEMA = "id int, kind string, place string, size double, price double"


def rows():
    return [(i, "abc"[i % 3], "xy"[i % 2] if i < 38 else "rare", float(i) if i % 5 else None, 100.0 + 3 * i) for i in range(40)]


def fitted(spark):
    from hearth.operators import fitted as S

    d = spark.createDataFrame(rows(), SCHEMA)
    steps = [S.MedianImputer(cols=["size"]), S.SizeCategories(cols=["size", "price"]), S.RareCategories(cols=["place"], threshold=0.06),
             S.TargetEncoder(cols=["kind", "id"], target="price", smoothing=5.0), S.RegionEncoder(cols=["place"], target="price", minSamples=10),
             S.OneHot(cols=["kind", "price"]), S.Scaler(cols=["size"], kind="standard"), S.Scaler(cols=["price"], kind="minmax")]
    return d, Pipeline(stages=steps).fit(d)


def test_state_read_in_another_session_gives_the_same_rows(spark, tmp_path):
    d, model = fitted(spark)
    path = str(tmp_path / "steps")
    model.write().save(path)
    other = spark.newSession()
    again = PipelineModel.load(path)
    assert [type(a) is type(b) and a.uid == b.uid for a, b in zip(model.stages, again.stages)] == [True] * 8
    new = [(99, "c", "x", 7.0, 120.0), (98, "unseen", None, math.nan, 500.0), (97, None, "rare", -math.inf, 90.0)]
    here = sorted(map(tuple, model.transform(spark.createDataFrame(new, SCHEMA)).collect()), key=repr)
    there = again.transform(other.createDataFrame(new, SCHEMA))
    assert sorted(map(tuple, there.collect()), key=repr) == here
    assert "price_a" not in there.columns and "kind_b" in there.columns and "kind_a" not in there.columns


def test_values(spark):
    d, model = fitted(spark)
    out = {r.id: r for r in model.transform(spark.createDataFrame([(1, "a", "x", None, 100.0), (2, "zz", "rare", 1.0, 217.0), (3, None, None, math.inf, 158.5)], SCHEMA)).collect()}
    price = [r[4] for r in rows()]
    mean = sum(price) / 40
    of = lambda i, v: [r[4] for r in rows() if r[i] == v]
    assert out[1].size == 20.0 and out[3].size == 20.0  # the median of the sizes that are there
    assert abs(out[1].kind_target_encoded - (sum(of(1, "a")) + 5 * mean) / (len(of(1, "a")) + 5)) < 1e-9
    assert abs(out[2].kind_target_encoded - mean) < 1e-9 and out[3].place_target_encoded is None
    assert (out[1].place_grouped, out[2].place_grouped, out[3].place_grouped) == ("x", "Other", None)
    assert out[2].place_frequency == len(of(2, "rare"))
    assert (out[1].place_frequency, out[3].place_frequency) == (19, None)
    assert (out[1].price_minmax, out[2].price_minmax, out[3].price_minmax) == (0.0, 1.0, 0.5)
    assert (out[1].kind_b, out[1].kind_c, out[2].kind_b, out[3].kind_c) == (0, 0, 0, 0)


def test_applying_a_step_does_not_shuffle_the_rows(spark):
    d, model = fitted(spark)
    plan = model.transform(d.repartition(3).select(*d.columns))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 0


def test_empty_fit_and_empty_rows(spark):
    from hearth.operators import fitted as S

    none = spark.createDataFrame([], SCHEMA)
    d = spark.createDataFrame(rows(), SCHEMA)
    for step in (S.TargetEncoder(cols=["kind"], target="price"), S.RareCategories(cols=["kind"]), S.OneHot(cols=["kind"]), S.RegionEncoder(cols=["place"], target="price")):
        assert step.fit(d).transform(none).collect() == []
        assert step.fit(none).transform(d).count() == 40
    enc = S.TargetEncoder(cols=["kind"], target="price").fit(none).transform(d)
    assert enc.where(F.col("kind_target_encoded").isNotNull()).count() == 0
