"""Groups of one row, one group, one class, constant labels: defined results instead of errors."""

import math

import pytest

from hearth.functions.dist import f_sf, t_two_sided, t_two_sided_quantile
from hearth.operators.describe import anova_oneway, price_stats
from hearth.operators.models import auc_mann_whitney, leak_test, regression_metrics
from hearth.operators.profile import correlation_gate
from hearth.operators.report import recommendations


def test_interval_of_a_group_with_one_sale_is_null(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 3.0), ("c", None)], "region string, purchase_price double")
    got = {r.region: r for r in price_stats(df).collect()}
    assert got["a"].ci_lower is None and got["a"].ci_upper is None and got["a"].mean == 5.0
    assert got["b"].ci_upper == round(2 + t_two_sided_quantile(0.05, 1) * math.sqrt(2) / math.sqrt(2))
    assert got["c"].transactions == 0 and got["c"].ci_lower is None


def test_anova_of_one_group_or_none(spark):
    one = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double")
    assert anova_oneway(one, "g", "v").first().f_stat is None
    assert anova_oneway(one.where("false"), "g", "v").first().f_stat is None


def test_metrics_of_one_class_and_of_a_constant_label(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "y int, s double")
    assert auc_mann_whitney(df, "y", "s").first().auc is None
    mixed = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert auc_mann_whitney(mixed, "y", "s").first().auc == pytest.approx(0.875)
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "label double, prediction double")
    r = regression_metrics(flat).first()
    assert r.r2 is None and r.rmse == 1.0 and r.medae == 1.0


def test_t_and_f_tails():
    assert t_two_sided_quantile(0.05, 1) == pytest.approx(math.tan(math.pi * 0.475), rel=1e-10)
    assert t_two_sided_quantile(0.05, 2) == pytest.approx(0.95 / math.sqrt(2 * 0.975 * 0.025), rel=1e-10)
    assert t_two_sided(1.0, 1) == pytest.approx(0.5) and t_two_sided(3.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(3))
    assert f_sf(2.0, 2, 2) == pytest.approx(1 / 3) and f_sf(3.0, 2, 10) == pytest.approx((1 + 3 * 2 / 10) ** -5)
    assert f_sf(500.0, 2, 100) == pytest.approx(11.0 ** -50, rel=1e-9) and math.isnan(t_two_sided(1.0, 0))


def test_leak_test_reads_every_row(spark):
    df = spark.range(0, 60_000).selectExpr("cast(id as double) x", "cast(id % 7 as double) z", "2.0 * id + 1 as y")
    r = leak_test(df, ["x", "z"], "y").first()
    assert r.leak_detected and 11_000 < r.n < 13_000


def test_correlation_gate_names_every_feature(spark):
    df = spark.range(0, 50).selectExpr("cast(id as double) y", "id * 2 as same", "id % 3 as other", "1 as flat")
    got = {r.feature: r.too_correlated for r in correlation_gate(df, ["same", "other", "flat"], "y").collect()}
    assert got == {"same": True, "other": False, "flat": False}


def test_scaling_is_advised_when_ranges_differ_across_columns(spark):
    cat = spark.createDataFrame([], "column_name string, n_unique long")
    nulls = spark.createDataFrame([], "column_name string, null_pct double")
    schema = "column_name string, min double, max double, skewness double, n_outliers long, count long, n_missing long"
    wide = spark.createDataFrame([("a", 0.0, 1.0, 0.0, 0, 10, 0), ("b", 0.0, 500.0, 0.0, 0, 10, 0)], schema)
    near = spark.createDataFrame([("a", 1.0, 400.0, 0.0, 0, 10, 0), ("b", 0.0, 500.0, 0.0, 0, 10, 0)], schema)
    assert [r.kind for r in recommendations(wide, cat, nulls).collect()] == ["scale_different_ranges"]
    assert recommendations(near, cat, nulls).collect() == [] and recommendations(wide.limit(1), cat, nulls).collect() == []


def test_title_case_takes_plain_text_whole_and_cuts_the_rest_into_runs(spark):
    from pyspark.sql import functions as F

    from hearth.functions.scalar import title_case

    texts = [None, "", " ", "-", "alm. salg", " MIDDLE  EAST ", "o'neill x-ray", "a.b", "\tab c\n", "3rd floor", "ÅRHUS ø", "end. ", "a, b. c"]
    out = spark.createDataFrame([(t,) for t in texts], "s string").select("s", title_case("s").alias("t"))
    assert [(r.s, r.t) for r in out.collect()] == [(t, None if t is None else t.strip(" ").title()) for t in texts]
    assert "initcap" in out._jdf.queryExecution().optimizedPlan().toString().lower()
