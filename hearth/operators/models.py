"""Models and evaluation with ``pyspark.ml``.

Training is Spark ML (distributed tree / linear learners on assembled
vectors); every metric is a plain aggregation over the prediction table, so it
scales with the rows and has an SQL form given the predictions. Hyper-parameter
search takes seeded trials from the reference's space (``search.py``) and scores
each by mean RMSE over the walk-forward folds.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.functions.quantile import group_quantiles, rank_within_groups, running_sum
from hearth.functions.stats import safe_corr
from hearth.operators.neighbours import mutual_information, nearest_rows
from hearth.operators.search import Space, search, suggest
from hearth.sources.scratch import attach, new_path, stored

# --- fixed values (reference search space and guards) -----------------------
SEARCH_SPACE = {
    "ntrees": (100, 600), "max_depth": (3, 12), "learn_rate": (0.005, 0.3),
    "sample_rate": (0.5, 1.0), "col_sample_rate": (0.5, 1.0), "min_rows": (1, 10),
}
LEAK_R2_LIMIT = 0.95
SUSPECT_FEATURES = ("region_price_mean", "region_frequency")
# -----------------------------------------------------------------------------


def _c(n: str) -> Column:
    return F.col(f"`{n}`")


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def impute_with_train_medians(train: DataFrame, other: DataFrame, cols: Sequence[str], mode: str = "exact"):
    """Medians of the training rows (NaN / inf as missing, 0 when none) filled into both frames."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), _c(c).cast("double").alias("v")) for c in cols])).alias("_kv"))
    long = long.select("_kv.k", F.when(~F.isnan("_kv.v") & (F.abs("_kv.v") != float("inf")), F.col("_kv.v")).alias("v"))
    med = group_quantiles(long, ["k"], "v", [0.5], ["m"], mode)
    row = med.groupBy().pivot("k", list(cols)).agg(F.first("m"))

    def fill(df):
        j = df.crossJoin(F.broadcast(row.select(*[_c(c).alias(f"{c}__m") for c in cols])))
        clean = {c: F.when(~F.isnan(_c(c).cast("double")) & (F.abs(_c(c).cast("double")) != float("inf")), _c(c).cast("double")) for c in cols}
        j = j.withColumns({c: F.coalesce(clean[c], _c(f"{c}__m"), F.lit(0.0)) for c in cols})
        return j.drop(*[f"{c}__m" for c in cols])

    return fill(train), fill(other)


def gbt_from_reference_params(p: dict, label: str, seed: int = 42) -> GBTRegressor:
    """Map the reference's boosting parameters onto Spark's GBT (reg_lambda /
    reg_alpha have no counterpart and are not used)."""
    return GBTRegressor(labelCol=label, featuresCol="features", maxIter=int(p["ntrees"]), maxDepth=int(p["max_depth"]),
                        stepSize=float(p["learn_rate"]), subsamplingRate=float(p["sample_rate"]),
                        featureSubsetStrategy=str(round(float(p["col_sample_rate"]), 4)),
                        minInstancesPerNode=int(p["min_rows"]), seed=seed)


#: The reference's search space as ranges of the sampler (learning rate on a log scale).
SPACE = Space({n: (*r, {"learn_rate": "log"}.get(n, "int" if n in ("ntrees", "max_depth", "min_rows") else "float")) for n, r in SEARCH_SPACE.items()})


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction", mode: str = "exact") -> DataFrame:
    """M3/M4 (one row): r2, rmse, mae, mape (%), medae, n, plus rmse / mae after expm1."""
    y, p = _c(label), _c(prediction)
    d = stored(pred.select(y.cast("double").alias("y"), p.cast("double").alias("p")))  # the model is applied once, not once a figure
    m = d.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("_ym"),
              F.sum((F.col("y") - F.col("p")) ** 2).alias("_sse"),
              F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
              F.avg(F.abs(F.try_divide(F.col("y") - F.col("p"), F.col("y")))).alias("_mape"),
              F.sqrt(F.avg((F.expm1("y") - F.expm1("p")) ** 2)).alias("rmse_expm1"),
              F.avg(F.abs(F.expm1("y") - F.expm1("p"))).alias("mae_expm1"))
    sst = d.crossJoin(F.broadcast(m.select("_ym"))).agg(F.sum((F.col("y") - F.col("_ym")) ** 2).alias("_sst"))
    med = group_quantiles(d.select(F.abs(F.col("y") - F.col("p")).alias("ae")), [], "ae", [0.5], ["medae"], mode)
    j = m.crossJoin(sst).crossJoin(med)
    return j.select("n", (1 - F.try_divide("_sse", "_sst")).alias("r2"), F.sqrt(F.try_divide("_sse", "n")).alias("rmse"),
                    "mae", (F.col("_mape") * 100.0).alias("mape"), "medae", "rmse_expm1", "mae_expm1")


def walk_forward_search(df: DataFrame, folds: DataFrame, features: Sequence[str], label: str, path: str, n_trials: int = 1,
                        seed: int = 42, year_col: str = "year", mode: str = "exact") -> DataFrame:
    """M2: each trial is fitted on a fold's training years (medians imputed from them) and scored by RMSE on the
    validation year; trials come from the Parzen sampler and are kept in the table at ``path`` (see ``search``)."""
    fold_list = {f.fold_id: f for f in folds.orderBy("fold_id").collect()}  # a handful of (train_end, val_year) rows

    def score(params: dict, fold: int) -> float:
        f = fold_list[fold]
        tr, va = impute_with_train_medians(df.where(_c(year_col) <= f.train_end), df.where(_c(year_col) == f.val_year), features, mode)
        model = gbt_from_reference_params(params, label).fit(assemble(tr, features))
        return model.transform(assemble(va, features)).agg(F.sqrt(F.avg((_c(label) - F.col("prediction")) ** 2))).first()[0]

    out = search(df.sparkSession, path, SPACE, score, list(fold_list), n_trials, seed)
    return out.withColumnsRenamed({"mean_score": "mean_rmse", "scores": "rmse_per_fold"})


def without_summary(model, spark: SparkSession):
    """The model without its training summary, by writing and reading it: the summary holds the session, which can't go to
    the executors once the session has observed a write."""
    if not getattr(model, "hasSummary", False):
        return model
    path = new_path(spark)
    model.save(path)
    return type(model).load(path)


def fit_predict(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, estimator) -> tuple[DataFrame, object]:
    model = without_summary(estimator.fit(assemble(train, features)), train.sparkSession)
    return model.transform(assemble(test, features)), model


def regressors(label: str, seed: int = 42) -> dict:
    """M5: the algorithm list (Spark defaults for tree sizes)."""
    return {
        "linear": LinearRegression(labelCol=label, regParam=0.0),
        "ridge": LinearRegression(labelCol=label, regParam=1.0, elasticNetParam=0.0),
        "lasso": LinearRegression(labelCol=label, regParam=0.01, elasticNetParam=1.0),
        "elastic_net": LinearRegression(labelCol=label, regParam=0.01, elasticNetParam=0.5),
        "decision_tree": DecisionTreeRegressor(labelCol=label, seed=seed),
        "random_forest": RandomForestRegressor(labelCol=label, seed=seed),
        "gradient_boosting": GBTRegressor(labelCol=label, seed=seed),
    }


def leaderboard(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, names: Sequence[str] | None = None,
                mode: str = "exact") -> DataFrame:
    """M5: holdout metrics of each algorithm (fitted concurrently), best RMSE first."""
    todo = [(n, e) for n, e in regressors(label).items() if not names or n in names]

    def run(item):
        name, est = item
        pred, _ = fit_predict(train, test, features, label, est)
        return regression_metrics(pred, label, "prediction", mode).withColumn("model", F.lit(name)).checkpoint(eager=True)

    with ThreadPoolExecutor(max_workers=len(todo)) as pool:
        parts = list(pool.map(run, todo))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("rmse")


def feature_importance(model, features: Sequence[str], spark: SparkSession, top: int = 10) -> DataFrame:
    """M6: tree-model importances as a table, top ``top``."""
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(features, imp), key=lambda x: (-x[1], x[0]))[:top]
    return spark.createDataFrame([(f, float(v)) for f, v in rows], "feature string, importance double")


def importance_guard(importances: DataFrame, suspects: Sequence[str] = SUSPECT_FEATURES, top: int = 3) -> bool:
    """Q22: False when a suspect feature is among the top ``top`` importances."""
    topf = [r.feature for r in importances.orderBy(F.desc("importance"), "feature").limit(top).collect()]
    return not any(s in topf for s in suspects)


def leak_test(df: DataFrame, features: Sequence[str], label: str, seed: int = 42, limit: float = LEAK_R2_LIMIT) -> DataFrame:
    """Q21: linear regression on all complete rows, 80/20 by hash (one pass of
    normal equations); holdout R^2 above ``limit`` means a leak."""
    # materialize the narrow projection first: filters over many derived
    # columns otherwise make the optimizer's constraint inference blow up
    base = df.select(*[_c(c) for c in features], _c(label)).checkpoint(eager=True)
    d = base.withColumn("_h", F.xxhash64(*[_c(c) for c in base.columns], F.lit(seed)))
    d = d.na.drop()
    tr, te = d.where(F.abs(F.col("_h") % 5) != 0), d.where(F.abs(F.col("_h") % 5) == 0)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"),
                            StandardScaler(inputCol="raw", outputCol="features"),
                            LinearRegression(labelCol=label)])
    pred = pipe.fit(tr).transform(te)
    m = regression_metrics(pred, label)
    return m.select("n", "r2", (F.col("r2") > limit).alias("leak_detected"))


# classification ---------------------------------------------------------------
def stratified_split(df: DataFrame, label: str, id_cols: Sequence[str], fractions=(0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """M8: exact per-class split by a seeded hash order; adds ``split`` in
    train / val / test. The in-class rank uses the skew-proof global sort, so
    a class holding most rows is never ranked inside one task."""
    d = df.withColumn("_h", F.xxhash64(*[_c(c) for c in id_cols], F.lit(seed)))
    r = rank_within_groups(d, [label], ["_h", *id_cols])
    a, b = fractions[0], fractions[0] + fractions[1]
    pos = F.col("_rank") / F.col("_n")
    return r.withColumn("split", F.when(pos < a, "train").when(pos < b, "val").otherwise("test")).drop("_h", "_rank", "_n")


def oversample_minority(df: DataFrame, label: str) -> DataFrame:
    """Replicate minority rows round(n_major / n_minor) times (binary label)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_k"))
    mx = c.agg(F.max("_k").alias("_mx"))
    f = c.crossJoin(F.broadcast(mx)).select(label, F.greatest(F.lit(1), F.round(F.col("_mx") / F.col("_k")).cast("int")).alias("_f"))
    return attach(df, f, label, "inner").withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("_f")))).drop("_f", "_r")


def smote(df: DataFrame, id_col: str, features: Sequence[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """M9: ``(<label>, base_id, neighbour_id, gap, <features>)``: all rows (gap null) and as many synthetic ones as every smaller class lacks.

    A synthetic row lies at ``gap`` (0 to 1) on the way from a row to one of its ``k`` nearest rows of the same class. A class of
    n rows gets floor(lack / n) or one more from each row; which rows give one more, the neighbour and the gap follow from hashes
    of id, count and seed, so a rerun agrees. A class of one row has no neighbour and stays as it is. Labels come as strings;
    rows with a missing feature or label are left out.
    """
    near = stored(nearest_rows(df, id_col, features, label, k))
    sizes = near.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))
    lack = sizes.crossJoin(F.broadcast(most)).where("_n > 1 AND _n < _most").withColumn("_lack", F.col("_most") - F.col("_n")).drop("_most", "_n")
    rows = attach(near, lack, label, "inner").withColumn("_h", F.xxhash64(id_col, F.lit(seed)))
    rows = rank_within_groups(rows, [label], ["_h", id_col])
    times = F.floor(F.col("_lack") / F.col("_n")) + (F.col("_rank") < F.col("_lack") % F.col("_n")).cast("int")
    rows = rows.withColumn("_times", times).where("_times > 0").withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    rows = rows.select(label, F.col(id_col).alias("base_id"), "vec", F.element_at("near", (F.pmod(F.xxhash64(id_col, "_c", F.lit(seed + 1)), F.size("near")) + 1).cast("int"))["id"].alias("neighbour_id"),
                       (F.pmod(F.xxhash64(id_col, "_c", F.lit(seed + 2)), F.lit(1 << 30)) / float(1 << 30)).alias("gap"))
    other = near.select(F.col(id_col).alias("neighbour_id"), F.col("vec").alias("_to"))
    made = rows.join(other, "neighbour_id").select(
        label, "base_id", "neighbour_id", "gap", F.zip_with("vec", "_to", lambda a, b: a + (b - a) * F.col("gap")).alias("vec"))
    plain = near.select(label, F.col(id_col).alias("base_id"), F.lit(None).cast("long").alias("neighbour_id"), F.lit(None).cast("double").alias("gap"), "vec")
    return plain.unionByName(made).select(label, "base_id", "neighbour_id", "gap", *[F.col("vec")[i].alias(f) for i, f in enumerate(features)])


def classifiers(label: str, seed: int = 42) -> dict:
    return {
        "logistic_regression": LogisticRegression(labelCol=label, maxIter=1000),
        "random_forest": RandomForestClassifier(labelCol=label, seed=seed),
        "gradient_boosting": GBTClassifier(labelCol=label, seed=seed),
    }


def with_score(pred: DataFrame) -> DataFrame:
    return pred.withColumn("score", vector_to_array("probability")[1])


def classification_metrics(pred: DataFrame, label: str, prediction: str = "prediction", score: str = "score") -> DataFrame:
    """M10 (one row): accuracy, precision, recall, F1 of class 1 and the exact
    ROC AUC (Mann-Whitney with average ranks of tied scores)."""
    y, p = _c(label).cast("int"), _c(prediction).cast("int")
    cm = pred.agg(F.count(F.lit(1)).alias("n"), F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    auc = auc_mann_whitney(pred, label, score)
    m = cm.crossJoin(auc)
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return m.select("n", "tp", "fp", "fn", "tn", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    F.try_divide(2 * prec * rec, prec + rec).alias("f1"), "auc")


def auc_mann_whitney(pred: DataFrame, label: str, score: str) -> DataFrame:
    s = pred.select(_c(score).cast("double").alias("_s"), _c(label).cast("int").alias("_y"))
    r = rank_within_groups(s, [], ["_s"])
    ties = r.groupBy("_s").agg(((F.min("_rank") + F.max("_rank")) / 2.0 + 1).alias("_avg"),
                               F.count_if(F.col("_y") == 1).alias("_pos"))
    agg = ties.agg(F.sum(F.col("_avg") * F.col("_pos")).alias("_rs"))
    n = s.agg(F.count_if(F.col("_y") == 1).alias("_n1"), F.count_if(F.col("_y") == 0).alias("_n0"))
    return agg.crossJoin(n).select(F.try_divide(F.col("_rs") - F.col("_n1") * (F.col("_n1") + 1) / 2.0, F.col("_n1") * F.col("_n0")).alias("auc"))


def confusion_matrix(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(_c(label).cast("int").alias("actual"), _c(prediction).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))


def roc_points(pred: DataFrame, label: str, score: str = "score") -> DataFrame:
    """The ROC curve at every distinct score: (threshold, tpr, fpr) of "positive from this score on".

    Scores are counted first (equal ones are one row) and summed from the top by a distributed running sum.
    """
    s = pred.select(_c(score).cast("double").alias("threshold"), _c(label).cast("int").alias("y")).where("threshold IS NOT NULL")
    c = s.groupBy("threshold").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    tot = c.agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q"))
    up = running_sum(c.select("threshold", "pos", "neg"), [], [F.desc("threshold")], "pos", "tp")
    up = running_sum(up, [], [F.desc("threshold")], "neg", "fp")
    return up.crossJoin(F.broadcast(tot)).select("threshold", F.try_divide("tp", "_p").alias("tpr"), F.try_divide("fp", "_q").alias("fpr"))


def classification_report(pred: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support by class, and their macro and weighted averages (0 where undefined)."""
    c = pred.groupBy(_c(label).cast("int").alias("a"), _c(prediction).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col("a").alias("c"), F.lit(1).alias("is_a")), F.struct(F.col("p").alias("c"), F.lit(0).alias("is_a"))))
    per = c.withColumn("s", side).groupBy("s.c").agg(F.sum(F.when(F.col("s.is_a") == 1, F.col("n")).otherwise(0)).alias("support"),
                                                     F.sum(F.when(F.col("s.is_a") == 0, F.col("n")).otherwise(0)).alias("said"),
                                                     F.sum(F.when((F.col("a") == F.col("p")) & (F.col("s.is_a") == 1), F.col("n")).otherwise(0)).alias("hit"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    per = per.select(F.col("c").cast("string").alias("class"), zero(F.try_divide("hit", "said")).alias("precision"), zero(F.try_divide("hit", "support")).alias("recall"),
                     zero(F.try_divide(2.0 * F.col("hit"), F.col("said") + F.col("support"))).alias("f1"), "support")
    names = ("precision", "recall", "f1")
    macro = per.agg(*[F.avg(x).alias(x) for x in names], F.sum("support").alias("support")).select(F.lit("macro avg").alias("class"), *names, "support")
    weighted = per.agg(*[(F.sum(F.col(x) * F.col("support")) / F.sum("support")).alias(x) for x in names], F.sum("support").alias("support")).select(
        F.lit("weighted avg").alias("class"), *names, "support")
    return per.unionByName(macro).unionByName(weighted)


def classifier_leaderboard(train: DataFrame, test: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """M7 + M10 + M11: fit each classifier and report its test metrics."""
    out = None
    for name, est in classifiers(label).items():
        pred, _ = fit_predict(train, test, features, label, est)
        m = classification_metrics(with_score(pred), label).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


# stacking -----------------------------------------------------------------------
def hash_folds(df: DataFrame, id_col: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` (0 to folds - 1): rows in a seeded hash order are dealt out in turn, so folds differ by one row at most."""
    r = rank_within_groups(df.withColumn("_h", F.xxhash64(id_col, F.lit(seed))), [], ["_h", id_col])
    return r.withColumn("fold", (F.col("_rank") % folds).cast("int")).drop("_h", "_rank", "_n")


def out_of_fold_scores(train: DataFrame, id_col: str, features: Sequence[str], label: str, estimators: dict, folds: int = 5) -> DataFrame:
    """(id, label, fold, model, fitted_without, score): every row scored by each learner fitted on the other folds only.

    ``fitted_without`` is the fold that the scoring model had not seen. Fits are independent Spark jobs; each part is written.
    """

    def run(item):
        (name, est), k = item
        pred, _ = fit_predict(train.where(F.col("fold") != k), train.where(F.col("fold") == k), features, label, est.copy())
        return stored(with_score(pred).select(id_col, label, "fold", F.lit(name).alias("model"), F.lit(k).alias("fitted_without"), "score"))

    with ThreadPoolExecutor(max_workers=4) as pool:
        parts = list(pool.map(run, [(e, k) for e in estimators.items() for k in range(folds)]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nonnegative_weights(scores: DataFrame, id_col: str, label: str, names: Sequence[str]) -> dict[str, float]:
    """M11 meta model: non-negative least squares of the label on the learners' scores, normalised to sum 1.

    The driver gets the learners' Gram matrix, a few numbers; of all active sets the best feasible one is taken, which is
    exact. If all weights are zero, the learners count alike.
    """
    wide = scores.groupBy(id_col).pivot("model", list(names)).agg(F.first("score")).join(scores.select(id_col, _c(label).cast("double").alias("_y")).distinct(), id_col)
    cols = [*names, "_y"]
    row = wide.agg(*[F.sum(_c(a) * _c(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]).first()
    g = np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(len(cols))] for i in range(len(cols))], dtype=np.float64)
    best, weights = g[-1, -1], np.zeros(len(names))
    for pick in range(1, 1 << len(names)):
        s = [i for i in range(len(names)) if pick >> i & 1]
        w = np.linalg.lstsq(g[np.ix_(s, s)], g[s, -1], rcond=None)[0]
        loss = g[-1, -1] - 2 * w @ g[s, -1] + w @ g[np.ix_(s, s)] @ w
        if (w >= 0).all() and loss < best - 1e-12 * abs(g[-1, -1]):
            best, weights = loss, np.zeros(len(names))
            weights[s] = w
    total = weights.sum()
    return dict(zip(names, (weights / total if total > 0 else np.full(len(names), 1 / len(names))).tolist()))


def stacked_leaderboard(train: DataFrame, test: DataFrame, oof: DataFrame, id_col: str, features: Sequence[str], label: str, estimators: dict) -> DataFrame:
    """Test metrics of every learner fitted on all of ``train``, and of their mix by the out-of-fold weights; best AUC first."""
    names = list(estimators)
    weights = nonnegative_weights(oof, id_col, label, names)

    def run(name):
        pred, _ = fit_predict(train, test, features, label, estimators[name].copy())
        return stored(with_score(pred).select(id_col, label, F.lit(name).alias("model"), "score"))

    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        parts = list(pool.map(run, names))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    share = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("model"))
    mix = every.groupBy(id_col, label).agg(F.sum(F.col("score") * share).alias("score")).withColumn("model", F.lit("stacked"))
    out = None
    for name, part in [*zip(names, parts), ("stacked", mix)]:
        m = classification_metrics(part.withColumn("prediction", (F.col("score") >= 0.5).cast("int")), label).withColumns(
            {"model": F.lit(name), "weight": F.lit(weights.get(name)).cast("double")})
        out = m if out is None else out.unionByName(m)
    return out.orderBy(F.desc("auc"), "model")


def kmeans_clusters(df: DataFrame, features: Sequence[str], k: int = 5, seed: int = 42, out: str = "geo_cluster") -> DataFrame:
    """KMeans cluster id on the given columns."""
    a = assemble(df, features, "_kf")
    model = KMeans(k=k, seed=seed, featuresCol="_kf", predictionCol=out).fit(a)
    return model.transform(a).drop("_kf")


def save_model(model, path: str) -> None:
    """Persist a fitted model / pipeline (overwrite)."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# feature selection ------------------------------------------------------------
def low_variance_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.001) -> list[str]:
    """Columns whose sample variance is below the threshold (one aggregate row)."""
    row = df.agg(*[F.var_samp(_c(c)).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] < threshold]


def feature_scores(df: DataFrame, cols: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """Per feature |r| with the target, F-regression statistic r^2 (n-2) / (1 - r^2), and mutual information by
    the ``k`` nearest neighbours over all rows; F and information min-max normalised and averaged. Rows with a missing value
    are left out."""
    d = stored(df.select(*[_c(c).cast("double").alias(c) for c in cols], _c(target).cast("double").alias("_y")).na.drop())
    st = d.agg(F.count(F.lit(1)).alias("_n"), *[safe_corr(_c(c), F.col("_y")).alias(f"r::{c}") for c in cols])
    rs = st.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`r::{c}`").alias("r")) for c in cols])).alias("_s"), "_n")
    sc = rs.select("_s.feature", "_s.r", "_n").join(mutual_information(d, cols, "_y", k), "feature").withColumns({
        "abs_r": F.abs("r"),
        "f_stat": F.try_divide(F.col("r") ** 2 * (F.col("_n") - 2), 1 - F.col("r") ** 2),
    }).drop("_n")
    allw = Window.partitionBy()  # one row per feature

    def norm(c):
        lo, hi = F.min(c).over(allw), F.max(c).over(allw)
        return F.when(hi == lo, F.lit(0.0)).otherwise((F.col(c) - lo) / (hi - lo))

    sc = sc.withColumns({"f_norm": norm("f_stat"), "mi_norm": norm("mutual_info")})
    return sc.withColumn("score", (F.coalesce("f_norm", F.lit(0.0)) + F.col("mi_norm")) / 2.0)  # no F statistic: constant, or the target itself


def forest_importance(df: DataFrame, cols: Sequence[str], target: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """(feature, forest_importance) of a random forest on all complete rows."""
    d = df.select(*[_c(c).cast("double").alias(c) for c in cols], _c(target).cast("double").alias("_y")).na.drop()
    model = RandomForestRegressor(labelCol="_y", numTrees=trees, seed=seed).fit(assemble(d, cols))
    return feature_importance(model, cols, df.sparkSession, len(cols)).withColumnRenamed("importance", "forest_importance")


def select_features(scores: DataFrame, critical: Sequence[str], max_features: int = 30) -> list[str]:
    """The best-scored features up to ``max_features``, critical ones always kept."""
    ranked = [r.feature for r in scores.orderBy(F.desc("score"), "feature").collect()]  # one row per feature
    keep = [c for c in critical if c in ranked]
    for c in ranked:
        if len(keep) >= max_features:
            break
        if c not in keep:
            keep.append(c)
    return keep
