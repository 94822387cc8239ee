"""Feature steps that are fitted once, stored, and applied later.

Each step is a ``pyspark.ml`` Estimator whose fit is one aggregation over the
fit rows and whose Model holds the result as a small DataFrame. A Model (alone
or inside a ``PipelineModel``) is written as metadata plus that table in
Parquet and reads back in any session; later rows are joined to the stored
table and never look at data they were not fitted on. A fitted table is
broadcast if its measured size allows, so applying a step does not shuffle the
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions.stats import grouped_stats
from hearth.operators import features as X
from hearth.operators.features import _c
from hearth.sources.scratch import attach, stored


class _TableWriter(MLWriter):
    def __init__(self, model: "TableModel"):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, SparkSession.active())
        self.model.table.write.parquet(f"{path}/table")


class _TableReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        spark = SparkSession.active()
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        model = self.cls()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.table = spark.read.parquet(f"{path}/table")
        return model


class _Columns(Params):
    """Parameters that a step and its model share."""

    cols = Param(Params._dummy(), "cols", "columns the step works on", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "target column of an encoder", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "standard, minmax or robust", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "weight of the global mean, in rows", TypeConverters.toFloat)
    minSamples = Param(Params._dummy(), "minSamples", "rows from which a region's own mean counts alone", TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold", "share below which a category is rare", TypeConverters.toFloat)
    other = Param(Params._dummy(), "other", "name of the rare categories", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(cols=[], target="", kind="standard", smoothing=10.0, minSamples=X.TARGET_ENCODING_MIN_SAMPLES, threshold=X.RARE_CATEGORY_THRESHOLD, other="Other")


class TableModel(Model, _Columns, MLWritable, MLReadable):
    """A fitted step: its parameters and the ``table`` it learned."""

    def __init__(self, table: DataFrame | None = None):
        super().__init__()
        self.table = table

    def write(self) -> MLWriter:
        return _TableWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _TableReader(cls)


class TableEstimator(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """A step to fit; ``model_type`` says what comes out."""

    model_type: type[TableModel]

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = (), target: str = "", kind: str = "standard", smoothing: float = 10.0,
                 minSamples: int = X.TARGET_ENCODING_MIN_SAMPLES, threshold: float = X.RARE_CATEGORY_THRESHOLD, other: str = "Other"):
        super().__init__()
        given = self._input_kwargs
        self._set(**(given | ({"cols": list(given["cols"])} if "cols" in given else {})))

    def learn(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> TableModel:
        return self._copyValues(self.model_type(stored(self.learn(df))))


class ScalerModel(TableModel):
    """Adds ``<col>_scaled`` / ``_minmax`` / ``_robust`` by the fitted centre and spread."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return X.apply_scaler(df, self.table, self.getOrDefault("cols"), self.getOrDefault("kind"))


class Scaler(TableEstimator):
    """Mean and deviation, minimum and maximum, or median and quartiles of ``cols``; one row."""

    model_type = ScalerModel

    def learn(self, df: DataFrame) -> DataFrame:
        return X.fit_scaler(df, self.getOrDefault("cols"), self.getOrDefault("kind"))


class MedianImputerModel(TableModel):
    """Fills null, NaN and infinite values of ``cols`` with the fitted medians (0 where there was no value)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault("cols")
        out = df.crossJoin(F.broadcast(self.table))
        clean = lambda c: F.when(~F.isnan(_c(c).cast("double")) & (F.abs(_c(c).cast("double")) < float("inf")), _c(c).cast("double"))
        return out.withColumns({c: F.coalesce(clean(c), _c(f"{c}__med"), F.lit(0.0)) for c in cols}).drop(*[f"{c}__med" for c in cols])


class MedianImputer(TableEstimator):
    """The medians of ``cols``; one row."""

    model_type = MedianImputerModel

    def learn(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault("cols")
        clean = df.select(*[F.when(F.abs(_c(c).cast("double")) < float("inf"), _c(c).cast("double")).alias(c) for c in cols])
        return grouped_stats(clean, [], [(f"{c}__med", "median", c) for c in cols])


class TargetEncoderModel(TableModel):
    """Adds ``<col>_target_encoded``; unseen and null categories get the fitted global mean."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df.crossJoin(F.broadcast(self.table.where("category IS NULL").select(F.col("encoded").alias("_global"))))
        for c in self.getOrDefault("cols"):
            own = self.table.where((F.col("column") == c) & F.col("category").isNotNull()).select(F.col("category").alias("_cat"), F.col("encoded").alias("_enc"))
            out = attach(out.withColumn("_cat", _c(c).cast("string")), own, "_cat").withColumn(f"{c}_target_encoded", F.coalesce("_enc", "_global")).drop("_cat", "_enc")
        return out.drop("_global")


class TargetEncoder(TableEstimator):
    """Smoothed mean of ``target`` by category of each of ``cols``; a row without category holds the global mean."""

    model_type = TargetEncoderModel

    def learn(self, df: DataFrame) -> DataFrame:
        target, s = self.getOrDefault("target"), self.getOrDefault("smoothing")
        mean = df.agg(F.avg(_c(target)).alias("_g"))
        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("category")) for c in self.getOrDefault("cols")]))
        seen = df.select(pair.alias("_p"), _c(target).cast("double").alias("_y")).where("_p.category IS NOT NULL").groupBy("_p.column", "_p.category").agg(
            F.avg("_y").alias("_m"), F.count("_y").alias("_n"))
        smooth = (F.col("_n") * F.coalesce("_m", F.lit(0.0)) + s * F.col("_g")) / (F.col("_n") + s)
        return seen.crossJoin(F.broadcast(mean)).select("column", "category", smooth.alias("encoded")).unionByName(
            mean.select(F.lit(None).cast("string").alias("column"), F.lit(None).cast("string").alias("category"), F.col("_g").alias("encoded")))


class RegionEncoderModel(TableModel):
    """Adds ``<col>_target_encoded``, ``<col>_price_mean`` and ``<col>_frequency``; an unseen category has none of them."""

    def _transform(self, df: DataFrame) -> DataFrame:
        c = self.getOrDefault("cols")[0]
        own = self.table.select(F.col("category").alias("_cat"), F.col("encoded").alias(f"{c}_target_encoded"), F.col("mean").alias(f"{c}_price_mean"), F.col("n").alias(f"{c}_frequency"))
        return attach(df.withColumn("_cat", _c(c).cast("string")), own, "_cat").drop("_cat")


class RegionEncoder(TableEstimator):
    """E3 + E4: mean of ``target`` and count of the first of ``cols``; below ``minSamples`` rows the mean is drawn to the global one."""

    model_type = RegionEncoderModel

    def learn(self, df: DataFrame) -> DataFrame:
        c, least = self.getOrDefault("cols")[0], self.getOrDefault("minSamples")
        g = X.region_target_encoding(df, self.getOrDefault("target"), c, least)
        n = df.where(_c(c).isNotNull()).groupBy(_c(c).alias(c)).agg(F.count(F.lit(1)).alias("n"))
        return g.join(n, c).select(_c(c).cast("string").alias("category"), F.col("region_target_encoded").alias("encoded"), F.col("region_price_mean").alias("mean"), "n")


class RareCategoriesModel(TableModel):
    """Adds ``<col>_grouped``: categories that were not rare keep their name, all others (unseen ones too) share one; null stays null."""

    def _transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c in self.getOrDefault("cols"):
            own = self.table.where(F.col("column") == c).select(F.col("category").alias("_cat"), F.lit(True).alias("_kept"))
            out = attach(out.withColumn("_cat", _c(c).cast("string")), own, "_cat")
            out = out.withColumn(f"{c}_grouped", F.when(F.col("_kept"), F.col("_cat")).when(F.col("_cat").isNotNull(), self.getOrDefault("other"))).drop("_cat", "_kept")
        return out


class RareCategories(TableEstimator):
    """E5: the categories of each of ``cols`` with a share of ``threshold`` or more of all rows."""

    model_type = RareCategoriesModel

    def learn(self, df: DataFrame) -> DataFrame:
        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("category")) for c in self.getOrDefault("cols")]))
        counts = df.select(pair.alias("_p")).where("_p.category IS NOT NULL").groupBy("_p.column", "_p.category").agg(F.count(F.lit(1)).alias("n"))
        total = df.agg(F.count(F.lit(1)).alias("_total"))
        return counts.crossJoin(F.broadcast(total)).where(F.col("n") / F.col("_total") >= self.getOrDefault("threshold")).select("column", "category", "n")


class SizeCategoriesModel(TableModel):
    """Adds ``size_category`` (first column) and ``sqm_price_category`` (second, if given) by the fitted thresholds."""

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault("cols")
        out = df.crossJoin(F.broadcast(self.table))
        s = _c(cols[0])
        new = {"size_category": F.when(s <= F.col("_s33"), X.SIZE_LABELS[0]).when(s <= F.col("_s67"), X.SIZE_LABELS[1]).otherwise(X.SIZE_LABELS[2])}
        if len(cols) > 1:
            p, a = _c(cols[1]), X.SQM_PRICE_LABELS
            new["sqm_price_category"] = F.when(p <= F.col("_p25"), a[0]).when(p <= F.col("_p50"), a[1]).when(p <= F.col("_p75"), a[2]).otherwise(a[3])
        return out.withColumns(new).drop(*self.table.columns)


class SizeCategories(TableEstimator):
    """the 33 % and 67 % quantiles of the first of ``cols`` and the quartiles of the second; one row."""

    model_type = SizeCategoriesModel

    def learn(self, df: DataFrame) -> DataFrame:
        cols = self.getOrDefault("cols")
        out = X.scalar_quantiles(df, cols[0], [0.33, 0.67], ["_s33", "_s67"])
        return out.crossJoin(X.scalar_quantiles(df, cols[1], [0.25, 0.5, 0.75], ["_p25", "_p50", "_p75"])) if len(cols) > 1 else out


class OneHotModel(TableModel):
    """Adds ``<col>_<category>`` 0/1 columns for the fitted categories; unseen ones have 0 everywhere."""

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = self.table.orderBy("column", "category").collect()  # at most MAX_ONEHOT rows a column
        return df.withColumns({f"{r['column']}_{r['category']}": F.coalesce((_c(r["column"]).cast("string") == r["category"]).cast("int"), F.lit(0)) for r in rows})


class OneHot(TableEstimator):
    """The categories of each of ``cols`` but the first in order; columns with more than ten categories are left alone."""

    model_type = OneHotModel

    def learn(self, df: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("category")) for c in self.getOrDefault("cols")]))
        seen = df.select(pair.alias("_p")).where("_p.category IS NOT NULL").select("_p.*").distinct()
        few = seen.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") <= X.MAX_CATEGORIES_ONEHOT).drop("k")
        return seen.join(F.broadcast(few), "column").withColumn("_i", F.row_number().over(Window.partitionBy("column").orderBy("category"))).where("_i > 1").drop("_i")


STEPS = (Scaler, MedianImputer, TargetEncoder, RegionEncoder, RareCategories, SizeCategories, OneHot)
