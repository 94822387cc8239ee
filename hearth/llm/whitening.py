"""Embedding whitening on distributed block matrices.

Vectors become integers, so sums and deviations are exact. The distinct integer
vectors, centred, are indexed into the blocks of an MLlib ``BlockMatrix`` A;
A'A is the scatter matrix. It is d x d, whatever the number of rows; the driver
takes its eigenvectors and A times the whitening matrix (d x 16, one block)
projects the rows. The sum over row blocks is split over tasks that hold some
blocks each, then added up.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.llm.graph import cut, fitting

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS = 1024
BLOCKS_PER_TASK = 8
#: Entries of this size and beyond are taken as not finite: their integer would no longer be exact in double precision.
LARGEST = float(1 << 46)


def usable(vec: Column, largest: float) -> Column:
    """Not null, not empty, and no entry that is null, not finite or ``largest`` or more in size."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(largest)), F.lit(False)))


def common_length(rows: DataFrame, vec: str) -> int:
    """The commonest length of ``vec``, the longer one of two; 0 without rows."""
    top = rows.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top["d"] if top else 0


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` with dense numbers from 0 in the column ``name``, and its rows.

    Rows are written with their task and place there; what is joined back is one offset per task.
    """
    at = F.monotonically_increasing_id()
    rows = cut(df.withColumn("_at", at))
    tasks = rows.groupBy(F.shiftright("_at", 33).alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    counts = [tuple(r) for r in tasks.orderBy("_task").collect()]  # one row per task that wrote
    offsets = np.concatenate([[0], np.cumsum([n for _, n, _ in counts], dtype=np.int64)]).tolist()
    table = df.sparkSession.createDataFrame([(t, o - low) for (t, _, low), o in zip(counts, offsets)], "_task long, _shift long")
    dealt = rows.withColumn("_task", F.shiftright("_at", 33)).join(fitting(table), "_task")
    return dealt.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift"), offsets[-1]


def _times(a: BlockMatrix, b: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """a b, the sum over a's columns split into ``splits`` parts (Scala's second argument, which Python's method lacks)."""
    product = a._java_matrix_wrapper._java_model.multiply(b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.rowsPerBlock, b.colsPerBlock)


def _blocks(rows: DataFrame, index: str, vec: Column, n: int, d: int) -> BlockMatrix:
    table = MLUtils.convertVectorColumnsFromML(rows.select(F.col(index).alias("index"), array_to_vector(vec).alias("vector")), "vector")
    return IndexedRowMatrix(table, n, d).toBlockMatrix(BLOCK_ROWS, d)


def _gram(a: BlockMatrix, n: int, d: int) -> np.ndarray:
    splits = max(1, math.ceil(n / BLOCK_ROWS / BLOCKS_PER_TASK))
    return _times(a.transpose(), a, splits).toLocalMatrix().toArray().reshape(d, d)


def whitening_matrix(scatter: np.ndarray, n: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns e^-1/2 times eigenvectors, shares of the trace, whether there is variance) of ``keep`` components by falling eigenvalue.

    Signs make each eigenvector's largest entry positive. A component whose
    eigenvalue is rounding noise has no variance: its column is zero.
    """
    cov = scatter / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:keep], vectors[:, ::-1][:, :keep]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    real = values > max(values.max(initial=0), 0) * len(cov) * 1e-14
    trace = np.trace(cov)
    share = values / trace if trace > 0 else np.zeros(len(values))
    return np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), 0.0), np.where(real, share, 0.0), real


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(<id>, component, n, deviation, whitened, explained, identity_error)``: a row per usable vector and component.

    An entry c becomes x = floor(64 c) + 1000000. The fit list holds each
    distinct x vector once: ``n`` of them with sums S. ``deviation`` is the exact
    sum of (n x - S)^2, null if it doesn't fit a long. ``whitened`` is x - S/n on
    the component's eigenvector over the root of its eigenvalue, ``explained``
    the eigenvalue's share of the trace and ``identity_error`` the largest
    absolute entry of the fit list's whitened covariance minus the identity.

    Vectors that are null, empty or hold a null, non-finite or huge entry
    (``LARGEST``) get no rows, nor do vectors of another than the commonest
    length (ties: the longer). Repeated rows each get theirs; a null id is kept. A component without
    variance has a null ``whitened``, ``explained`` 0 and is left out of
    ``identity_error`` (null if there is none with variance). Other columns are
    not read. The driver holds d x d numbers for vectors of length d.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(usable(F.col("vec"), LARGEST))
    rows = cut(rows.select("id", F.transform("vec", lambda c: F.floor(c * SCALE) + SHIFT).alias("x")))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
                           T.StructField("identity_error", T.DoubleType())])
    d = common_length(rows, "x")
    if not d:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == d)
    keep = min(components, d)
    fit, n = numbered(rows.select("x").distinct(), "index")
    sums = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).orderBy("pos").collect()
    whole, rest = zip(*(divmod(int(r["s"]), n) for r in sums))  # S = n whole + rest
    near = F.zip_with("x", F.array(*[F.lit(v).cast("long") for v in whole]), lambda x, v: x - v)
    centred = F.zip_with(near, F.array(*[F.lit(v / n) for v in rest]), lambda x, v: x.cast("double") - v)
    off = F.zip_with(near, F.array(*[F.lit(v).cast("long") for v in rest]), lambda x, v: F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), v))  # n x - S

    a = _blocks(fit, "index", centred, n, d)
    weights, share, real = whitening_matrix(_gram(a, n, d), n, keep)
    w = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(d, keep, weights.ravel(order="F").tolist()))], 1), d, keep)
    gap = np.abs(_gram(_times(a, w), n, keep) / n - np.eye(keep))[np.ix_(real, real)]
    error = float(gap.max()) if gap.size else None

    every, m = numbered(rows.select("id", F.col("x"), F.aggregate(off, F.lit(0).cast("long"), lambda s, v: F.try_add(s, F.try_multiply(v, v))).alias("deviation")), "index")
    projected = _times(_blocks(every, "index", centred, m, d), w)
    lines = projected.blocks.flatMap(lambda b: ((b[0][0] * BLOCK_ROWS + i, v) for i, v in enumerate(b[1].toArray().tolist())))
    lines = spark.createDataFrame(lines, "index long, y array<double>", verifySchema=False)
    out = every.select("index", "id", "deviation").join(lines, "index").select("id", "deviation", F.posexplode("y").alias("k", "y"))
    parts = F.array(*[F.lit(float(v)) for v in share]), F.array(*[F.lit(bool(v)) for v in real])
    return out.select(F.col("id").alias(id_col), (F.col("k") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      F.when(parts[1][F.col("k")], F.col("y")).alias("whitened"), parts[0][F.col("k")].alias("explained"),
                      F.lit(error).cast("double").alias("identity_error"))
