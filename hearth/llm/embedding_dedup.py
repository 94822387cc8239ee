"""Embedding near-duplicates: spherical k-means cells and blocked cosine products.

Equal vectors of one label are one class. A class lives in the cell of its
nearest centre. Two unit vectors with cosine ``t`` or more are at most
``asin(sqrt(1 - t^2))`` apart, so a partner can live across the border of cell
``c`` only if the vector is within that angle of the hyperplane between its own
centre and ``c``; it visits exactly the cells where that holds. No pair is lost,
however the centres were fitted. Cells are cut into blocks of members and of
visitors, so a cell that holds much of the data is many bounded tasks. A block
gives out one row per vector (links counted, smallest class reached), no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.graph import HOT_SHARE, connected_components, cut, spread_join

THRESHOLD = 0.98
FIT_ROWS = 20_000  # vectors at most, by hash, that the centres are fitted on; an eighth as many centres at most
MEMBERS, VISITORS = 1024, 4096  # rows of a block


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """``k`` unit centres of unit rows ``x``; an empty centre keeps its place."""
    centres = x[np.random.default_rng(seed).choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[a:a + 4096] @ centres.T, axis=1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(classes: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Centres by dimension, about ``sqrt(total) / 8`` of them: cells grow with the rows, up to what the fit can place."""
    share = min(1.0, FIT_ROWS / max(total, 1))
    rows = classes.where(F.pmod(F.col("cid"), F.lit(1 << 30)) < share * (1 << 30)).select("vec").collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(len(r.vec), []).append(r.vec)
    k = max(1, min(FIT_ROWS // 8, math.isqrt(total) // 8))
    return {d: spherical_kmeans(_unit(np.array(v, dtype=np.float64)), k) for d, v in by_dim.items()}


def _parts(dims: np.ndarray):
    """(length, row numbers) of at most 1,024 rows of one length, so that a row's distances to all centres stay small."""
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        for a in range(0, len(rows), 1024):
            yield d, rows[a:a + 1024]


def _assign(centres, threshold: float):
    """A class's home row (``member``) and a row for every cell that it visits, its own included."""
    reach = math.sqrt(1 - threshold * threshold) + 1e-9

    def run(batches):
        by_dim = centres.value
        gaps = {d: np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0)) + 1e-7 for d, c in by_dim.items()}  # a bit too far only adds visits
        for batch in batches:
            dims = np.array([len(v) for v in batch.column("vec")])
            for d, rows in _parts(dims):
                part = batch.take(pa.array(rows))
                c = by_dim.get(int(d))
                if c is None:
                    home, visits = np.zeros(len(rows), np.int64), np.ones((len(rows), 1), bool)
                else:
                    dots = _unit(_matrix(part.column("vec"))) @ c.T
                    home = np.argmax(dots, axis=1)
                    visits = dots[np.arange(len(rows)), home][:, None] - dots <= reach * gaps[int(d)][home] + 1e-9
                    visits[np.arange(len(rows)), home] = True
                at, cell = np.nonzero(visits)
                take = np.concatenate([np.arange(len(rows)), at])
                out = part.take(pa.array(take))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(np.concatenate([home, cell]).astype(np.int32)), pa.array(np.arange(len(take)) < len(rows))],
                    names=[*out.schema.names, "cell", "member"])

    return run


def _block(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        member = t.column("member").to_numpy(zero_copy_only=False)
        cid, copies = t.column("cid").to_numpy(), t.column("copies").to_numpy()
        if not member.any() or member.all():
            hits = np.zeros((0, 0), bool)
            left = right = np.zeros(0, np.int64)
        else:
            x = _matrix(t.column("vec"))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            left, right = cid[~member], cid[member]
            hits = (x[~member] @ x[member].T) / (norm[~member][:, None] * norm[member][None, :]) >= threshold
            hits &= left[:, None] != right[None, :]
        links = hits @ copies[member] if hits.size else np.zeros(len(left), np.int64)
        ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        a, b = np.nonzero(hits)
        a, b = at[:len(left)][a], at[len(left):][b]
        low = np.arange(len(ids))
        while len(a):
            new = low.copy()
            np.minimum.at(new, a, low[b])
            np.minimum.at(new, b, low[a])
            new = new[new]
            if (new == low).all():
                break
            low = new
        seen = np.unique(np.concatenate([a, b]))
        counted = np.zeros(len(ids), np.int64)
        np.add.at(counted, at[:len(left)], links)
        return pa.table({"cid": ids[seen], "links": counted[seen], "low": ids[low[seen]]})

    return run


def embedding_near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                              threshold: float = THRESHOLD) -> DataFrame:
    """``(<id>, n_links, component_id, kept)`` per row of ``vectors``.

    Rows link when their labels are equal and not null, their vectors have the
    same length and cosine ``threshold`` or more, in double precision. A null,
    empty or zero vector, or one with a null or non-finite component, links with
    nothing. ``n_links`` counts the other rows linked directly (copies too),
    ``component_id`` is the smallest id reachable, and the row with it is kept.
    Repeated rows each get a row. Other columns are not read.
    """
    spark = vectors.sparkSession
    good = (F.col("label").isNotNull() & F.col("vec").isNotNull()
            & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vec", lambda v: v != 0))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = cut(rows.withColumn("cid", F.when(good, F.xxhash64("label", "vec"))))
    total = rows.count()
    classes = cut(rows.where("cid IS NOT NULL").groupBy("cid").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"),
                                                                   F.any_value("label").alias("label"), F.any_value("vec").alias("vec")))
    centres = spark.sparkContext.broadcast(_fit(classes, total))
    kind = dict(classes.dtypes)["label"]
    placed = cut(classes.select("cid", "copies", "label", "vec").mapInArrow(
        _assign(centres, threshold), f"cid bigint, copies bigint, label {kind}, vec array<double>, cell int, member boolean"))
    key = ["label", "dim", "cell"]
    placed = placed.withColumn("dim", F.size("vec"))
    sizes = cut(placed.groupBy(*key).agg(F.ceil(F.count_if("member") / MEMBERS).cast("int").alias("m"),
                                         F.ceil(F.count_if(~F.col("member")) / VISITORS).cast("int").alias("v")).where("m > 0"))
    dealt = placed.join(sizes, key)
    own_m = F.pmod(F.xxhash64("cid", F.lit(1)), F.col("m")).cast("int")
    own_v = F.pmod(F.xxhash64("cid", F.lit(2)), F.col("v")).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = (dealt.withColumn("mb", F.explode(F.when(F.col("member"), F.array(own_m)).otherwise(all_of("m"))))
             .withColumn("vb", F.explode(F.when(F.col("member"), all_of("v")).otherwise(F.array(own_v)))))
    found = cut(dealt.select(*key, "mb", "vb", "cid", "copies", "member", "vec").groupBy(*key, "mb", "vb")
                .applyInArrow(_block(threshold), "cid bigint, links bigint, low bigint"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("cid").alias("a"), F.col("low").alias("b")))
    joined = (classes.select("cid", "first", "copies").join(links, "cid", "left")
              .join(comp.select(F.col("id").alias("cid"), "component"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    label = cut(joined.join(lowest, "component").select(
        "cid", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"))
    valid = spread_join(rows.where("cid IS NOT NULL").select("id", "cid"), label, "cid", F.col("copies") * HOT_SHARE >= total)
    out = valid.select("id", "n_links", "component_id").union(
        rows.where("cid IS NULL").select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
