"""Nearest neighbours in two dimensions and mutual information by them.

The points of a key (a feature against the target) are sorted into strips by x
and each strip into tiles by y, all of about equal size, with the skew-proof
ranks. A task cuts its tile into cells of some points and finds every point's
nearest neighbours inside the tile from the few cells around it. Only a point whose circle (a square, in the maximum norm) reaches over its tile's
border is sent to the tiles that it touches, and the candidates are merged. So
no group is larger than a tile, and what crosses borders is a thin margin.
Coordinates are integers: distances, ties and range counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.quantile import rank_within_groups, running_sum
from hearth.sources.scratch import stored

TILE = 4096
CELL = 16
MAX_TILES = 1_000_000  # tiles grow beyond it, so that their boxes (32 bytes each) can be sent to every task
GRID = float(1 << 32)  # steps of a standard deviation
_CHUNK = 1 << 22
_FAR = 1 << 61  # coordinates are far smaller


def _cells(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, cell starts): the points in strips by x, each cut by y into cells of ``CELL`` points or a few more."""
    n = len(x)
    order = np.lexsort((y, x))
    count = max(1, round(math.sqrt(n / CELL)))
    strip = np.arange(n) * count // max(1, n)
    order = order[np.lexsort((x[order], y[order], strip))]
    size = np.bincount(strip, minlength=count)
    first = np.cumsum(size) - size
    cuts = [f + np.arange(c) * m // c for f, m, c in zip(first, size, np.maximum(1, size // CELL))]
    return order, np.concatenate(cuts)[:n]


def _padded(v: np.ndarray, starts: np.ndarray, fill: int) -> np.ndarray:
    """One row for each cell; what a cell lacks is ``fill``."""
    sizes = np.diff(np.append(starts, len(v)))
    out = np.full((len(starts), sizes.max()), fill, np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = v
    return out


def _touching(x, y, r, box) -> tuple[np.ndarray, np.ndarray]:
    """(points, boxes): every box that is no further than ``r`` from a point. Consecutive points are tried together first."""
    at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = np.arange(0, len(x), CELL)
    if len(x):
        left, right = np.minimum.reduceat(x - r, starts), np.maximum.reduceat(x + r, starts)
        low, high = np.minimum.reduceat(y - r, starts), np.maximum.reduceat(y + r, starts)
    step = max(1, _CHUNK // (CELL * len(box)))
    for a in range(0, len(starts), step):
        s = slice(a, a + step)
        b, j = np.nonzero((box[None, :, 1] >= left[s, None]) & (box[None, :, 0] <= right[s, None]) & (box[None, :, 3] >= low[s, None]) & (box[None, :, 2] <= high[s, None]))
        i, j = (starts[s][b][:, None] + np.arange(CELL)).ravel(), np.repeat(j, CELL)
        i, j = i[i < len(x)], j[i < len(x)]
        gap = np.maximum(np.maximum(box[j, 0] - x[i], x[i] - box[j, 1]), np.maximum(box[j, 2] - y[i], y[i] - box[j, 3]))
        at.append(i[gap <= r[i]])
        to.append(j[gap <= r[i]])
    return np.concatenate(at), np.concatenate(to)


def _within(x, y, r, px, py, pw, starts, k: int) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """(reach, distances, weights): for each of (x, y) the points of the cells up to ``r`` away, nearest first, as far as ``k`` others
    are reached. The reach is the distance of the ``k``-th (a point's own copies count), -1 if there are not so many."""
    box = np.stack([f.reduceat(v, starts) for v in (px, py) for f in (np.minimum, np.maximum)], axis=1)
    cx, cy, cw = _padded(px, starts, _FAR), _padded(py, starts, _FAR), _padded(pw, starts, 0)
    at, to = _touching(x, y, r, box)
    found = [(np.zeros(0, np.int64),) * 3]
    step = max(1, _CHUNK // cx.shape[1])
    for a in range(0, len(at), step):
        p, c = at[a:a + step], to[a:a + step]
        d = np.maximum(np.abs(x[p, None] - cx[c]), np.abs(y[p, None] - cy[c]))
        i, j = np.nonzero(d <= r[p, None])
        found.append((p[i], d[i, j], cw[c[i], j]))
    q, d, w = (np.concatenate(v) for v in zip(*found))
    order = np.lexsort((d, q))
    q, d, w = q[order], d[order], w[order]
    total = np.cumsum(w)
    before = np.append(0, total)[np.searchsorted(q, np.arange(len(x)))]
    total = total - before[q]
    need = total - w <= k
    q, d, w, total = q[need], d[need], w[need], total[need]
    reach = np.full(len(x), -1, np.int64)
    reach[q[total > k]] = d[total > k]
    offsets = pa.array(np.searchsorted(q, np.arange(len(x) + 1)).astype(np.int32))
    return reach, pa.ListArray.from_arrays(offsets, pa.array(d)), pa.ListArray.from_arrays(offsets, pa.array(w))


def _own(boxes, k: int):
    """Per point of a tile its reach there; a further row for every other tile that this reach touches."""

    def run(t: pa.Table) -> pa.Table:
        x, y, w = (t.column(c).to_numpy() for c in ("x", "y", "w"))
        key, strip, tile = (t.column(c)[0].as_py() for c in ("key", "strip", "tile"))
        order, starts = _cells(x, y)
        x, y, w = x[order], y[order], w[order]
        cx, cy = _padded(x, starts, _FAR), _padded(y, starts, _FAR)
        bound = np.full(cx.shape, _FAR // 2)
        step = max(1, _CHUNK // cx.shape[1] ** 2)
        for a in range(0, len(cx) if cx.shape[1] > k else 0, step):  # no further than the k-th other point of its cell
            bx, by = cx[a:a + step], cy[a:a + step]
            near = np.maximum(np.abs(bx[:, :, None] - bx[:, None, :]), np.abs(by[:, :, None] - by[:, None, :]))
            bound[a:a + step] = np.minimum(np.partition(near, k, axis=2)[:, :, k], _FAR // 2)
        reach, d, dw = _within(x, y, np.where(w > k, 0, bound[cx != _FAR]), x, y, w, starts, k)
        ids, box = boxes.value[key]
        mine = int(np.flatnonzero((ids[:, 0] == strip) & (ids[:, 1] == tile))[0])
        inside = np.minimum(np.minimum(x - box[mine, 0], box[mine, 1] - x), np.minimum(y - box[mine, 2], box[mine, 3] - y))
        open_ = np.flatnonzero((reach < 0) | (reach > inside))  # the others can't reach beyond their tile
        at, to = _touching(x[open_], y[open_], np.where(reach[open_] < 0, _FAR // 2, reach[open_] - 1), box)
        at, to = open_[at[to != mine]], to[to != mine]
        n, m = len(x), len(at)
        sent = np.zeros(n, bool)
        sent[at] = True
        hold = pa.array(np.where(sent, np.arange(n), -1), mask=~sent)
        lists = [pa.chunked_array([v.take(hold), pa.nulls(m, v.type)]) for v in (d, dw)]
        return pa.table({
            "key": pa.array([key] * (n + m), t.schema.field("key").type), "strip": pa.array(np.concatenate([np.full(n, strip), ids[to, 0]])), "tile": pa.array(np.concatenate([np.full(n, tile), ids[to, 1]])),
            "x": pa.array(np.concatenate([x, x[at]])), "y": pa.array(np.concatenate([y, y[at]])), "w": pa.array(np.concatenate([w, w[at]])),
            "reach": pa.array(np.concatenate([reach, reach[at]])), "home": pa.array(np.arange(n + m) < n), "sent": pa.array(np.concatenate([sent, np.ones(m, bool)])),
            "d": lists[0].combine_chunks(), "dw": lists[1].combine_chunks()})

    return run


def _visited(k: int):
    """Per visitor its neighbours in the tile, up to its reach."""

    def run(visitors: pa.Table, t: pa.Table) -> pa.Table:
        if not visitors.num_rows or not t.num_rows:
            return pa.table({"key": visitors.column("key").slice(0, 0), "x": pa.array([], pa.int64()), "y": pa.array([], pa.int64()),
                             "d": pa.array([], pa.list_(pa.int64())), "dw": pa.array([], pa.list_(pa.int64()))})
        x, y, reach = (visitors.column(c).to_numpy() for c in ("x", "y", "reach"))
        px, py, pw = (t.column(c).to_numpy() for c in ("px", "py", "pw"))
        order, starts = _cells(px, py)
        near, _ = _cells(x, y)
        reach = np.where(reach < 0, _FAR // 2, reach)
        _, d, dw = _within(x[near], y[near], reach[near], px[order], py[order], pw[order], starts, k)
        return pa.table({"key": visitors.column("key"), "x": pa.array(x[near]), "y": pa.array(y[near]), "d": d, "dw": dw})

    return run


def neighbour_reach(points: DataFrame, k: int = 3) -> DataFrame:
    """``(key, x, y, w, reach)``: the distance to the ``k``-th nearest other point, in the maximum norm.

    ``points`` are (key, x, y, w): distinct integer points of a key with their numbers of rows. Copies are at
    distance 0 of each other. A key with ``k`` rows or fewer has reach -1.
    """
    spark = points.sparkSession
    points = stored(points.select("key", "x", "y", F.col("w").cast("long").alias("w")))
    size = max(TILE, math.ceil(points.count() / MAX_TILES))
    strips = F.ceil(F.sqrt(F.col("_n") / size))
    r = rank_within_groups(points, ["key"], ["x", "y"]).withColumn("strip", F.floor(F.col("_rank") * strips / F.col("_n"))).drop("_rank", "_n")
    r = rank_within_groups(r, ["key", "strip"], ["y", "x"]).withColumn("tile", F.floor(F.col("_rank") * F.ceil(F.col("_n") / size) / F.col("_n"))).drop("_rank", "_n")
    tiles = stored(r)
    place = ["key", "strip", "tile"]
    held: dict[str, list] = {}
    for b in tiles.groupBy(*place).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).toLocalIterator():  # MAX_TILES at most, about
        held.setdefault(b[0], []).append(tuple(b)[1:])
    boxes = spark.sparkContext.broadcast({key: ((a := np.array(rows, dtype=np.int64))[:, :2], a[:, 2:]) for key, rows in held.items()})
    keys = dict(points.dtypes)["key"]
    kind = f"key {keys}, strip bigint, tile bigint, x bigint, y bigint, w bigint, reach bigint, home boolean, sent boolean, d array<bigint>, dw array<bigint>"
    own = stored(tiles.groupBy(*place).applyInArrow(_own(boxes, k), kind))
    t = tiles.select(*[F.col(c).alias(f"p{c}") for c in (*place, "x", "y", "w")])
    met = own.where("NOT home").select(*place, "x", "y", "reach").groupBy(*place).cogroup(t.groupBy(*[f"p{c}" for c in place])).applyInArrow(
        _visited(k), f"key {keys}, x bigint, y bigint, d array<bigint>, dw array<bigint>")
    near = own.where("home AND sent").select("key", "x", "y", "w", "d", "dw").unionByName(met.withColumn("w", F.lit(None).cast("long")))
    pairs = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "dw"))))
    merged = near.groupBy("key", "x", "y").agg(F.max("w").alias("w"), pairs.alias("p"))
    step = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("r"))
    reach = F.aggregate("p", step, lambda s, v: F.struct((s["n"] + v["dw"]).alias("n"), F.when((s["n"] <= k) & (s["n"] + v["dw"] > k), v["d"]).otherwise(s["r"]).alias("r")))
    return own.where("home AND NOT sent").select("key", "x", "y", "w", "reach").unionByName(merged.select("key", "x", "y", "w", reach["r"].alias("reach")))


def _information(rows: DataFrame, at: str) -> DataFrame:
    """(key, s): the sum of psi(n) over the key's rows, n the rows within ``r`` of one in this coordinate, by one sorted running sum.

    A point asks for the rows up to both ends of its range; only the ends and the distinct values are sorted.
    """
    side = F.explode(F.array(F.struct((F.col(at) + F.col("r")).alias("v"), F.lit(1).alias("sign")), F.struct((F.col(at) - F.col("r") - 1).alias("v"), F.lit(-1).alias("sign"))))
    ask = rows.withColumn("q", F.monotonically_increasing_id()).select("key", "q", F.col("w").alias("qw"), side.alias("s")).select("key", "q", "qw", "s.v", "s.sign", F.lit(0).cast("long").alias("w"))
    none = F.lit(None).cast("long")
    have = rows.groupBy("key", F.col(at).alias("v")).agg(F.sum("w").alias("w")).select("key", none.alias("q"), none.alias("qw"), "v", F.lit(0).alias("sign"), "w")
    below = running_sum(ask.unionByName(have), ["key"], ["v", F.col("sign") != 0], "w", "below").where("sign <> 0")
    n = below.groupBy("key", "q", "qw").agg(F.sum(F.col("sign") * F.col("below")).alias("n"))
    return n.groupBy("key").agg(F.sum(F.col("qw") * _digamma(F.col("n"))).alias("s"))


def _digamma(n: Column) -> Column:
    """psi of a whole number: the recurrence up to 10, then the asymptotic series (error below 1e-13)."""
    z = F.greatest(n, F.lit(10)).cast("double")
    tail = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - 1 / (132 * z**10)
    missing = F.aggregate(F.when(n < 10, F.sequence(n.cast("long"), F.lit(9).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + 1 / i)
    return tail - missing


def mutual_information(df: DataFrame, cols: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """``(feature, mutual_info)`` of every column with ``target``, by Kraskov's nearest-neighbour estimate over all rows.

    Rows with a missing value in one of the columns are left out, as are NaN and infinite ones. Columns are brought to mean 0 and deviation 1 on
    a grid of 2^-32; a constant column has information 0. With ``r`` the distance to the ``k``-th neighbour in the larger of
    both coordinates, the estimate is psi(n) + psi(k) minus the mean of psi(n_x) + psi(n_y), where n_x and n_y count the rows
    (itself included) nearer than ``r`` in one coordinate, or equal if ``r`` is 0; at least 0.
    """
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)], F.col(f"`{target}`").cast("double").alias("t"))
    names = [f"c{i}" for i in range(len(cols))]
    whole = F.lit(True)
    for c in [*names, "t"]:
        whole = whole & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    d = d.where(whole)
    st = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in [*names, "t"]], *[F.stddev_pop(c).alias(f"s_{c}") for c in [*names, "t"]]).first()
    n = st["n"]
    spark = df.sparkSession
    flat = [c for c in names if n <= k or not st[f"s_{c}"] or not st["s_t"]]
    base = spark.createDataFrame([(cols[int(c[1:])], 0.0) for c in flat], "feature string, mutual_info double")
    rest = [c for c in names if c not in flat]
    if not rest:
        return base
    grid = lambda c: F.round((F.col(c) - st[f"m_{c}"]) / st[f"s_{c}"] * GRID).cast("long")
    long = d.select(F.explode(F.array(*[F.struct(F.lit(int(c[1:])).alias("key"), grid(c).alias("x"), grid("t").alias("y")) for c in rest])).alias("p")).select("p.*")
    points = long.groupBy("key", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    rows = stored(neighbour_reach(points, k).withColumn("r", F.greatest(F.col("reach") - 1, F.lit(0))))
    psi = lambda v: float(spark.range(1).select(_digamma(F.lit(v))).first()[0])
    top = psi(n) + psi(k)
    both = _information(rows, "x").unionByName(_information(rows, "y")).groupBy("key").agg(F.sum("s").alias("s"))
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("key") + 1)
    mi = both.select(name.alias("feature"), F.greatest(F.lit(top) - F.col("s") / n, F.lit(0.0)).alias("mutual_info"))
    return mi.unionByName(base)


# nearest rows in any number of dimensions (M9) ----------------------------------
SLAB = 512


def _lead(rows: DataFrame, features: Sequence[str]) -> str:
    """The column with the largest variance; slabs along it separate rows best."""
    st = rows.agg(*[F.var_pop(f).alias(f) for f in features]).first()
    return max(features, key=lambda f: st[f] or 0.0)


def _best(qid, q, pid, p, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, ids) of the ``k`` rows of ``p`` nearest to each of ``q``, ties by id, itself left out."""
    order = np.argsort(pid, kind="stable")
    pid, p = pid[order], p[order]
    k = min(k, len(pid))
    d_out, i_out = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)
    step = max(1, _CHUNK // max(1, p.size))
    for a in range(0, len(q), step):
        d = ((q[a:a + step, None, :] - p[None, :, :]) ** 2).sum(axis=2)
        d[qid[a:a + step, None] == pid[None, :]] = np.inf
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        d_out[a:a + step], i_out[a:a + step] = np.take_along_axis(d, at, axis=1), pid[at]
    return d_out, i_out


def _found(g, ids, lead, vecs, slabs, home, sent, d, near) -> pa.Table:
    keep = np.isfinite(d) if d.size else d.astype(bool)
    offsets = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32) if d.size else np.zeros(len(ids) + 1, np.int32)
    flat = pa.StructArray.from_arrays([pa.array(d[keep] if d.size else np.zeros(0)), pa.array(near[keep] if d.size else np.zeros(0, np.int64))], names=["d", "id"])
    return pa.table({"g": pa.array([g] * len(ids), pa.string()), "slab": pa.array(slabs), "id": pa.array(ids), "lead": pa.array(lead), "vec": vecs,
                     "home": pa.array(home), "sent": pa.array(sent), "near": pa.ListArray.from_arrays(pa.array(offsets), flat)})


def _slab_own(bounds, k: int):
    def run(t: pa.Table) -> pa.Table:
        ids, lead = t.column("id").to_numpy(), t.column("lead").to_numpy()
        g, slab = t.column("g")[0].as_py(), t.column("slab")[0].as_py()
        x = np.array(t.column("vec").to_pylist(), dtype=np.float64)
        d, near = _best(ids, x, ids, x, k)
        full = np.isfinite(d).sum(axis=1) >= k
        reach = np.where(full, d[:, -1] if d.shape[1] else np.inf, np.inf)
        slabs, low, high = bounds.value[g]
        gap = np.maximum(np.maximum(low[None, :] - lead[:, None], lead[:, None] - high[None, :]), 0.0)
        touch = (gap * gap <= reach[:, None]) & (slabs[None, :] != slab)
        at, to = np.nonzero(touch)
        n = len(ids)
        sent = np.zeros(n, bool)
        sent[at] = True
        mine = _found(g, ids, lead, t.column("vec").combine_chunks(), np.full(n, slab), np.ones(n, bool), sent, d, near)
        none = np.zeros((len(at), 0))
        others = _found(g, ids[at], lead[at], t.column("vec").combine_chunks().take(pa.array(at)), slabs[to], np.zeros(len(at), bool), np.ones(len(at), bool), none, none)
        return pa.concat_tables([mine, others.cast(mine.schema)])

    return run


def _slab_visited(k: int):
    def run(visitors: pa.Table, t: pa.Table) -> pa.Table:
        ids = visitors.column("id").to_numpy()
        x = np.array(visitors.column("vec").to_pylist(), dtype=np.float64)
        d, near = _best(ids, x, t.column("pid").to_numpy(), np.array(t.column("pvec").to_pylist(), dtype=np.float64), k) if len(ids) and t.num_rows else (np.zeros((len(ids), 0)), np.zeros((len(ids), 0)))
        out = _found(None, ids, visitors.column("lead").to_numpy(), visitors.column("vec").combine_chunks(), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool), np.ones(len(ids), bool), d, near)
        return out.select(["id", "near"]).add_column(0, "g", visitors.column("g"))

    return run


def nearest_rows(df: DataFrame, id_col: str, features: Sequence[str], group_col: str, k: int = 5) -> DataFrame:
    """``(<group>, <id>, vec, near)``: the ``k`` nearest other rows of the same group, as (d, id) by distance and id.

    ``d`` is the squared Euclidean distance of the plain features, ``id_col`` a unique integer. Rows with a missing feature or
    group are left out. Every group is sorted along the feature of the largest variance and cut into slabs of about equal
    size; a row is sent to the further slabs that its ``k``-th distance so far reaches in that feature, so the result is exact.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).cast("long").alias("id"), *[F.col(f"`{f}`").cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    names = [f"f{i}" for i in range(len(features))]
    rows = stored(rows.na.drop())
    total = rows.count()
    lead = _lead(rows, names) if total else names[0]
    size = max(SLAB, math.ceil(total / MAX_TILES))
    rows = rows.select("g", "id", F.col(lead).alias("lead"), F.array(*names).alias("vec"))
    r = rank_within_groups(rows, ["g"], ["lead", "id"])
    r = stored(r.withColumn("slab", F.floor(F.col("_rank") * F.ceil(F.col("_n") / size) / F.col("_n"))).drop("_rank", "_n"))
    held: dict[str, list] = {}
    for b in r.groupBy("g", "slab").agg(F.min("lead"), F.max("lead")).toLocalIterator():  # MAX_TILES at most, about
        held.setdefault(b[0], []).append(tuple(b)[1:])
    bounds = spark.sparkContext.broadcast({g: (np.array([s for s, _, _ in v], dtype=np.int64), np.array([a for _, a, _ in v]), np.array([b for _, _, b in v])) for g, v in held.items()})
    kind = "g string, slab bigint, id bigint, lead double, vec array<double>, home boolean, sent boolean, near array<struct<d: double, id: bigint>>"
    own = stored(r.groupBy("g", "slab").applyInArrow(_slab_own(bounds, k), kind))
    t = r.select(F.col("g").alias("pg"), F.col("slab").alias("pslab"), F.col("id").alias("pid"), F.col("vec").alias("pvec"))
    met = own.where("NOT home").select("g", "slab", "id", "lead", "vec").groupBy("g", "slab").cogroup(t.groupBy("pg", "pslab")).applyInArrow(
        _slab_visited(k), "g string, id bigint, near array<struct<d: double, id: bigint>>")
    mine = own.where("home").select("g", "id", "vec", "near", "sent")
    more = mine.where("sent").select("g", "id", "near").unionByName(met).groupBy("g", "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    out = mine.where("NOT sent").select("g", "id", "vec", "near").unionByName(mine.where("sent").select("g", "id", "vec").join(more, ["g", "id"]))
    return out.withColumnsRenamed({"g": group_col, "id": id_col})
