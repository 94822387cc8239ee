"""Vector code compression with anchors-hierarchy metric trees over parts.

Vectors become integers and are cut into equal parts; each part position has a
codebook of integer entries, improved by rounds of assignment and averaging. A
block of rows gets one metric tree for each part position: anchors take over
the points nearest to them, as far as the triangle inequality leaves a choice;
from these balls in the middle the tree grows upwards by joining the closest
ones and downwards by new anchors inside each. Every ball caches the count and
the component sums of its points. The trees are written once.

A round goes down the trees with the list of entries that can still be nearest
to some point of a ball. A child starts with what its parent left; as soon as
one entry is left, the ball is its own as a whole and the cached sums count,
without a look at a point. Only points of leaves that are never owned as a
whole are compared one by one, in exact integers. A task gives out the sums of
all its trees, so a round shuffles a few numbers a task, whatever the rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.graph import HOT_SHARE, cut, spread_join
from hearth.llm.whitening import common_length, usable

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
BLOCK_ROWS = 4096
LEAF = 48
_SLACK = 1e-9


def _anchors(x: np.ndarray, k: int) -> np.ndarray:
    """The anchor of each row of ``x``, of ``k`` anchors at most."""
    owner = np.zeros(len(x), np.int64)
    far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    at = [0]
    while len(at) < k:
        new = int(far.argmax())  # the farthest point of the widest anchor
        if far[new] == 0:
            break
        gap = np.sqrt(((x[at] - x[new]) ** 2).sum(axis=1))
        open_ = np.flatnonzero(2 * far > gap[owner])  # nearer points can't change hands
        d = np.sqrt(((x[open_] - x[new]) ** 2).sum(axis=1))
        won = d < far[open_]
        owner[open_[won]], far[open_[won]] = len(at), d[won]
        at.append(new)
    return owner


def _join(parts: list) -> tuple:
    """One binary tree over ``parts``, the two that make the smallest ball joined first."""
    size = np.array([p[1] for p in parts], dtype=np.float64)
    centre = np.array([p[2] for p in parts])
    radius = np.array([p[3] for p in parts])
    gap = np.sqrt(((centre[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2))

    def ball(i):
        share = size / (size + size[i])
        return np.maximum(gap[i] * share + radius[i], gap[i] * (1 - share) + radius)

    cost = np.array([ball(i) for i in range(len(parts))])
    cost[np.arange(len(parts)), np.arange(len(parts))] = np.inf
    for _ in range(len(parts) - 1):
        i, j = divmod(int(cost.argmin()), len(parts))
        r, total = cost[i, j], size[i] + size[j]
        centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / total
        parts[i] = ([parts[i], parts[j]], int(total), centre[i].copy(), r)
        size[i], radius[i] = total, r
        cost[j, :] = cost[:, j] = np.inf
        gap[i] = gap[:, i] = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
        gone = ~np.isfinite(cost[i])
        row = ball(i)
        row[gone] = np.inf
        cost[i] = cost[:, i] = row
    return next(p for p in parts if p[1] == int(size.max()))


def _grow(x: np.ndarray, rows: np.ndarray, leaf: int) -> tuple:
    """(rows of a leaf or the two parts, count, centre, radius) of the ball of ``rows``."""
    own = x[rows]
    centre = own.mean(axis=0)
    radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1)).max())
    if len(rows) <= leaf or radius == 0:
        return rows, len(rows), centre, radius
    owner = _anchors(own, math.isqrt(len(rows) - 1) + 1)
    groups = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner))[:-1])
    if len(groups) == 1:
        return rows, len(rows), centre, radius
    return _join([_grow(x, rows[g], leaf) for g in groups])


def node_type(width: int) -> np.dtype:
    return np.dtype([("centre", "<f8", (width,)), ("radius", "<f8"), ("sums", "<i8", (width,)), ("count", "<i8"),
                     ("low", "<i4"), ("high", "<i4"), ("left", "<i4"), ("right", "<i4")])


def metric_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, order of the points) over integer ``points``; a node's points are ``order[low:high]``, -1 is no child."""
    x = points.astype(np.float64)
    todo, nodes, order = [(_grow(x, np.arange(len(x)), leaf), -1, "left")], [], []
    laid = 0
    while todo:  # depth first, so that every ball has one run of points
        (inside, count, _, _), parent, side = todo.pop()
        at = len(nodes)
        nodes.append([laid, laid + count, -1, -1])
        if parent >= 0:
            nodes[parent][2 if side == "left" else 3] = at
        if isinstance(inside, list):
            todo += [(inside[1], at, "right"), (inside[0], at, "left")]
        else:
            order.append(inside)
            laid += count
    order = np.concatenate(order)
    out = np.zeros(len(nodes), node_type(points.shape[1]))
    for i, (low, high, left, right) in enumerate(nodes):
        own = x[order[low:high]]
        centre = own.mean(axis=0)
        radius = np.sqrt(((own - centre) ** 2).sum(axis=1)).max()
        out[i] = (centre, radius, points[order[low:high]].sum(axis=0), high - low, low, high, left, right)
    return out, order


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    size = high - low
    return np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)


def descend(nodes: np.ndarray, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owned nodes, their entry, points left over, their entry); ``points`` in the tree's order, ties to the lower entry."""
    first = np.array([not (entries[:i] == e).all(axis=1).any() for i, e in enumerate(entries)])  # a later equal entry never wins
    at, listed = np.zeros(1, np.int64), first[None, :]
    balls, ball_entry, rest, rest_listed = [], [], [], []
    while len(at):
        ball = nodes[at]
        far = np.sqrt(((ball["centre"][:, None, :] - entries[None, :, :]) ** 2).sum(axis=2))
        r = ball["radius"][:, None]
        nearest = np.where(listed, far, np.inf).min(axis=1, keepdims=True)
        listed = listed & (far - r <= nearest + r + _SLACK * (1 + nearest + r))
        owned = listed.sum(axis=1) == 1
        balls.append(at[owned])
        ball_entry.append(listed[owned].argmax(axis=1))
        leaf = ~owned & (ball["left"] < 0)
        size = ball["high"][leaf] - ball["low"][leaf]
        rest.append(_spans(ball["low"][leaf].astype(np.int64), ball["high"][leaf].astype(np.int64)))
        rest_listed.append(np.repeat(listed[leaf], size, axis=0))
        inner = ~owned & ~leaf
        at = np.concatenate([ball["left"][inner], ball["right"][inner]]).astype(np.int64)
        listed = np.concatenate([listed[inner], listed[inner]])
    rest, rest_listed = np.concatenate(rest), np.concatenate(rest_listed)
    d = ((points[rest][:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    nearest = np.where(rest_listed, d, np.iinfo(np.int64).max).argmin(axis=1) if len(rest) else np.zeros(0, np.int64)
    return np.concatenate(balls), np.concatenate(ball_entry), rest, nearest


def _trees(parts: int, leaf: int):
    """Arrow batches of (id, label, x) to one row a block with a tree for each part."""

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(a, BLOCK_ROWS)
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                made = []
                for points in np.split(x, parts, axis=1):
                    nodes, order = metric_tree(points, leaf)
                    made.append((nodes.tobytes(), order.astype("<i4").tobytes(), points[order].astype("<i8").tobytes()))
                lists = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
                         for c in (batch.column("id"), batch.column("label"))]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([list(c)], pa.list_(pa.binary())) for c in zip(*made))],
                                                 names=["ids", "labels", "nodes", "place", "points"])

    return run


def _read(row: dict, part: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["nodes"][part], node_type(width)), np.frombuffer(row["points"][part], "<i8").reshape(-1, width)


def _sums(books: list[np.ndarray]):
    """Per task the count and the component sums of every entry, as (part, entry, pos, s); position -1 is the count."""

    def run(batches):
        width = books[0].shape[1]
        total = np.zeros((len(books), len(books[0]), width + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for p, entries in enumerate(books):
                    nodes, points = _read(row, p, width)
                    ball, of, rest, nearest = descend(nodes, points, entries)
                    np.add.at(total[p], of, np.concatenate([nodes["count"][ball][:, None], nodes["sums"][ball]], axis=1))
                    np.add.at(total[p], nearest, np.concatenate([np.ones((len(rest), 1), np.int64), points[rest]], axis=1))
        part, entry, pos = (i.ravel() for i in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array((pos - 1).astype(np.int32)), pa.array(total.ravel())],
                                         names=["part", "entry", "pos", "s"])

    return run


def _codes(books: list[np.ndarray]):
    """(id, label, code, error) of every row of the blocks."""

    def run(batches):
        width = books[0].shape[1]
        for batch in batches:
            for k, row in enumerate(batch.select(["nodes", "place", "points"]).to_pylist()):
                ids, labels = batch.column("ids")[k].values, batch.column("labels")[k].values
                code, error = np.zeros((len(books), len(ids)), np.uint8), np.zeros(len(ids), np.int64)
                for p, entries in enumerate(books):
                    nodes, points = _read(row, p, width)
                    ball, of, rest, nearest = descend(nodes, points, entries)
                    low, high = nodes["low"][ball].astype(np.int64), nodes["high"][ball].astype(np.int64)
                    mine = np.zeros(len(ids), np.int64)
                    mine[_spans(low, high)] = np.repeat(of, high - low)
                    mine[rest] = nearest
                    order = np.frombuffer(row["place"][p], "<i4")
                    code[p, order] = mine
                    error[order] += ((points - entries[mine]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in np.ascontiguousarray(code.T)]), pa.array(error)],
                                                 names=["id", "label", "code", "error"])

    return run


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
                   entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``(<id>, <label>, code, error)`` per usable vector, and the final codebooks (one integer matrix a part).

    An entry x becomes floor(4096 x). Codebooks start with the parts of the
    ``entries`` (256 at most) smallest ids, null ids last and equal ids by their
    integers; with fewer rows they are shorter. Nearest is by squared Euclidean
    distance, ties to the lower index; an entry becomes the componentwise floor
    of its parts' mean, an unused one stays. ``code`` has two hex digits a part.

    Vectors that are null, empty or hold a null, non-finite or huge entry get no
    row, nor do those of another than the commonest length (ties: the longer),
    which must be a multiple of ``parts``. Huge is 2^16 / sqrt(part length) and
    more, where sums of squares could leave 64 bits. Repeated rows each get a
    row; other columns are not read. The driver holds the codebooks only.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    d = common_length(rows.where(usable(F.col("vec"), math.inf)), "vec")
    if d % parts:
        raise ValueError(f"vectors of length {d} can't be cut into {parts} equal parts")
    kinds = {n: t for n, t in rows.dtypes}
    out = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    if not d:
        return spark.createDataFrame([], out).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), []
    rows = rows.where((F.size("vec") == d) & usable(F.col("vec"), 2**16 / math.sqrt(d // parts)))
    rows = rows.select("id", "label", F.transform("vec", lambda c: F.floor(c * SCALE)).alias("x"))
    first = [r["x"] for r in rows.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()]
    if not first:
        return spark.createDataFrame([], out).select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), []
    books = np.split(np.array(first, dtype=np.int64), parts, axis=1)
    blocks = cut(rows.mapInArrow(_trees(parts, LEAF), f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, nodes array<binary>, place array<binary>, points array<binary>"))
    for _ in range(rounds):
        found = blocks.select("nodes", "points").mapInArrow(_sums(books), "part int, entry int, pos int, s bigint").groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"))
        total = np.zeros((parts, len(first), d // parts + 1), np.int64)
        for r in found.collect():  # as many numbers as the codebooks hold
            total[r["part"], r["entry"], r["pos"] + 1] = r["s"]
        books = [np.where(t[:, :1] > 0, t[:, 1:] // np.maximum(t[:, :1], 1), b) for t, b in zip(total, books)]
    coded = blocks.mapInArrow(_codes(books), out)
    return coded.select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error"), books


def books_sha256(books: list[np.ndarray]) -> str:
    """Digest of all entries' integers, part by part."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` with ``label_error``, its errors' sum over rows of the same label (null labels together; null if it leaves 64 bits)."""
    coded = cut(coded.withColumn("_lab", F.coalesce(F.concat(F.lit("v"), F.col(label_col).cast("string")), F.lit("n"))))
    total = coded.count()
    sums = cut(coded.groupBy("_lab").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows")))
    return spread_join(coded, sums, "_lab", F.col("_rows") * HOT_SHARE >= total).drop("_lab", "_rows")
