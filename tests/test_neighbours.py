"""Nearest-neighbour distances and mutual information against brute force: small tiles, ties, copies, constants."""

import math
import random

import numpy as np
import pytest


def brute_mi(x, y, k=3):
    grid = lambda v: np.array([math.floor((a - np.mean(v)) / np.std(v) * 2**32 + 0.5) if (a - np.mean(v)) >= 0 else -math.floor(-(a - np.mean(v)) / np.std(v) * 2**32 + 0.5) for a in v], dtype=np.int64)
    x, y = grid(x), grid(y)
    n = len(x)
    psi = lambda m: -0.5772156649015329 + sum(1 / i for i in range(1, m))
    total = 0.0
    for i in range(n):
        d = np.maximum(np.abs(x - x[i]), np.abs(y - y[i]))
        r = max(int(np.sort(d)[k]) - 1, 0)  # the point itself is the first
        total += psi(int((np.abs(x - x[i]) <= r).sum())) + psi(int((np.abs(y - y[i]) <= r).sum()))
    return max(0.0, psi(n) + psi(k) - total / n)


def table(n=500):
    r = random.Random(6)
    rows = []
    for i in range(n):
        a = r.gauss(0, 1)
        rows.append((a, float(r.randint(1, 4)), r.choice([0.0, 0.0, 0.0, a]), 7.0, a * 2 + r.gauss(0, 0.3) if i % 9 else 0.0))
    return rows


@pytest.mark.parametrize("tile", [1024, 24])
def test_mutual_information_equals_brute_force(spark, monkeypatch, tile):
    from hearth.operators import neighbours as N

    monkeypatch.setattr(N, "TILE", tile)
    rows = table()
    odd = [(None, 1.0, 1.0, 7.0, 1.0), (math.nan, 1.0, 1.0, 7.0, 1.0), (1.0, math.inf, 1.0, 7.0, 1.0)]
    d = spark.createDataFrame(rows + odd, "a double, `b %` double, c double, d double, y double").repartition(3)
    got = {r.feature: r.mutual_info for r in N.mutual_information(d, ["a", "b %", "c", "d"], "y").collect()}
    cols = list(zip(*rows))
    want = {name: brute_mi(np.array(cols[i]), np.array(cols[4])) for i, name in enumerate(["a", "b %", "c"])} | {"d": 0.0}
    assert got.keys() == want.keys() and all(abs(got[c] - want[c]) < 1e-6 for c in want), (got, want)
    assert got["a"] > 0.5 > got["b %"]


def test_reach_of_few_and_equal_points(spark):
    from hearth.operators import neighbours as N

    pts = [("p", 0, 0, 9), ("p", 5, 1, 1), ("p", 100, -3, 1), ("q", 1, 1, 2), ("q", 2, 2, 1)]
    out = {(r.key, r.x): r.reach for r in N.neighbour_reach(spark.createDataFrame(pts, "key string, x long, y long, w long"), 3).collect()}
    assert out == {("p", 0): 0, ("p", 5): 5, ("p", 100): 100, ("q", 1): -1, ("q", 2): -1}
    few = spark.createDataFrame([(1.0, 2.0)], "a double, y double")
    assert [tuple(r) for r in N.mutual_information(few, ["a"], "y").collect()] == [("a", 0.0)]
    assert N.mutual_information(few.limit(0), ["a"], "y").first().mutual_info == 0.0


def test_few_points_leave_their_tile():
    """A tile among eight others sends only a margin on: fewer than one visit for every twenty points."""
    import types

    import pyarrow as pa

    from hearth.operators import neighbours as N

    r, side = np.random.default_rng(4), 1 << 40
    x, y = r.integers(0, side, (2, N.TILE))
    w = r.choice([1, 1, 2, 5], N.TILE)
    ids = np.array([(i, j) for i in range(-1, 2) for j in range(-1, 2)])
    box = np.array([(i * side, (i + 1) * side - 1, j * side, (j + 1) * side - 1) for i, j in ids])
    tile = pa.table({"key": [7] * N.TILE, "strip": [0] * N.TILE, "tile": [0] * N.TILE, "x": x, "y": y, "w": w})
    out = N._own(types.SimpleNamespace(value={7: (ids, box)}), 3)(tile).to_pylist()
    visits = {(p["x"], p["y"], p["strip"], p["tile"]) for p in out if not p["home"]}
    assert 0 < len(visits) < N.TILE / 20
    for p in (p for p in out if p["home"]):
        d = np.maximum(np.abs(x - p["x"]), np.abs(y - p["y"]))
        order = np.argsort(d)
        assert p["reach"] == d[order][(np.cumsum(w[order]) > 3).argmax()]
        gap = np.maximum(np.maximum(box[:, 0] - p["x"], p["x"] - box[:, 1]), np.maximum(box[:, 2] - p["y"], p["y"] - box[:, 3]))
        assert {(p["x"], p["y"], *map(int, at)) for at in ids[(gap < p["reach"]) & ids.any(axis=1)]} <= visits
