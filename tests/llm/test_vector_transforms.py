"""Whitening and vector codes against numpy and plain integer k-means; odd vectors, ties, repeated rows, other columns."""

import hashlib
import math

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int, n string, code int, x string, index string, id int"


def rows_of(n=150, d=16, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, (r.normal(size=d) * np.linspace(1, 3, d)).tolist(), [0, 1, None][i % 3]) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(60)]  # a third of all rows is one vector
    rows += [(2000, None, 0), (2001, [math.nan] + [1.0] * (d - 1), 0), (2002, [None] + [1.0] * (d - 1), 0), (2003, [-math.inf] + [1.0] * (d - 1), 0), (2004, [], 0),
             (2005, [1.0] * 8, 0), (None, rows[5][1], 0), (7, rows[7][1], 0), (7, rows[8][1], 0), (2006, [0.0] * d, None), (2007, [-0.003] * d, 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 5, "x", "i", 3) for r in rows], SCHEMA).repartition(3)


def kept(rows, d=16):
    return [r for r in rows if r[1] is not None and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]


def brute_whitening(rows, keep=16):
    """[(id, deviation, values)], shares: by numpy over the distinct integer vectors."""
    x = np.array([[math.floor(64 * c) + 10**6 for c in r[1]] for r in rows], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = (n * fit - s) / n
    e, w = np.linalg.eigh(z.T @ z / n)
    e, w = e[::-1], w[:, ::-1]
    off = n * x - s
    return n, (off**2).sum(axis=1), (off / n) @ w[:, :keep] / np.sqrt(e[:keep]), e[:keep] / e.sum()


def test_whitening(spark, monkeypatch):
    from hearth.llm import whitening as W

    monkeypatch.setattr(W, "BLOCK_ROWS", 16)  # many row blocks, many splits of the sum
    monkeypatch.setattr(W, "BLOCKS_PER_TASK", 2)
    rows = rows_of()
    good = kept(rows)
    n, deviation, values, share = brute_whitening(good)
    out = W.whiten(frame(spark, rows)).collect()
    assert len(out) == 16 * len(good) and {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-9
    of = {}
    for r in sorted(out, key=lambda r: r.component):
        of.setdefault((r.vec_id, r.deviation), []).append(r)
    sign = {}
    for (i, _, _), dev, v in zip(good, deviation.tolist(), values):
        mine = of[i, dev]
        assert len(mine) % 16 == 0
        for r in mine:
            assert abs(abs(r.whitened) - abs(v[r.component - 1])) < 1e-7
            assert abs(r.explained / share[r.component - 1] - 1) < 1e-9
            if abs(r.whitened) > 1e-3:
                sign.setdefault(r.component, set()).add(bool(r.whitened * v[r.component - 1] > 0))
    assert all(len(s) == 1 for s in sign.values())


def test_whitening_without_variance(spark):
    from hearth.llm.whitening import whiten

    assert whiten(frame(spark, [])).collect() == []
    assert whiten(frame(spark, [(1, None, 0), (2, [math.nan, 1.0], 0)])).collect() == []
    one = whiten(frame(spark, [(1, [0.5, 0.25], 0), (2, [0.5, 0.25], 0)])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4
    flat = whiten(frame(spark, [(i, [float(i), 2.0 * i], 0) for i in range(9)])).collect()  # one direction only
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and flat[0].identity_error < 1e-9
    huge = whiten(frame(spark, [(1, [2.0**45, 1.0], 0), (2, [-(2.0**45), 2.0], 0), (3, [0.0, 9.0], 0), (4, [2.0**46, 1.0], 0)])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and {r.deviation for r in huge if r.vec_id != 3} == {None}


def brute_codes(rows, parts=8, entries=16, rounds=6):
    """Plain integer k-means a part; ([(id, label, code, error)], digest of the codebooks)."""
    x = [(r[0], r[2], [math.floor(4096 * c) for c in r[1]]) for r in rows]
    w = len(x[0][2]) // parts
    first = sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    code, error, flat = [""] * len(x), [0] * len(x), []
    for p in range(parts):
        sub = [r[2][p * w:(p + 1) * w] for r in x]
        book = [r[2][p * w:(p + 1) * w] for r in first]
        near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))  # noqa: E731, B023
        for _ in range(rounds):
            home = [near(v)[1] for v in sub]
            for k in range(len(book)):
                mine = [v for v, h in zip(sub, home) if h == k]
                if mine:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine)]
        for i, v in enumerate(sub):
            d, k = near(v)
            code[i] += f"{k:02x}"
            error[i] += d
        flat += [c for e in book for c in e]
    return [(r[0], r[1], c, e) for r, c, e in zip(x, code, error)], hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


@pytest.mark.parametrize("block, leaf", [(4096, 48), (40, 3)])
def test_vector_codes(spark, monkeypatch, block, leaf):
    from hearth.llm import vector_codes as V

    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    monkeypatch.setattr(V, "LEAF", leaf)
    rows = rows_of()
    want, digest = brute_codes(kept(rows))
    coded, books = V.encode_vectors(frame(spark, rows))
    assert V.books_sha256(books) == digest
    out = V.with_label_errors(coded).collect()
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in out), key=repr) == sorted(want, key=repr)
    total = {lab: sum(e for _, g, _, e in want if g == lab) for lab in (0, 1, None)}
    assert all(r.label_error == total[r.label] for r in out)


def test_vector_codes_of_few_and_odd_rows(spark):
    from hearth.llm import vector_codes as V

    for rows in ([], [(1, None, 0), (2, [math.nan] * 8, 0)]):
        coded, books = V.encode_vectors(frame(spark, rows))
        assert V.with_label_errors(coded).collect() == [] and books == []
    same = [(i, [0.5] * 8, None) for i in range(40)]
    coded, books = V.encode_vectors(frame(spark, same))
    assert {(r.code, r.error) for r in coded.collect()} == {("00" * 8, 0)} and books[0].shape == (16, 1)
    few = [(i, [float(i)] * 8, i) for i in range(3)]
    assert sorted(tuple(r) for r in V.encode_vectors(frame(spark, few))[0].collect()) == sorted(brute_codes(few)[0])
    with pytest.raises(ValueError):
        V.encode_vectors(frame(spark, [(1, [1.0] * 9, 0)]))


def test_trees_own_balls_and_lose_no_point():
    from hearth.llm import vector_codes as V

    r = np.random.default_rng(4)
    points = np.concatenate([r.integers(-40, 40, size=(900, 3)) + c for c in ([0, 0, 0], [900, 0, 0], [0, 4000, 0])]).astype(np.int64)
    nodes, order = V.metric_tree(points, 16)
    assert sorted(order.tolist()) == list(range(len(points))) and nodes["count"][0] == len(points)
    assert (nodes["sums"][0] == points.sum(axis=0)).all() and ((nodes["left"] < 0) == (nodes["right"] < 0)).all()
    entries = np.array([[0, 0, 0], [900, 0, 0], [0, 4000, 0], [900, 0, 0], [5, 0, 0]])
    ball, of, rest, near = V.descend(nodes, points[order], entries)
    home = np.full(len(points), -1)
    for b, k in zip(ball, of):
        assert (home[nodes["low"][b]:nodes["high"][b]] == -1).all()
        home[nodes["low"][b]:nodes["high"][b]] = k
    home[rest] = near
    assert (home == ((points[order][:, None] - entries) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert nodes["count"][ball].sum() >= 1800 and len(ball) < 60  # the far groups go as whole balls


def test_work_of_the_trees_over_the_table(spark):
    """The registered query gives the brute-force codes of the given table."""
    from hearth.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = brute_codes(rows)
    out = QUERIES["op13_vector_codes"](spark, SF).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in out) == sorted((i, c, e) for i, _, c, e in want) and {r.codebooks_sha256 for r in out} == {digest}
    whitened = QUERIES["op11_embedding_whitening"](spark, SF).collect()
    assert len(whitened) == 16 * len(rows) and whitened[0].identity_error < 1e-9
