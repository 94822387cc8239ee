"""Hyper-parameter search (M2): a tree-structured Parzen sampler over finished trials, kept as an append-only table.

A trial's parameters follow from the seed, its number and the trials before it,
so a run that was killed and starts again on the same table gives the trials it
would have given. What is written after every fold is one small Parquet file in
the shared folder; the scoring itself is Spark jobs. A trial that is worse than
the median of the finished ones after a fold is stopped there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from hearth.sources.io import path_exists

STARTUP = 10  # random trials before the sampler has something to go by
GOOD_SHARE = 0.25
CANDIDATES = 24
PRUNE_AFTER = 4  # finished trials from which bad ones are stopped
SCHEMA = "trial int, fold int, params string, score double"


class Space:
    """Named ranges: (low, high, kind), kind ``int``, ``float`` or ``log``; points are in the unit cube."""

    def __init__(self, ranges: dict[str, tuple[float, float, str]]):
        self.ranges = ranges

    def values(self, unit: Sequence[float]) -> dict:
        out = {}
        for u, (name, (low, high, kind)) in zip(unit, self.ranges.items()):
            if kind == "int":
                out[name] = int(min(high, low + math.floor(u * (high - low + 1))))
            elif kind == "log":
                out[name] = float(math.exp(math.log(low) + u * (math.log(high) - math.log(low))))
            else:
                out[name] = float(low + u * (high - low))
        return out

    def unit(self, values: dict) -> list[float]:
        out = []
        for name, (low, high, kind) in self.ranges.items():
            v = values[name]
            out.append((v - low + 0.5) / (high - low + 1) if kind == "int" else (math.log(v / low) / math.log(high / low) if kind == "log" else (v - low) / (high - low)))
        return out


def _density(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Parzen density of ``x`` in one dimension of the unit interval: a flat part and a bell at every centre."""
    if not len(centres):
        return np.ones_like(x)
    width = max(0.05, 1.0 / (1 + len(centres)))
    bells = np.exp(-0.5 * ((x[:, None] - centres[None, :]) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    return (1 + bells.sum(axis=1)) / (1 + len(centres))


def suggest(space: Space, history: Sequence[tuple[dict, float]], trial: int, seed: int) -> dict:
    """Parameters of a trial; ``history`` are (params, score) of the earlier ones, lower is better."""
    rng = np.random.default_rng([seed, trial])
    dims = len(space.ranges)
    if len(history) < STARTUP:
        return space.values(rng.random(dims))
    order = np.argsort([s for _, s in history], kind="stable")
    points = np.array([space.unit(p) for p, _ in history])
    good = points[order[:max(1, math.ceil(GOOD_SHARE * len(history)))]]
    bad = points[order[len(good):]]
    at = rng.integers(0, len(good) + 1, size=(CANDIDATES, dims))  # the last one stands for the flat part
    width = max(0.05, 1.0 / (1 + len(good)))
    near = np.where(at < len(good), good[np.minimum(at, len(good) - 1), np.arange(dims)] + rng.normal(size=(CANDIDATES, dims)) * width, rng.random((CANDIDATES, dims)))
    near = np.abs(near)
    near = np.clip(np.where(near > 1, 2 - near, near), 0.0, 1.0)
    gain = sum(np.log(_density(near[:, j], good[:, j])) - np.log(_density(near[:, j], bad[:, j])) for j in range(dims))
    return space.values(near[int(np.argmax(gain))])


def read_trials(spark: SparkSession, path: str) -> dict[int, tuple[dict, dict[int, float]]]:
    """{trial: (params, {fold: score})} of a trial table; a handful of rows a trial."""
    out: dict[int, tuple[dict, dict[int, float]]] = {}
    if path_exists(spark, path):
        for r in spark.read.schema(SCHEMA).parquet(path).orderBy("trial", "fold").collect():
            out.setdefault(r["trial"], (json.loads(r["params"]), {}))[1][r["fold"]] = r["score"]
    return out


def search(spark: SparkSession, path: str, space: Space, score: Callable[[dict, int], float], folds: Sequence[int], trials: int, seed: int = 42) -> DataFrame:
    """``(trial, params, mean_score, scores, stopped)`` after ``trials`` trials; ``score(params, fold)`` is lower for better.

    Scores are appended to the table at ``path`` fold by fold; what is there already isn't scored again. While too few
    trials are finished to stop one, a trial's missing folds run side by side.
    """
    done = read_trials(spark, path)

    def keep(trial: int, params: dict, fold: int, value: float) -> None:
        spark.createDataFrame([(trial, fold, json.dumps(params, sort_keys=True), float(value))], SCHEMA).coalesce(1).write.mode("append").parquet(path)

    history: list[tuple[dict, float, dict[int, float]]] = []
    rows = []
    for t in range(trials):
        params = suggest(space, [(p, s) for p, s, _ in history], t, seed)
        scores = dict(done.get(t, (params, {}))[1])
        finished = [s for _, _, s in history if len(s) == len(folds)]
        if len(finished) < PRUNE_AFTER:
            missing = [f for f in folds if f not in scores]
            with ThreadPoolExecutor(max_workers=max(1, len(missing))) as pool:
                for f, v in zip(missing, pool.map(lambda f: score(params, f), missing)):
                    scores[f] = v
                    keep(t, params, f, v)
        else:
            for i, f in enumerate(folds):
                if f not in scores:
                    scores[f] = score(params, f)
                    keep(t, params, f, scores[f])
                so_far = folds[:i + 1]
                if i + 1 < len(folds) and np.mean([scores[g] for g in so_far]) > np.median([np.mean([s[g] for g in so_far]) for s in finished]):
                    break
        mean = float(np.mean([scores[f] for f in folds if f in scores]))
        history.append((params, mean, scores))
        rows.append((t, json.dumps(params, sort_keys=True), mean, [float(scores[f]) for f in folds if f in scores], len(scores) < len(folds)))
    return spark.createDataFrame(rows, "trial int, params string, mean_score double, scores array<double>, stopped boolean")
