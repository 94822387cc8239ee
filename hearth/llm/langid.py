"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's most frequent letter n-grams (one to
three letters, word edges as a space), counted over all training documents. A
document's own most frequent n-grams are compared with each profile by the
out-of-place distance: the sum of rank differences, an n-gram that the profile
lacks counting as the profile's length. The nearest language wins.

Only the profiles (``PROFILE`` n-grams a language) reach the driver and the
tasks; predicting shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
UNKNOWN = "und"
PROFILE = 300
_FLUSH = 1 << 18
_BLOCK = 1 << 20  # characters of a text counted at once
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def _normal(text: str) -> np.ndarray:
    """Code points in lower case, every run without letters as one space, a space at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[np.minimum(c, 0xFFFF)]
    high = c > 0xFFFF
    if high.any():
        letter[high] = [chr(x).isalpha() for x in c[high]]
    c = np.concatenate([[_SPACE], np.where(letter, c, _SPACE), [_SPACE]])
    space = c == _SPACE
    return c[~(space & np.concatenate([[False], space[:-1]]))]


def _codes(c: np.ndarray) -> np.ndarray:
    """The n-grams of normalised code points, 21 bits a character; a space only at an n-gram's ends."""
    two = c[:-1] | (c[1:] << 21)
    three = two[:-1] | (c[2:] << 42)
    return np.concatenate([c[c != _SPACE], two, three[c[1:-1] != _SPACE]])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes)).astype(np.int64)


def count_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams in ascending order, counts) of a whole text; none if it has no letter."""
    c = _normal(text)
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(c) <= _BLOCK:
        return np.unique(_codes(c), return_counts=True)
    parts, a = [], 0
    while a < len(c) - 1:  # blocks end at a space, which the next one starts with
        spaces = np.flatnonzero(c[a + _BLOCK:] == _SPACE)
        b = a + _BLOCK + int(spaces[0]) if len(spaces) and a + _BLOCK < len(c) else len(c) - 1
        parts.append(np.unique(_codes(c[a:b + 1]), return_counts=True))
        a = b
    return _merge(parts)


def _count_rows(batches: Batches) -> Batches:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out():
        rows = [(lang, *_merge(parts)) for lang, parts in held.items()]
        held.clear()
        for lang, codes, n in rows:
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "gram", "n"])

    for batch in batches:
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            codes, n = count_ngrams(text.as_py())
            if len(codes):
                held.setdefault(lang, []).append((codes, n))
                size += len(codes)
            if size > _FLUSH:
                held = {k: [_merge(v)] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > _FLUSH // 2:
                    yield from out()
                    size = 0
    yield from out()


def fit_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", length: int = PROFILE) -> dict[str, list[int]]:
    """``{language: its n-grams, most frequent first}`` from all rows with text and language.

    Counts are exact; equal counts are ordered by the n-gram's code. Rows with a
    null text or language teach nothing.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_count_rows, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    out: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda r: (r.lang, r.rank)):
        out.setdefault(row.lang, []).append(row.gram)
    return out


class Ranker:
    """Out-of-place distances of one document to every profile."""

    def __init__(self, profiles: dict[str, list[int]], length: int):
        self.langs, self.length = sorted(profiles), length
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, np.array(profiles[lang], dtype=np.int64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, n = count_ngrams(text or "")
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        mine = codes[np.argsort(-n, kind="stable")[:self.length]]
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == mine, self.ranks[:, at], -1)
        apart = np.where(ranks < 0, self.length, np.abs(ranks - np.arange(len(mine)))).sum(axis=1)
        best = int(np.argmin(apart))
        return self.langs[best], float(1 - apart[best] / (self.length * len(mine)))


def identify_language(df: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", length: int = PROFILE) -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (1 - distance / largest possible distance).

    ``und`` with score 0 for a null text, one without letters, or if no language
    was learned. Equal distances go to the language that sorts first. Columns
    named like the new ones are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast((profiles, length))
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n in kept), "lang_pred string", "score double"])

    def run(batches: Batches) -> Batches:
        ranker = Ranker(*shared.value)
        for batch in batches:
            found = [ranker.predict(t.as_py()) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64())], names=[*kept, "lang_pred", "score"])

    return df.mapInArrow(run, schema)
