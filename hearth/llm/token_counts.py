"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

The text is normalised as the vocabulary asks (spaces as U+2581, one in front)
and falls into units that no piece crosses: a run of U+2581 with what follows
up to the next one, cut at line feeds if no piece holds one. In a unit, an
Aho-Corasick automaton enumerates every piece at every place; dynamic
programming carries the best score and its number of pieces, nothing else.

Tie rule: of equally good ways to reach a place the one whose last piece is
longest wins, as in the tokenizer's forward pass (a later candidate must be
strictly better, and longer pieces come first). A character without a piece of
its own may stand alone at the lowest score less 10 and counts as its UTF-8
bytes. Scores add up in double precision, unit by unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

Batches = Iterator[pa.RecordBatch]
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MAX_UNITS = 800_000  # units in a task's table, then it starts anew
_LONG_UNIT = 64


class Counter:
    """Best score and piece count of texts under one vocabulary file; held once per Python worker."""

    def __init__(self, pieces: dict[str, float], dummy_prefix: bool = True):
        import ahocorasick

        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another character")
        self.pieces, self.prefix = pieces, SPACE if dummy_prefix else ""
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.find = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.find.add_word(p, (len(p), score))
        self.find.make_automaton()
        self.lines = not any("\n" in p and len(p) > 1 for p in pieces)
        self.unit = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, tuple[float, int]] = {}

    def viterbi(self, unit: str) -> tuple[float, int]:
        """(score, pieces) of the best way through ``unit``."""
        n = len(unit)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, found in self.find.iter(unit) if self.pieces else ():
            ends[end].append(found)
        for i in range(n):
            top, pieces, alone = None, 0, False
            for size, score in sorted(ends[i], reverse=True):
                alone |= size == 1
                score += best[i + 1 - size]
                if top is None or score > top:
                    top, pieces = score, count[i + 1 - size] + 1
            if not alone:
                score = best[i] + self.unknown
                if top is None or score > top:
                    top, pieces = score, count[i] + len(unit[i].encode())
            best[i + 1], count[i + 1] = top, pieces
        return best[n], count[n]

    def count(self, text: str) -> tuple[float, int]:
        """(score, pieces) of a whole text, unit by unit."""
        score, pieces = 0.0, 0
        known = self.known
        for m in self.unit.finditer(self.prefix + text.replace(" ", SPACE) if text else ""):
            unit = m.group()
            got = known.get(unit)
            if got is None:
                got = self.viterbi(unit)
                if len(unit) <= _LONG_UNIT:
                    if len(known) >= MAX_UNITS:
                        known.clear()
                    known[unit] = got
            score += got[0]
            pieces += got[1]
        return score, pieces


def read_vocabulary(model: str) -> tuple[dict[str, float], bool]:
    """(pieces and scores of a SentencePiece model file, whether it puts a space in front of a text)."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    if not any(p.is_byte(i) for i in range(p.get_piece_size())):
        raise ValueError(f"{model} has no byte pieces")
    pieces = {p.id_to_piece(i): p.get_score(i) for i in range(p.get_piece_size())
              if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
    return pieces, p.encode("x", out_type=str)[0].startswith(SPACE)


@cache
def counter(model: str) -> Counter:
    return Counter(*read_vocabulary(model))


def count_tokens(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` and ``score`` of every whole text under the vocabulary in ``model``.

    The file must be there on every worker. Null and empty texts have no token
    and score 0. Nothing is shuffled. Columns named like the new ones are
    replaced.
    """
    kept = [c for c in df.columns if c not in ("n_tokens", "score")]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n in kept), "n_tokens bigint", "score double"])

    def run(batches: Batches) -> Batches:
        c = counter(model)
        for batch in batches:
            found = [c.count(t.as_py() or "") for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array([f[1] for f in found], pa.int64()),
                                              pa.array([f[0] for f in found], pa.float64())], names=[*kept, "n_tokens", "score"])

    return df.mapInArrow(run, schema)
