"""Substring dedup by recompression.

A text's words are its first symbols. A round names runs of equal symbols, then
pairs of a left and a right symbol; names are hashes, so every task gives the
same run or pair the same name and the hash decides which symbols are left.
Equal stretches of text therefore get equal symbols but at their ends. With each
symbol goes the stretch of words that decided it: inside a repeated stretch,
whatever surrounds it, the same symbols come out.

Every window of ``WIDTH`` words has as its anchor the smallest of the highest
symbols that the window alone decides. Equal windows have equal anchors, so only
windows whose anchor occurs twice in the corpus can repeat; anchors are far
fewer than windows. Neighbouring windows with one anchor form a block. Equal
blocks are settled as a whole: all but the first repeat. The windows of the
first ones are then compared by their own hash in one sorted shuffle, which
settles the ends of repeats. Exact copies of a document are settled before all that.

Anchors in hot cells of a counted table of fixed size are taken as repeated
without being shuffled; that only lets more windows into the exact comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm import cells as C
from hearth.llm import words as W
from hearth.llm.graph import HOT_SHARE, cut, fitting, spread_join

Batches = Iterator[pa.RecordBatch]
WIDTH = 20
ROUNDS = 2
COUNTERS = 1 << 20
_SEGMENT = 1 << 18  # windows of a text looked at together
_U64 = np.uint64
_FAR = np.int64(1) << np.int64(60)
_K = [W.mix64(np.array([i], dtype=_U64))[0] | _U64(1) for i in range(1, 12)]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _round(sym, s, ds, de, ctx, salt: int):
    """One round over symbols: (names, first words, deciding stretches' starts and ends, contexts)."""
    n = len(sym)
    start = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
    end = np.concatenate([start[1:], [n]])
    k = (end - start).astype(_U64)
    before, after = np.maximum(start - 1, 0), np.minimum(end, n - 1)
    name = np.where(k > 1, W.mix64(sym[start] + k * _K[0]), sym[start])
    lo = np.where(start > 0, ds[before], -_FAR)
    hi = np.where(end < n, de[after], _FAR)
    mean = W.mix64(ctx[start] * _K[1] + ctx[end - 1] * _K[2] + ctx[before] * _K[3] + ctx[after] * _K[4] + k * _K[5])
    s = s[start]

    n = len(name)
    left = (W.mix64(name + _U64(salt) * _K[6]) & _U64(1)).astype(bool)
    pair = np.zeros(n, dtype=bool)
    pair[:-1] = left[:-1] & ~left[1:]
    second = np.zeros(n, dtype=bool)
    second[1:] = pair[:-1]
    i = np.flatnonzero(~second)
    paired, is_left = pair[i], left[i]
    nxt, prv = np.minimum(i + 1, n - 1), np.maximum(i - 1, 0)
    new_lo = np.where(paired | is_left, lo[i], np.where(i > 0, lo[prv], -_FAR))
    new_hi = np.where(paired | is_left, np.where(i < n - 1, hi[nxt], _FAR), hi[i])
    other = np.where(paired | is_left, mean[nxt], mean[prv])
    return (np.where(paired, W.mix64(name[i] * _K[7] + name[nxt] * _K[8]), name[i]), s[i], new_lo, new_hi,
            W.mix64(mean[i] * _K[9] + other * _K[10] + paired.astype(_U64)))


def anchors(words: np.ndarray, width: int = WIDTH, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(key, word position) of the anchor of every window of ``width`` words of hashed ``words``."""
    n = len(words) - width + 1
    place = np.arange(len(words), dtype=np.int64)
    level = (words, place, place, place + 1, words)
    levels = [level]
    for r in range(rounds):
        level = _round(*level, salt=r + 1)
        levels.append(level)
    w = np.arange(n, dtype=np.int64)
    key, pos, todo = np.zeros(n, _U64), np.zeros(n, np.int64), w
    for r in range(rounds, -1, -1):
        _, s, ds, de, ctx = levels[r]
        value = W.mix64(ctx + _U64(r))
        lo, hi = np.searchsorted(ds, todo, side="left"), np.searchsorted(de, todo + width, side="right")
        ok = hi > lo
        lo, hi, at = lo[ok], hi[ok], todo[ok]
        if len(at):
            best = [np.arange(len(value))]  # best[t][j]: leftmost smallest of value[j : j + 2^t]
            while 1 << len(best) <= int((hi - lo).max()):
                half = 1 << (len(best) - 1)
                a, b = best[-1][:-half], best[-1][half:]
                best.append(np.where(value[a] <= value[b], a, b))
            t = np.log2(hi - lo).astype(np.int64)
            a, b = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            for j in range(len(best)):
                m = t == j
                a[m], b[m] = best[j][lo[m]], best[j][hi[m] - (1 << j)]
            j = np.where(value[a] <= value[b], a, b)
            key[at], pos[at] = value[j], s[j]
        todo = todo[~ok]
    return key, pos


def _sequences(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """One hash of each text's word sequence; 0 for no word."""
    n = np.diff(of)
    place = (np.arange(len(hashes)) - np.repeat(of[:-1], n)).astype(_U64) * _K[0]
    total = np.concatenate([np.zeros(1, _U64), np.cumsum(W.mix64(hashes + place))])
    return np.where(n > 0, W.mix64(total[of[1:]] - total[of[:-1]] + n.astype(_U64)), _U64(0)).view(np.int64)


def _chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, n+1 offsets of each text's words) of bounded groups of texts."""
    data, offsets = W.texts_of(column)
    for a, b in W.chunks(offsets, 1 << 20):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, of = W.word_bounds(part, at)
        yield a, W.word_hashes(part, starts, ends, lower=False), of


class Windows:
    """All windows of a chunk of texts: flat arrays over windows, text by text.

    The texts go through together, one made-up word after each. No window that
    holds it is used, and a window's anchor is its own matter, so neither
    neighbours nor the cut of a very long text into parts changes one.
    """

    def __init__(self, hashes: np.ndarray, of: np.ndarray, width: int):
        n = len(of) - 1
        text = np.repeat(np.arange(n), np.diff(of))
        words = np.empty(len(hashes) + n, dtype=_U64)
        words[np.arange(len(hashes)) + text] = hashes
        ends, begins = of[1:] + np.arange(n), of[:-1] + np.arange(n)
        words[ends] = W.mix64(np.arange(n, dtype=_U64) + _K[4])
        parts = [(a, *anchors(words[a:a + _SEGMENT + width - 1], width)) for a in range(0, len(words) - width + 1, _SEGMENT)]
        made = np.zeros(len(words) + 1, dtype=np.int64)
        made[ends + 1] = 1
        made = np.cumsum(made)
        start = np.flatnonzero(made[width:] == made[:-width]) if len(words) >= width else np.zeros(0, np.int64)
        self.text = made[start]
        self.at = start - begins[self.text]
        self.key = np.concatenate([p[1] for p in parts] or [np.zeros(0, _U64)])[start]
        self.pos = np.concatenate([p[0] + p[2] for p in parts] or [np.zeros(0, np.int64)])[start] - begins[self.text]
        self.hash = lambda: W.window_hashes(words, width)[start]
        change = (self.text[1:] != self.text[:-1]) | (self.key[1:] != self.key[:-1]) | (self.pos[1:] != self.pos[:-1])
        self.head = np.flatnonzero(np.concatenate([[True], change])) if len(start) else start  # first window of each block


def _digest(words: Iterator[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _documents(width: int, counters: int, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Per document its id, sequence hash, word count and digest; per task its anchor counts."""

    def run(batches: Batches) -> Batches:
        counts = C.CellCounts(counters)
        for batch in batches:
            n, seq = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, hashes, of in _chunks(batch.column("text")):
                n.append(np.diff(of))
                seq.append(_sequences(hashes, of))
                w = Windows(hashes, of, width)
                counts.add(w.key[w.head])
            sha = [_digest((t.as_py() or "").encode().split()) for t in batch.column("text")]
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(schema.field("id").type), pa.array(np.concatenate(seq)), pa.array(np.concatenate(n).astype(np.int64)),
                                              pa.array(sha, pa.string()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        rows = counts.rows()
        none = pa.nulls(len(rows))
        yield pa.RecordBatch.from_arrays([none.cast(schema.field("id").type), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.string()),
                                          pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    return run


def _anchor_rows(width: int, magnitude, hot: int) -> Callable[[Batches], Batches]:
    """(key, seq, pos) of cold anchors; a row at position -1 for a text with hot ones."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for _, hashes, of in _chunks(batch.column("text")):
                seq, w = _sequences(hashes, of), Windows(hashes, of, width)
                key, text = w.key[w.head], w.text[w.head]
                cold = magnitude.value[C.cells(key, len(magnitude.value))] < hot
                warm = seq[np.unique(text[~cold])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([key[cold].view(np.int64), warm])), pa.array(np.concatenate([seq[text[cold]], warm])),
                     pa.array(np.concatenate([w.pos[w.head][cold], np.full(len(warm), -1)]).astype(np.int32))], names=["key", "seq", "pos"])

    return run


def _block_rows(width: int, magnitude, hot: int, kind: pa.DataType) -> Callable[[Batches], Batches]:
    """(block, id, seq, first, windows) for every block whose anchor is hot or listed in ``found``."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids, wanted, found = batch.column("id").cast(kind), batch.column("seq").to_numpy(), batch.column("found")
            for a, hashes, of in _chunks(batch.column("text")):
                n = len(of) - 1
                mine = _sequences(hashes, of) == wanted[a:a + n]
                w = Windows(hashes, of, width)
                part = found.slice(a, n)
                listed = (np.repeat(np.arange(n), pc.list_value_length(part).to_numpy(zero_copy_only=False)) << 40) + part.flatten().to_numpy().astype(np.int64)
                text, end = w.text[w.head], np.append(w.head[1:], len(w.text))[:len(w.head)]
                warm = magnitude.value[C.cells(w.key[w.head], len(magnitude.value))] >= hot
                keep = mine[text] & (warm | np.isin((text << 40) + w.pos[w.head], listed))
                head, size, text = w.head[keep], (end - w.head)[keep], text[keep]
                if not len(head):
                    continue
                bounds = np.concatenate([[0], np.cumsum(size)])
                values = w.hash()[np.arange(bounds[-1]) + np.repeat(head - bounds[:-1], size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_sequences(values, bounds)), ids.take(pa.array(a + text)), pa.array(wanted[a + text]), pa.array(w.at[head].astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))], names=["block", "id", "seq", "first", "windows"])

    return run


def _runs(batches: Batches) -> Batches:
    """Each text's removed windows as few runs: those that overlap or touch become one."""
    for batch in batches:
        firsts, sizes, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [0]
        for gone in batch.column("gone"):
            a = gone.values.field("first").to_numpy().astype(np.int64)
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate((a + gone.values.field("n").to_numpy())[order])
            start = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            end = np.append(start[1:], len(a)) - 1
            firsts.append(a[start].astype(np.int32))
            sizes.append((b[end] - a[start]).astype(np.int32))
            counts.append(len(start))
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate(firsts)), pa.array(np.concatenate(sizes))], names=["first", "n"])
        yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), flat)], names=["seq", "gone"])


def _kept_rows(width: int, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """(id, seq, n_removed, kept_sha256) of texts with windows to remove, and the text that stays if the schema asks for it."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            sizes, shas, texts = [], [], []
            seq, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, hashes, of in _chunks(batch.column("text")):
                seq.append(_sequences(hashes, of))
                n.append(np.diff(of))
            same = (np.concatenate(seq) == batch.column("seq").to_numpy()).tolist()
            for t, ranges, words, ok in zip(batch.column("text"), batch.column("gone"), np.concatenate(n).tolist(), same):
                edge = np.zeros(words + 1, np.int64)
                if ok:
                    r = np.array([(x["first"], x["n"]) for x in ranges.as_py()], dtype=np.int64)
                    np.add.at(edge, r[:, 0], 1)
                    np.add.at(edge, r[:, 0] + r[:, 1] + width - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = b" ".join(compress((t.as_py() or "").encode().split(), keep.tolist()))
                sizes.append(int((~keep).sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "replace") if len(schema) > 4 else None)
            arrays = [batch.column("id").cast(schema.field("id").type), batch.column("seq"), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[:len(schema)], schema=schema).filter(pa.array(same, pa.bool_()))

    return run


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, counters: int = COUNTERS) -> DataFrame:
    """``(<id>, n_words, n_removed, kept_sha256)`` per row of ``docs``.

    A window is ``width`` consecutive words of a text. Every word covered by a
    window whose words also start earlier (smaller id, or earlier in the same
    text) is removed; the rest is joined by one space. A null, empty or short
    text has no window and keeps its words. A null id comes before all others.
    Rows that repeat an id and its words are one document and get equal results;
    different texts with one id are ordered by their hash. Other columns are not
    read.
    """
    return _removed(docs, id_col, text_col, width, counters)[0]


def shortened_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, counters: int = COUNTERS) -> DataFrame:
    """``(<id>, kept_text)`` of the first document of every word sequence that loses some words, by the same rule."""
    return _removed(docs, id_col, text_col, width, counters, texts=True)[1].select(F.col("id").alias(id_col), "kept_text")


def _removed(docs: DataFrame, id_col: str, text_col: str, width: int, counters: int, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType
    arrow, sql = to_arrow_type(kind), kind.simpleString()
    schema = pa.schema([("id", arrow), ("seq", pa.int64()), ("n", pa.int64()), ("sha", pa.string()), ("cell", pa.int32()), ("counts", pa.binary())])
    rows = cut(d.mapInArrow(_documents(width, counters, schema), f"id {sql}, seq bigint, n bigint, sha string, cell int, counts binary"))
    own = rows.where("cell IS NULL").select("id", "seq", "n", "sha")
    table, hot = C.magnitudes(rows.where("cell IS NOT NULL").select("cell", "counts"), counters)
    magnitude = spark.sparkContext.broadcast(table)
    total = own.count()

    # documents: the first of each word sequence is looked at, later copies go whole
    first = cut(own.where(F.col("n") >= width).groupBy("seq").agg(F.min(F.struct("id")).alias("first"), F.count(F.lit(1)).alias("rows"))
                .select("seq", F.col("first.id").alias("first_id"), "rows"))

    # anchors that occur at two places
    of = Window.partitionBy("key")
    spot = F.struct("seq", "pos")
    found = d.select("text").mapInArrow(_anchor_rows(width, magnitude, hot), "key bigint, seq bigint, pos int")
    found = found.withColumn("again", F.min(spot).over(of) != F.max(spot).over(of)).where("again OR pos < 0")
    found = found.groupBy("seq").agg(F.collect_set("pos").alias("found"))
    wanted = cut(found.join(first.select("seq", "first_id"), "seq").select(F.col("first_id").alias("wid"), "seq", "found"))
    wanted = fitting(wanted, size=F.size("found") * 4 + 32)
    blocks = cut(d.join(wanted, d.id.eqNullSafe(wanted.wid)).select("id", "text", "seq", "found").mapInArrow(
        _block_rows(width, magnitude, hot, arrow), f"block bigint, id {sql}, seq bigint, first bigint, windows array<bigint>"))

    # blocks: all but the first of equal ones go; windows of the first ones are compared
    where = F.struct("id", "seq", "first")
    distinct = cut(blocks.groupBy("block").agg(F.min(where).alias("top"), F.min_by("windows", where).alias("windows"), F.count(F.lit(1)).alias("k")))
    same = distinct.where("k > 1").select("block", "top", "k")
    narrow = blocks.select("block", "id", "seq", "first", F.size("windows").alias("n"))
    later = spread_join(narrow, same, "block", F.col("k") * HOT_SHARE >= blocks.count()).where(F.col("top").isNotNull() & ~where.eqNullSafe(F.col("top")))
    gone = later.select("seq", F.col("first").cast("int").alias("first"), "n")
    windows = distinct.select("top.*", F.posexplode("windows").alias("p", "window")).select(
        "window", "id", "seq", (F.col("first") + F.col("p")).alias("first"))
    later = windows.withColumn("top", F.min(where).over(Window.partitionBy("window"))).where(~where.eqNullSafe(F.col("top")))
    gone = gone.union(later.select("seq", F.col("first").cast("int"), F.lit(1)))

    # words
    gone = gone.groupBy("seq").agg(F.collect_set(F.struct("first", "n")).alias("gone")).mapInArrow(_runs, "seq bigint, gone array<struct<first: int, n: int>>")
    gone = gone.join(first.select("seq", "first_id"), "seq")
    gone = fitting(cut(gone.select(F.col("first_id").alias("wid"), "seq", "gone")), size=F.size("gone") * 12 + 32)
    out = pa.schema([("id", arrow), ("seq", pa.int64()), ("removed", pa.int64()), ("kept", pa.string())] + [("kept_text", pa.string())] * texts)
    some = cut(d.join(gone, d.id.eqNullSafe(gone.wid)).select("id", "text", "seq", "gone").mapInArrow(
        _kept_rows(width, out), f"id {sql}, seq bigint, removed bigint, kept string" + ", kept_text string" * texts).dropDuplicates(["seq"]))

    label = cut(first.join(some.select("seq", "removed", "kept"), "seq", "left"))
    placed = spread_join(own.where(F.col("n") >= width), label, "seq", F.col("rows") * HOT_SHARE >= total)
    is_first = F.col("id").eqNullSafe(F.col("first_id"))
    result = placed.select("id", "n", F.when(~is_first, F.col("n")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("r"),
                           F.when(~is_first, F.lit(_EMPTY)).otherwise(F.coalesce("kept", "sha")).alias("k"))
    result = result.union(own.where(F.col("n") < width).select("id", "n", F.lit(0).cast("long"), "sha"))
    return result.select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.col("r").alias("n_removed"), F.col("k").alias("kept_sha256")), some
