"""N-gram Jaccard join: a grouped prefix join over word shingles.

1. Every document becomes the set of 64-bit hashes of its five-word shingles.
   Equal sets form one class; the join runs on classes.
2. All shingles of all documents are counted into a table of ``counters`` fixed
   cells (its size is a parameter, it does not grow with the data). The cell's
   magnitude orders the shingles, rare ones first; any order gives the same
   links, a good one keeps frequent passages out of the prefixes.
3. Two sets that reach the threshold share at least ``min(l(x), l(y))``
   shingles within both prefixes of ``n - ceil(0.75 n) + l(n)`` shingles, with
   ``l(n) = 1 + n // 20``. Prefix shingles are shuffled once; a class with too
   few shared ones can have no partner and drops out (exact). Shingles in hot
   cells are taken as shared without being shuffled, so no key is hot there.
4. The remaining classes with identical prefix and size form a group. Each
   prefix shingle has a centre, the group whose prefix is most common; each group
   proposes the centre that it shares most prefix shingles with. Proposals are
   verified on whole sets and joined to components, which folds large families
   of near copies at linear cost.
5. Then every group pair whose members are not yet known to be together is
   filtered, expanded to its members and verified. Two sets of known sizes need
   an overlap of 3/7 of both sizes together, so enough shared shingles must lie
   within the short prefixes that this overlap leaves, and their positions must
   leave room for it. What is skipped is already connected, so the components are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm import cells as C
from hearth.llm import words as W
from hearth.llm.graph import HOT_SHARE, connected_components, cut, fitting, spread_join

WIDTH = 5
COUNTERS = 1 << 22
HOT_GROUPS = 64  # groups that share a prefix shingle from which it is joined within the strict prefixes only
PAIR_ROWS = 16  # a pair comes with both sets, so it counts as so many rows of a written table
_U64 = np.uint64

Batches = Iterator[pa.RecordBatch]


def _needed(n):
    """The overlap that a partner of a set of ``n`` must reach at least."""
    return (3 * n + 3) // 4


def _extra(n):
    return np.minimum(1 + n // 20, _needed(n))


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of an Arrow column."""
    data, offsets = W.texts_of(column)
    for a, b in W.chunks(offsets):
        part, at = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        starts, ends, of = W.word_bounds(part, at)
        hashes = W.word_hashes(part, starts, ends, lower=True)
        for i in range(b - a):
            own = hashes[of[i]:of[i + 1]]
            yield a + i, np.unique(W.window_hashes(own, min(width, len(own)))) if len(own) else own


def _class_of(shingles: np.ndarray) -> int:
    return int(W.mix64(W.mix64(shingles ^ _U64(0xA5A5A5A5)).sum(keepdims=True) + _U64(len(shingles))).view(np.int64)[0]) if len(shingles) else 0


def _signatures(width: int, counters: int, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Per document its id, set size and class; per task its shingle counts."""

    def run(batches: Batches) -> Batches:
        counts = C.CellCounts(counters)
        for batch in batches:
            n, cls = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, s in shingle_sets(batch.column("text"), width):
                n[i], cls[i] = len(s), _class_of(s)
                counts.add(s)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(schema.field("id").type), pa.array(n), pa.array(cls),
                                              none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        rows = counts.rows()
        none = pa.nulls(len(rows))
        yield pa.RecordBatch.from_arrays([none.cast(schema.field("id").type), none.cast(pa.int64()), none.cast(pa.int64()),
                                          pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], schema=schema)

    return run


def _prefix(shingles: np.ndarray, magnitude: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix shingles in the global order, their magnitudes)."""
    size = magnitude[C.cells(shingles, len(magnitude))]
    n = len(shingles)
    order = np.argsort(size, kind="stable")[:n - _needed(n) + int(_extra(n))]
    return shingles[order], size[order]


def _prefix_rows(width: int, magnitude, hot: int) -> Callable[[Batches], Batches]:
    """(token, class, surely) rows; a row of its own tells how many hot ones a set has."""

    def run(batches: Batches) -> Batches:
        sizes = magnitude.value
        for batch in batches:
            seen: set[int] = set()
            token, cls, surely = [], [], []

            def out():
                arrays = [np.concatenate(x) for x in (token, cls, surely)]
                for x in (token, cls, surely):
                    x.clear()
                return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["token", "cls", "surely"])

            held = 0
            for _, s in shingle_sets(batch.column("text"), width):
                c = _class_of(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                p, m = _prefix(s, sizes)
                keep = p[m < hot].view(np.int64)
                k = len(p) - len(keep)
                own = np.zeros(len(keep) + (k > 0), np.int32)
                if k:
                    keep = np.append(keep, np.int64(c))
                    own[-1] = k
                token.append(keep)
                cls.append(np.full(len(keep), c, np.int64))
                surely.append(own)
                held += len(keep)
                if held > 1 << 18:
                    yield out()
                    held = 0
            if held:
                yield out()

    return run


def _set_rows(width: int, magnitude) -> Callable[[Batches], Batches]:
    """(class, size, group, whole set) of the texts whose class is the one they were chosen for.

    The group is a hash of the size and the prefix. A class that several equal
    rows bring in comes once a task; a second copy would only repeat links.
    """

    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            wanted = batch.column("cls").to_pylist()
            cls, sets, group = [], [], []
            for i, s in shingle_sets(batch.column("text"), width):
                if len(s) and wanted[i] not in seen and _class_of(s) == wanted[i]:
                    seen.add(wanted[i])
                    p, _ = _prefix(s, magnitude.value)
                    cls.append(wanted[i])
                    sets.append(s.tobytes())
                    group.append(_class_of(np.append(p, _U64(len(s)))))
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array([len(x) // 8 for x in sets], pa.int64()),
                                              pa.array(group, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "n", "gid", "shingles"])

    return run


def _group_entries(magnitude) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        seen: set[int] = set()
        for batch in batches:
            for gid, raw in zip(batch.column("gid").to_pylist(), batch.column("shingles")):
                if gid in seen:
                    continue
                seen.add(gid)
                s = np.frombuffer(raw.as_py(), dtype=_U64)
                p, size = _prefix(s, magnitude.value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.view(np.int64)), pa.array(np.full(len(p), gid, np.int64)), pa.array(np.full(len(p), len(s), np.int64)),
                     pa.array(np.arange(len(p), dtype=np.int64)), pa.array(np.full(len(p), round(1000 * float(size.mean())), np.int32))],
                    names=["token", "gid", "n", "pos", "common"])

    return run


def _verify(batches: Batches) -> Batches:
    for batch in batches:
        keep = np.zeros(batch.num_rows, dtype=bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
            x, y = np.frombuffer(x.as_py(), dtype=_U64), np.frombuffer(y.as_py(), dtype=_U64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            keep[i] = 100 * both >= 75 * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))


def _linked(pairs: DataFrame, sets: DataFrame, rows: int | None = None) -> DataFrame:
    """The pairs (a, b) of classes, ``rows`` at most if given, whose whole sets reach the threshold, as a written table."""
    pairs = cut(pairs.select("a", "b").distinct(), rows)
    n_pairs = pairs.count()
    s = sets.select("cls", "shingles")
    x = s.select(F.col("cls").alias("a"), F.col("shingles").alias("x")).join(fitting(pairs), "a")
    y = s.join(fitting(cut(pairs.select(F.col("b").alias("cls")).distinct(), n_pairs)), "cls", "left_semi")
    both = x.join(y.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")
    return cut(both.select("a", "b", "x", "y").mapInArrow(_verify, "a bigint, b bigint"), PAIR_ROWS * n_pairs)


def _sized(x: str, y: str):
    """Sizes that can reach the threshold: the smaller is 3/4 of the larger at least."""
    return 4 * F.least(F.col(x), F.col(y)) >= 3 * F.greatest(F.col(x), F.col(y))


def _asked(n, m):
    """The overlap that sets of these sizes need: 3/7 of both together, rounded up."""
    return F.floor((3 * (n + m) + 6) / 7)


def _by_role(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``x`` (prefix shingles of groups) as the larger and as the smaller set of a pair.

    A set of n takes part as the larger one up to the position that its smallest partner allows, as the smaller one only up to
    the one that an equal partner allows. ``more`` further positions let the count of shared shingles tell pairs apart; a
    shingle of many groups (``HOT_GROUPS``) isn't joined there. ``spare`` is how many of them a group has: so many shared ones
    may be missing from the count. A common passage lies at the end of the prefixes of sets that are not mostly made of it, so
    it is never in the smaller role there and meets nothing.
    """
    n = F.col("n")
    more, rows = F.floor(n / 50), x.count()
    large, small = n - _asked(n, F.ceil(3 * n / 4)), n - _asked(n, n)
    many = x.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT_GROUPS).select("token", F.lit(True).alias("hot"))
    x = x.join(fitting(cut(many, rows // HOT_GROUPS)), "token", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    beyond = F.when(F.col("hot"), 0).otherwise(more)
    hidden = x.where("hot").groupBy("gid").agg(F.count_if((F.col("pos") > small) & (F.col("pos") <= large + more)).cast("int").alias("spare"))
    x = x.join(fitting(cut(hidden, rows)), "gid", "left").withColumn("spare", F.coalesce("spare", F.lit(0)))
    keep = ["token", "gid", "n", "pos", "lo", "hi", "minor", "spare"]
    return x.where(F.col("pos") <= large + beyond).select(*keep), x.where(F.col("pos") <= small + beyond).select(*keep)


def _close_pairs(x: DataFrame) -> DataFrame:
    """Pairs of groups (g, h) that share enough prefix shingles and may hold members of different components."""
    large, small = _by_role(x)
    a = large.select("token", *(F.col(c).alias(f"a_{c}") for c in ("gid", "n", "pos", "lo", "hi", "minor", "spare")))
    b = small.select("token", *(F.col(c).alias(f"b_{c}") for c in ("gid", "n", "pos", "lo", "hi", "minor", "spare")))
    apart = (F.col("a_lo") != F.col("b_lo")) | (F.col("a_lo") != F.col("a_hi")) | (F.col("b_lo") != F.col("b_hi"))
    reach = (F.least("a_pos", "b_pos") + 1 + F.least(F.col("a_n") - F.col("a_pos") - 1, F.col("b_n") - F.col("b_pos") - 1))
    asked = _asked(F.col("a_n"), F.col("b_n"))
    more = F.floor(F.least("a_n", "b_n") / 50)  # so much longer prefixes share so many more shingles
    larger = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_gid") > F.col("b_gid")))
    fits = (larger & apart & _sized("a_n", "b_n") & (F.col("a_pos") <= F.col("a_n") - asked + more) & (F.col("b_pos") <= F.col("b_n") - asked + more) & (reach >= asked))
    # two groups within their shingle's main component need no look, so one of the two is always a minor one
    pairs = a.where("a_minor").join(b, "token").where(fits).union(a.where("NOT a_minor").join(b.where("b_minor"), "token").where(fits))
    pairs = pairs.select(F.least("a_gid", "b_gid").alias("g"), F.greatest("a_gid", "b_gid").alias("h"), more.alias("more"), (F.col("a_spare") + F.col("b_spare")).alias("spare"))
    pairs = pairs.groupBy("g", "h").agg(F.count(F.lit(1)).alias("k"), F.max("more").alias("more"), F.max("spare").alias("spare"))
    return pairs.where("k + spare > more").select("g", "h")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                             counters: int = COUNTERS) -> DataFrame:
    """``(<id>, n_shingles, component_id)`` per row of ``docs``.

    Two documents link when ``100 * intersection >= 75 * union`` of their sets
    of distinct ``width``-word shingles (words lower-cased A-Z); a text of fewer
    words is one shingle. Null, empty and blank texts have size 0, link with
    nothing and keep their own id. ``component_id`` is the smallest id reachable
    over links. Repeated rows each get a row; a null id never is a smallest id
    unless nothing else is there. Other columns are not read. ``counters`` is a
    power of two.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = d.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([("id", to_arrow_type(kind)), ("n", pa.int64()), ("cls", pa.int64()), ("cell", pa.int32()), ("counts", pa.binary())])
    rows = cut(d.mapInArrow(_signatures(width, counters, out), f"id {kind.simpleString()}, n bigint, cls bigint, cell int, counts binary"))
    own = rows.where("cell IS NULL").select("id", "n", "cls")
    table, hot = C.magnitudes(rows.where("cell IS NOT NULL").select("cell", "counts"), counters)
    magnitude = spark.sparkContext.broadcast(table)

    classes = cut(own.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")), own.count())
    sets = cut(_candidate_sets(d, classes, width, magnitude, hot))
    comps = _components(sets, magnitude)

    least = (classes.join(comps, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    lowest = least.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = (least.where((F.col("rows") > 1) | (F.col("component") != F.col("cls")) | F.col("linked").isNotNull())
             .join(lowest, "component").select("cls", "component_id", "rows"))
    label = cut(label, classes.count())
    return spread_join(own.where("n > 0"), label, "cls", F.col("rows") * HOT_SHARE >= own.count()).select("id", "n", "component_id").union(
        own.where("n = 0").select("id", "n", F.col("id"))).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def _candidate_sets(d: DataFrame, classes: DataFrame, width: int, magnitude, hot: int) -> DataFrame:
    """``(cls, n, gid, shingles)`` of the classes that share enough prefix shingles to have a partner.

    The window holds one shingle's classes; cold cells bound their number.
    """
    entries = d.select("text").mapInArrow(_prefix_rows(width, magnitude, hot), "token bigint, cls bigint, surely int")
    of = Window.partitionBy("token")
    live = (entries.withColumn("shared", F.min("cls").over(of) < F.max("cls").over(of)).where("shared OR surely > 0")
            .select("token", "cls", F.when(F.col("surely") > 0, F.col("surely")).otherwise(1).alias("k")).distinct())
    shared = live.groupBy("cls").agg(F.sum("k").alias("k"))
    alive = classes.join(shared, "cls").where(F.col("k") >= F.least(1 + F.floor(F.floor((3 * F.col("n") + 3) / 4) / 20), F.col("n")))
    alive = fitting(cut(alive.select("rep", "cls"), classes.count()), 48)
    texts = d.join(alive, d.id.eqNullSafe(alive.rep)).select("cls", "text")
    return texts.mapInArrow(_set_rows(width, magnitude), "cls bigint, n bigint, gid bigint, shingles binary")


def _components(sets: DataFrame, magnitude) -> DataFrame:
    """``(cls, component, linked)`` of every class that has a link."""
    entries = cut(sets.select("gid", "shingles").mapInArrow(_group_entries(magnitude), "token bigint, gid bigint, n bigint, pos bigint, common int"))
    # a shingle's centre is its group with the most common prefix: in a family of copies, the text that the others were made from
    # (its commonness in the high bits, 47 bits of its id in the low ones)
    short = F.shiftrightunsigned("gid", 17)
    of = entries.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.max(F.shiftleft(F.col("common").cast("long"), 47) + short).alias("best")).where("k > 1")
    live = cut(entries.join(of, "token").select("token", "gid", "n", "pos", F.col("best").bitwiseAND(F.lit((1 << 47) - 1)).alias("first")), entries.count())
    n_live, n_sets = live.count(), sets.count()

    head = cut(sets.groupBy("gid").agg(F.min("cls").alias("head"), F.any_value("n").alias("n")), n_sets)
    near = (live.where(short != F.col("first")).groupBy("gid", F.col("first").alias("other")).agg(F.count(F.lit(1)).alias("k"), F.any_value("n").alias("n"))
            .join(fitting(head.select(short.alias("other"), F.col("head").alias("b"), F.col("n").alias("m"))), "other")
            .where(_sized("n", "m")).groupBy("gid").agg(F.max_by("b", F.struct("k", "b")).alias("b")))
    near = near.join(head.select("gid", F.col("head").alias("a")), "gid").select("a", "b")
    inside = sets.select("gid", "cls").distinct().join(head.select("gid", "head"), "gid").where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))
    first = _linked(near.union(inside), sets, 2 * n_sets)
    comp = cut(connected_components(first, rows=first.count()), n_sets)

    member = sets.select("cls", "gid", "n").distinct().join(comp, F.col("id") == F.col("cls"), "left").select(
        "cls", "gid", "n", F.coalesce("component", "cls").alias("comp"))
    member = cut(member, n_sets)
    group = cut(member.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), n_sets)
    placed = live.select("token", "gid", "n", "pos").join(fitting(group), "gid")
    by_comp = placed.groupBy("token", "lo").agg(F.count(F.lit(1)).alias("k"), F.max("hi").alias("hi"))
    open_ = by_comp.groupBy("token").agg(F.max_by("lo", F.struct("k", "lo")).alias("main"), F.min("lo").alias("least"),
                                         F.max("hi").alias("most")).where("least < most").select("token", "main")
    x = cut(placed.join(fitting(cut(open_, n_live)), "token").withColumn("minor", (F.col("lo") != F.col("hi")) | (F.col("lo") != F.col("main"))), n_live)
    pairs = _close_pairs(x)
    mixed = group.where("lo < hi").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    ma = member.select(F.col("gid").alias("g"), F.col("cls").alias("a"), F.col("comp").alias("ca"))
    mb = member.select(F.col("gid").alias("h"), F.col("cls").alias("b"), F.col("comp").alias("cb"))
    wide = pairs.union(mixed).join(ma, "g").join(mb, "h").where("ca <> cb AND (g <> h OR a < b)").select("a", "b")
    second = _linked(wide, sets)

    links = first.union(second).select("a", "b")
    return connected_components(links, rows=links.count()).select(F.col("id").alias("cls"), "component", F.lit(True).alias("linked"))
