"""Mixing sources to target weights, in DataFrame functions only.

Documents get a hash-random key. The keys of a source are cut into about
``sqrt(rows)`` equal ranges; a range's documents are sorted and summed on their
own and the ranges' totals are summed over each source, which together is a
distributed prefix sum: no source, however large, is in one task. The mix takes
whole epochs of a source and then its first documents up to the exact budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.graph import cut

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(sid, source, source_size, target)`` from ``(sid, source, source_size)``, one row a source.

    All sizes together are shared by weight; a target above ``max_epochs`` times
    its source stops there and the excess is shared again. Sorted by the level at
    which they fill up, the sources before the first one that stays below its
    cap are exactly the capped ones, so sums over that order solve it at once.
    The windows run over one row a source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(after))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "sid", F.col("level").alias("level"))))
                     .over(Window.partitionBy())["level"])
    return s.select("sid", "source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id",
                text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """``(<id>, size, source_size, target, taken)`` per row of ``docs``.

    ``taken`` counts the words that the mix takes from the row, repeats counted:
    a source's whole epochs, and in the last one its first rows by hash key until
    the budget (the target, rounded) is met; the row at the cut gives its first
    words only. It is ``max_epochs * size`` at most. A null text has size 0, a
    null source is a source of its own and the last one; rows that repeat an id
    are ordered by size and are interchangeable beyond that. Other columns are
    not read.
    """
    return _mix(docs, weights, max_epochs, id_col, text_col, source_col, seed).select(
        F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _mix(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, id_col: str, text_col: str, source_col: str, seed: str,
         carry: tuple[str, ...] = ()) -> DataFrame:
    """``(id, size, source_size, target, taken)`` and the columns ``carry`` as ``c_<name>``."""
    sid = F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n"))
    slim = docs.select(F.col(id_col).alias("id"), sid.alias("sid"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    slim = cut(slim)
    ranges = max(1, math.isqrt(slim.count()))
    if carry:
        full = docs.select(F.col(id_col).alias("id"), sid.alias("sid"), word_count(F.col(text_col)).alias("size"), *(F.col(c).alias(f"c_{c}") for c in carry))
    else:
        full = slim.select("id", "sid", "size")

    def placed(df: DataFrame) -> DataFrame:
        first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
        return df.withColumn("key", _order_key(F.col("id"), seed)).withColumn("range", F.floor(first * ranges / F.lit(float(1 << 32))).cast("long"))

    targets = source_targets(slim.groupBy("sid").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), weights, max_epochs)
    up_to = Window.partitionBy("sid").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed(slim).groupBy("sid", "range").agg(F.sum("size").alias("words")).withColumn("skip", F.coalesce(F.sum("words").over(up_to), F.lit(0)))
    plan = (sums.join(targets.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long")), "sid")
            .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long"))
            .select("sid", "range", "skip", "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("rest")))
    inner = Window.partitionBy("sid", "range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = placed(full).join(plan, ["sid", "range"]).withColumn("before", F.col("skip") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("rest") - F.col("before"), F.col("size")))
    return out.select("id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(F.col(f"c_{c}") for c in carry))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id",
                    text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """The mix itself: a row for each time that a document is taken, with the columns of ``docs``.

    Rows that nothing is taken from go. The one row of a source at which its
    budget ends comes with its first words, joined by one space.
    """
    names = docs.columns
    mixed = _mix(docs, weights, max_epochs, id_col, text_col, source_col, seed, carry=tuple(names))
    whole = F.floor(F.col("taken") / F.col("size"))
    left = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")))
    rows = mixed.where("taken > 0").withColumn("part", F.explode(copies))
    cut_text = F.array_join(F.slice(F.regexp_extract_all(F.col(f"c_{text_col}"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    return rows.select(*(F.when(F.col("part") > 0, cut_text).otherwise(F.col(f"c_{c}")).alias(c) if c == text_col else F.col(f"c_{c}").alias(c) for c in names))
