"""Exact deduplication by a two-pass Bloom filter, in DataFrame functions only.

Pass 1 hashes every normalised text and counts, for two cells per hash, whether
a second row falls into the cell; the cells hit twice become bitmaps. Pass 2
asks the bitmaps: a row with a cell that was hit once has no copy and passes
straight through, unshuffled. Only the rest is grouped by its text hash.
The bitmaps have ``MAX_BITS`` bits at most (64 MB), so they may be broadcast at
any input size; a full filter only lets more rows into the exact second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.graph import HOT_SHARE, cut, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_ROW = 32
MIN_BITS, MAX_BITS = 1 << 15, 1 << 29
_PAGE_BITS = 1 << 15  # bits of one bitmap of bitmap_construct_agg


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the byte-wise path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _cells(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("sha", F.lit(i)), F.lit(bits)) for i in (1, 2)]


def _is_set(page: str, cell: Column) -> Column:
    bit = cell % _PAGE_BITS
    byte = F.conv(F.hex(F.substring(F.col(page), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def _sha(text_col: str) -> Column:
    return F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256)


def _pages(rows: DataFrame, total: int) -> tuple[DataFrame, int]:
    """Pass 1: (the bitmaps of the cells that two rows or more fall into, their bits)."""
    wanted = BITS_PER_ROW * max(total, 1)
    bits = min(max(1 << (wanted - 1).bit_length(), MIN_BITS), MAX_BITS)
    cells = rows.select(F.explode(F.array(*_cells(bits))).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cells.groupBy(F.floor(F.col("cell") / _PAGE_BITS).alias("page")).agg(
        F.bitmap_construct_agg(F.col("cell") % _PAGE_BITS).alias("bitmap")), bits


def _ask(rows: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    """Pass 2: ``rows`` with ``maybe``, false where the bitmaps prove that no other row has the hash."""
    for i, cell in enumerate(_cells(bits)):
        page = F.broadcast(pages.select(F.col("page").alias(f"p{i}"), F.col("bitmap").alias(f"b{i}")))
        rows = rows.join(page, F.floor(cell / _PAGE_BITS) == F.col(f"p{i}"), "left").withColumn(f"hit{i}", _is_set(f"b{i}", cell)).drop(f"p{i}", f"b{i}")
    return rows.withColumn("maybe", F.col("hit0") & F.col("hit1")).drop("hit0", "hit1")


def _groups(asked: DataFrame, total: int) -> DataFrame:
    return cut(asked.where("maybe").groupBy("sha").agg(F.max(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"), total)


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return cut(docs.select(F.col(id_col).alias("id"), _sha(text_col).alias("sha"), F.monotonically_increasing_id().alias("row")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, keep_id, group_size, kept, text_sha256)`` per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.
    The row with the largest id of each group is kept (null ids come last); of
    rows that repeat that id exactly one is. Other columns are not read.
    """
    rows = _slim(docs, id_col, text_col)
    total = rows.count()
    asked = cut(_ask(rows, *_pages(rows, total)))
    again = spread_join(asked.where("maybe"), _groups(asked, total), "sha", F.col("n") * HOT_SHARE >= total)
    one = F.lit(1).cast("long")
    return asked.where("NOT maybe").select(
        F.col("id").alias(id_col), F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256")).union(again.select(
            F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
            F.coalesce("n", one).alias("group_size"), F.coalesce(F.col("row") == F.col("top.row"), F.lit(True)).alias("kept"),
            F.col("sha").alias("text_sha256")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of every group of equal texts, the one with the largest id, all columns unchanged.

    Rows that the bitmaps clear pass through with their text unshuffled.
    """
    rows = _slim(docs, id_col, text_col)
    total = rows.count()
    pages, bits = _pages(rows, total)
    pages = cut(pages)
    groups = _groups(cut(_ask(rows, pages, bits)), total)
    names = docs.columns
    full = docs.select(*(F.col(c).alias(f"c_{c}") for c in names), F.col(id_col).alias("id"), _sha(text_col).alias("sha"))
    asked = _ask(full, pages, bits)
    again = spread_join(asked.where("maybe"), groups, "sha", F.col("n") * HOT_SHARE >= total)
    single = again.where("n IS NULL")
    best = again.where(F.col("n").isNotNull() & F.col("id").eqNullSafe(F.col("top.id"))).dropDuplicates(["sha"])
    out = [F.col(f"c_{c}").alias(c) for c in names]
    return asked.where("NOT maybe").select(*out).union(single.select(*out)).union(best.select(*out))
