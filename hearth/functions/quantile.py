"""Exact group quantiles and in-group ranks that hold up under skew.

The values of a group fall into buckets by magnitude (256 to a power of two).
A first pass over the rows counts the buckets, which gives the bucket of every
wanted rank; this small table is written and measured. A second pass keeps only
the rows of those buckets and counts their distinct values, so a value that
holds most rows is one row, and sums them up in order. No other value is
shuffled. All columns and probabilities of a call go through together.
Interpolation is linear between the ranks ``floor`` and ``ceil`` of
``(n-1)*p``, the same as pandas ``quantile``, Spark ``percentile`` and DuckDB
``quantile_cont``.

Ranks use a range sort with a running row id as last key, so equal values are
split as well: every row gets ``monotonically_increasing_id`` (partition id in
the high bits, row position in the low 33 bits) and a small per-(partition,
group) block table gives every block's starting rank.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.session import ensure_checkpoint_dir
from hearth.sources.scratch import BROADCAST_BYTES, stored_with_size

_LOW_BITS = (1 << 33) - 1
# A table of at most this many (narrow) rows may be broadcast: 2M rows of ids and counts stay under 64 MB.
MAX_BROADCAST_ROWS = 2_000_000
_BUCKETS_PER_BINADE, _OFFSET = 256, 300_000


def _qname(p: float) -> str:
    return "q_" + (f"{p:.6f}".rstrip("0").rstrip(".").replace(".", "_"))


def _numparts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def checked_join(big: DataFrame, small: DataFrame, on, how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join, broadcasting ``small`` only after counting it. ``small`` must be
    cheap to recompute (checkpointed or an aggregate of one)."""
    if small.count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def sorted_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]):
    """Range-sort ``df`` by keys + order, tag rows with ``_mid`` and return
    (checkpointed rows, block table with ``_start`` rank and group size ``_n``)."""
    ensure_checkpoint_dir(df.sparkSession)
    n = _numparts(df)
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    s = (
        df.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *[F.col(k) for k in keys], *order_cols, F.col("_tie"))
        .sortWithinPartitions(*[F.col(k) for k in keys], *order_cols, F.col("_tie"))
        .drop("_tie")
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    blocks = s.groupBy(F.shiftright("_mid", 33).alias("_pid"), *keys).agg(
        F.min(F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))).alias("_first"),
        F.count(F.lit(1)).alias("_cnt"),
    )
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    blocks = (
        blocks.withColumn("_end", F.sum("_cnt").over(w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_start", F.col("_end") - F.col("_cnt"))
        .withColumn("_n", F.sum("_cnt").over(w))
        .drop("_end")
    )
    return s, blocks


def _bucket(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises; equal values share it."""
    size = F.lit(_OFFSET) + F.when(F.abs(v) == float("inf"), F.lit(_OFFSET)).otherwise(F.floor(F.log2(F.abs(v)) * _BUCKETS_PER_BINADE))
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def quantile_table(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Sequence[tuple[float, str]]]) -> DataFrame:
    """``keys`` and one column per wanted (probability, name) of each value
    column, for every group with at least one value; exact."""
    kk = [f"_k{i}" for i in range(len(keys))]
    cols = list(wanted)
    pairs = F.array(*[F.struct(F.lit(j).alias("c"), F.col(c).cast("double").alias("v")) for j, c in enumerate(cols)])
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, kk)], F.explode(pairs).alias("_x")).select(*kk, "_x.c", "_x.v")
    rows = rows.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("b", _bucket(F.col("v")))
    w = Window.partitionBy(*kk, "c")
    buckets = (rows.groupBy(*kk, "c", "b").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("start", F.sum("n").over(w.orderBy("b")) - F.col("n")).withColumn("total", F.sum("n").over(w)))
    probs = F.array(*[F.struct(F.lit(j).alias("c"), F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                      for j, c in enumerate(cols) for i, (p, _) in enumerate(wanted[c])])
    pos = (F.col("total") - 1).cast("double") * F.col("q.p")
    want = buckets.withColumn("q", F.explode(F.filter(probs, lambda q: q.c == F.col("c")))).withColumn("pos", pos)
    want = want.withColumn("r", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor("pos").alias("at")),
                                                  F.struct(F.lit(1).alias("side"), F.ceil("pos").alias("at")))))
    want = (want.where((F.col("r.at") >= F.col("start")) & (F.col("r.at") < F.col("start") + F.col("n")))
            .groupBy(*[F.col(k).alias(f"w{k}") for k in kk], F.col("c").alias("wc"), F.col("b").alias("wb"))
            .agg(F.collect_list(F.struct(F.col("q.i").alias("i"), F.col("r.side").alias("side"), (F.col("r.at") - F.col("start")).alias("at"), "pos")).alias("ranks")))
    same = (F.col("c") == F.col("wc")) & (F.col("b") == F.col("wb"))
    for k in kk:
        same = same & F.col(k).eqNullSafe(F.col(f"w{k}"))
    table, _, size = stored_with_size(want)
    want = F.broadcast(table) if size <= BROADCAST_BYTES else table
    seen = rows.join(want, same, "left_semi").groupBy(*kk, "c", "b", "v").agg(F.count(F.lit(1)).alias("n"))
    inside = seen.join(want, same).withColumn("end", F.sum("n").over(Window.partitionBy(*kk, "c", "b").orderBy("v")))
    hits = inside.select(*kk, "c", "v", F.explode(F.filter("ranks", lambda t: (t["at"] < F.col("end")) & (t["at"] >= F.col("end") - F.col("n")))).alias("t"))

    def pick(j: int, i: int, side: int, x: str) -> Column:
        return F.max(F.when((F.col("c") == j) & (F.col("t.i") == i) & (F.col("t.side") == side), F.col(x)))

    out = hits.groupBy(*kk).agg(F.count(F.lit(1)).alias("_nn"), *[
        c for j, name in enumerate(cols) for i in range(len(wanted[name]))
        for c in (pick(j, i, 0, "v").alias(f"lo_{j}_{i}"), pick(j, i, 1, "v").alias(f"hi_{j}_{i}"), pick(j, i, 0, "t.pos").alias(f"pos_{j}_{i}"))])

    def between(j: int, i: int) -> Column:
        lo, hi, pos = F.col(f"lo_{j}_{i}"), F.col(f"hi_{j}_{i}"), F.col(f"pos_{j}_{i}")
        return F.when(F.floor(pos) == F.ceil(pos), lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi)

    return out.where("_nn > 0").select(*[F.col(a).alias(k) for k, a in zip(keys, kk)], *[
        between(j, i).alias(n) for j, name in enumerate(cols) for i, (_, n) in enumerate(wanted[name])])


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, mode: str = "exact", accuracy: int = 100_000) -> DataFrame:
    """One row per group present with at least one non-null value:
    ``keys + names`` (default names ``q_0_5`` ...)."""
    keys = list(keys)
    names = list(names or [_qname(p) for p in probs])
    if mode == "exact":
        return quantile_table(df, keys, {value: list(zip(probs, names))})
    if mode != "approx":
        raise ValueError(f"unknown quantile mode {mode!r}")
    x = F.col(value).cast("double")
    x = F.when(~F.isnan(x), x)
    g = df.groupBy(*keys).agg(F.percentile_approx(x, [float(p) for p in probs], accuracy).alias("_q"), F.count(x).alias("_nn"))
    return g.where(F.col("_nn") > 0).select(*keys, *[F.col("_q")[i].cast("double").alias(n) for i, n in enumerate(names)])


def attach_quantiles(stats: DataFrame, df: DataFrame, keys: Sequence[str], wanted: Mapping[str, Sequence[tuple[float, str]]],
                     mode: str = "exact") -> DataFrame:
    """Left-join group quantiles of ``df`` (columns, probabilities and names in
    ``wanted``) onto a per-group ``stats`` table (null-safe on keys; groups
    without values get nulls)."""
    keys = list(keys)
    if not wanted:
        return stats
    if mode == "exact":
        tables = [quantile_table(df, keys, wanted)]
    else:
        tables = [group_quantiles(df, keys, c, [p for p, _ in w], [n for _, n in w], mode) for c, w in wanted.items()]
    for q in tables:
        if not keys:
            stats = stats.join(F.broadcast(q), how="left")
            continue
        qr = q.select(*[F.col(k).alias(f"_qk_{k}") for k in keys], *[c for c in q.columns if c not in keys])
        cond = None
        for k in keys:
            c = stats[k].eqNullSafe(qr[f"_qk_{k}"])
            cond = c if cond is None else cond & c
        stats = stats.join(qr, cond, "left").drop(*[f"_qk_{k}" for k in keys])
    return stats


def scalar_quantiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str] | None = None,
                     mode: str = "exact") -> DataFrame:
    """A one-row DataFrame of whole-column quantiles (to cross-join as a scalar)."""
    return group_quantiles(df, [], value, probs, names, mode)


def rank_within_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Every row of ``df`` with ``_rank`` (0-based position inside its group in
    ``order``) and ``_n`` (group size), without putting a group in one task."""
    keys = list(keys)
    s, blocks = sorted_blocks(df, keys, order)
    b = blocks.select("_pid", *[F.col(k).alias(f"_bk_{k}") for k in keys], "_first", "_start", "_n").checkpoint(eager=True)
    s2 = s.withColumn("_pid", F.shiftright("_mid", 33))
    cond = s2["_pid"] == b["_pid"]
    for k in keys:
        cond = cond & s2[k].eqNullSafe(b[f"_bk_{k}"])
    if b.count() <= MAX_BROADCAST_ROWS:
        b = F.broadcast(b)
    j = s2.join(b, cond, "inner")
    rank = F.col("_start") + (F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) - F.col("_first"))
    return j.select(*[s2[c] for c in df.columns], rank.alias("_rank"), F.col("_n"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` in ``order`` within each group, as a
    distributed prefix sum: the rows are range-sorted (a hot group spans many
    partitions), summed inside each sorted partition by a window over that
    partition only, and offset by the totals of the group's earlier partitions."""
    keys = list(keys)
    s, _ = sorted_blocks(df, keys, order)
    s = s.withColumn("_pid", F.shiftright("_mid", 33))
    part = Window.partitionBy("_pid", *keys).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_local", F.sum(F.col(value)).over(part))
    tot = s.groupBy("_pid", *keys).agg(F.sum(F.col(value)).alias("_bsum"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    tot = tot.withColumn("_before", F.coalesce(F.sum("_bsum").over(w), F.lit(0)))
    j = s.join(tot.drop("_bsum"), ["_pid", *keys]) if keys else s.join(tot.drop("_bsum"), "_pid")
    return j.withColumn(out, F.col("_before") + F.col("_local")).drop("_before", "_local", "_pid", "_mid")
