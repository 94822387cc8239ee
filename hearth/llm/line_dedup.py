"""Line dedup by a log-template tree, in DataFrame functions only.

A line's tokens that hold a digit are variable fields. The tree has a fixed
depth: token count, then the leading ``DEPTH`` tokens; its leaves are hash keys.
Within a leaf a token is constant at its position if more than half of the
leaf's texts have it there. A line of which at least half of the tokens, and
half of those after the leading ones, are constant belongs to the leaf's
template with the other tokens generalised. The other lines are split into
clusters by the most frequent token, with its position, that each has and that
isn't constant, and the same is done in each cluster, until no such token is in
``min_texts`` texts: a leaf yields as many templates as it has. A cluster has at
most half of the texts of the one before, so the rounds are few. A line that
fits nowhere is a template of its own. Templates with a variable field that recur
in ``min_texts`` different texts are dropped, and lines that recur as they are in
``literal_texts``. Two texts are recurrence; a generalised template needs more
because unrelated lines can share one by chance.

A line needs two tokens after the leading ones: of one, half is the whole line.

Counts are of different texts, so exact copies of one document do not make its
lines recur. All sums are grouped with map-side combination.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm import graph
from hearth.llm.graph import HOT_SHARE, cut, fitting, spread_join

DEPTH = 3
MIN_TEXTS = 5
LITERAL_TEXTS = 2
SALTS = 64
FIELD = "<*>"
_BLANK = r"[\x20\x09-\x0D]+"


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, _BLANK), "")


def _tokens(line: Column) -> Column:
    return _words(F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", FIELD)).otherwise(line))


def _lines(docs: DataFrame) -> DataFrame:
    """(th, i, line, tokens, n, leaf) for every line with a token; ``th`` names the text, ``i`` counts lines from 0."""
    rows = docs.select("th", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("tokens", _tokens(F.col("line"))).withColumn("n", F.size("tokens")).withColumn(
        "leaf", F.xxhash64("n", F.slice("tokens", 1, DEPTH))).select("th", "i", "line", "tokens", "n", "leaf")


def _own(tokens: Column) -> Column:
    return F.xxhash64(F.lit("line"), tokens)


def _templates(inside: DataFrame, depth: int, min_texts: int) -> DataFrame:
    """``(th, i, wide)`` for the lines that belong to a generalised template; ``node`` is a line's cluster and ``texts`` counts its texts."""
    found = None
    while True:
        at = inside.select("node", "texts", "th", F.posexplode("tokens").alias("p", "token")).distinct()
        counts = cut(at.groupBy("node", "texts", "p", "token").agg(F.count(F.lit(1)).alias("k")).where((F.col("k") * 2 > F.col("texts")) | (F.col("k") >= min_texts)))
        constant = cut(counts.where("k * 2 > texts").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("p", "token"))).alias("constant"),
                                                                         F.sum(F.length("token") * 2 + 32).alias("bytes")))
        constant = fitting(constant, size=F.col("bytes") + 32).select("node", "constant")
        judged = (inside.join(constant, "node", "left")
                  .withColumn("shape", F.transform("tokens", lambda t, p: F.when(F.try_element_at("constant", p) == t, t).otherwise(F.lit(FIELD))))
                  .withColumn("same", F.aggregate(F.transform("tokens", lambda t, p: F.when(F.try_element_at("constant", p) == t, F.struct(
                      F.lit(1).alias("a"), (p >= depth).cast("int").alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))),
                      F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")), lambda x, y: F.struct((x.a + y.a).alias("a"), (x.b + y.b).alias("b"))))
                  .withColumn("fits", (F.col("same.a") * 2 >= F.col("n")) & (F.col("same.b") * 2 >= F.col("n") - depth)))
        judged = cut(judged.select("th", "i", "leaf", "node", "n", F.when(F.col("fits"), F.xxhash64(F.lit("leaf"), "leaf", "shape")).alias("wide"),
                                   F.when(~F.col("fits"), F.col("tokens")).alias("tokens")))
        fit = judged.where("wide IS NOT NULL").select("th", "i", "wide")
        found = fit if found is None else found.unionByName(fit)

        cell = F.xxhash64("node", "p", "token")
        often = cut(counts.where("k * 2 <= texts").select(cell.alias("cell"), "k"))
        if often.isEmpty():
            return found
        rest = judged.where("wide IS NULL")
        fields = rest.select("th", "i", "node", F.posexplode("tokens").alias("p", "token")).select("th", "i", "p", cell.alias("cell"))
        fields = spread_join(fields, often, "cell", F.col("k") * HOT_SHARE >= rest.count()).where("k IS NOT NULL")
        best = cut(fields.groupBy("th", "i").agg(F.max(F.struct("k", (-F.col("p")).alias("p"), "cell")).alias("best")).select("th", "i", F.col("best.cell").alias("node")))
        sizes = cut(best.select("node", "th").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_texts))
        best = cut(best.join(fitting(sizes), "node"))
        inside = cut(rest.drop("node").join(fitting(best, 48), ["th", "i"]).select("th", "i", "leaf", "node", "n", "texts", "tokens"))
        if inside.isEmpty():
            return found


def recurring_lines(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, min_texts: int = MIN_TEXTS, literal_texts: int | None = None) -> DataFrame:
    """``(th, dropped)``: for each text hash the positions of its lines whose template recurs; ``literal_texts`` is ``min_texts`` if not given."""
    literal_texts = min_texts if literal_texts is None else literal_texts
    d = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL").select(F.xxhash64("text").alias("th"), "text")
    slim = cut(_lines(d).select("th", "i", "n", "leaf", _own(F.col("tokens")).alias("tpl"),
                                F.when(F.col("line").rlike("[0-9]"), F.xxhash64(F.lit("literal"), _words(F.col("line")))).alias("literal")))

    leaves = (slim.where(F.col("n") >= depth + 2).select("leaf", "th", "tpl").distinct().groupBy("leaf")
              .agg(F.count_distinct("th").alias("texts"), F.count_distinct("tpl").alias("shapes")).where((F.col("texts") >= min_texts) & (F.col("shapes") > 1)))
    leaves = fitting(cut(leaves.select("leaf", "texts")))
    inside = cut(slim.where(F.col("n") >= depth + 2).join(leaves, "leaf").select("th", "i", "leaf", "n", "texts").distinct())
    again = d.select("th", F.posexplode(F.split("text", "\n")).alias("i", "line")).join(fitting(inside, 48), ["th", "i"])
    inside = cut(again.select("th", "i", "leaf", F.col("leaf").alias("node"), "n", "texts", _tokens(F.col("line")).alias("tokens")))
    general = _templates(inside, depth, min_texts)
    need = lambda tpl, texts: F.struct(tpl.alias("tpl"), texts.cast("int").alias("need"))
    own = need(F.col("tpl"), F.when(F.col("literal").isNull(), F.lit(literal_texts)).otherwise(F.lit(min_texts)))
    every = F.array(own, need(F.col("literal"), F.lit(literal_texts)), need(F.col("wide"), F.lit(min_texts)))
    lines = cut(slim.select("th", "i", "tpl", "literal").distinct().join(general, ["th", "i"], "left").select("th", "i", F.explode(F.filter(every, lambda t: t.tpl.isNotNull())).alias("of"))
                .select("th", "i", "of.tpl", "of.need"))

    total = lines.count()
    known = cut(lines.select("tpl", "need", "th").distinct().groupBy("tpl", "need").agg(F.count(F.lit(1)).alias("texts")).where("texts >= need").select("tpl", "texts"))
    gone = spread_join(lines.drop("need"), known, "tpl", F.col("texts") * HOT_SHARE >= total).where("texts IS NOT NULL")
    return gone.groupBy("th").agg(F.collect_set("i").alias("dropped"))


def _labelled(rows: DataFrame, label: DataFrame, docs: DataFrame) -> DataFrame:
    """Left join of ``rows`` to ``label`` (th, dropped, rows), which is broadcast only if its line numbers fit.

    Otherwise both are shuffled. A hot text's rows are dealt over ``SALTS``
    parts, each with its copy of the label; only the names of hot texts,
    ``HOT_SHARE`` at most, are broadcast.
    """
    held = label.agg(F.sum(F.size("dropped").cast("long") * 4 + 32)).first()[0] or 0
    if held <= graph.BROADCAST_BYTES:
        return rows.join(F.broadcast(label), "th", "left")
    hot = F.broadcast(label.where(F.col("rows") * HOT_SHARE >= docs.count()).select("th", F.lit(SALTS).alias("salts")))
    rows = rows.join(hot, "th", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.monotonically_increasing_id() % SALTS).cast("int"))
    label = label.join(hot, "th", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return rows.drop("salts").join(label.hint("merge"), ["th", "salt"], "left")


def drop_recurring_lines(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, min_texts: int = MIN_TEXTS, literal_texts: int | None = None) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_dropped``.

    Lines are what ``\\n`` separates; lines without a token always stay. A null
    text has 0 lines and a null ``kept_text``, an empty one has one (blank) line.
    Repeated rows get equal results. Columns named like the new ones are
    replaced. Whole texts are read; no line or document is too long.
    """
    gone = cut(recurring_lines(docs, text_col, depth, min_texts, literal_texts))
    names = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    rows = docs.select(F.struct(*names).alias("row"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    sizes = docs.select(F.xxhash64(F.col(text_col)).alias("th")).groupBy("th").agg(F.count(F.lit(1)).alias("rows"))
    label = cut(gone.join(sizes, "th"))
    out = _labelled(rows, label, docs).withColumn("lines", F.split("text", "\n"))  # a column: in the function below it would be split anew for every line
    lines = F.col("lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped").cast("array<int>"))  # by a hash set: linear in the lines
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return out.select("row.*", F.when(F.col("text").isNotNull(), kept).alias("kept_text"),
                      F.when(F.col("text").isNotNull(), F.size(lines)).otherwise(0).cast("long").alias("n_lines"),
                      F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))
