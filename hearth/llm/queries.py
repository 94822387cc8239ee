"""One query per operator over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.bpe import bpe_decode, bpe_encode
from hearth.llm.embedding_dedup import embedding_near_duplicates
from hearth.llm.exact_dedup import LOWER, UPPER, exact_groups
from hearth.llm.langid import fit_profiles, identify_language
from hearth.llm.license_scan import scan_licenses
from hearth.llm.line_dedup import LITERAL_TEXTS, drop_recurring_lines
from hearth.llm.mixing import mix_sources
from hearth.llm.ngram_join import ngram_jaccard_components
from hearth.llm.substring_dedup import remove_repeated_windows
from hearth.llm.token_counts import count_tokens
from hearth.llm.vector_codes import books_sha256, encode_vectors, with_label_errors
from hearth.llm.whitening import whiten
from hearth.llm.word_bpe import word_bpe_decode, word_bpe_encode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return keep


def vocabulary() -> dict[str, str]:
    """The byte-level vocabulary that the queries use: the library's file, the ranks and the pattern."""
    return {"vocabulary": public_tokenizers.path("byte_bpe_50k.json"), "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
            "pattern": public_tokenizers.PATTERN}


def held_out(doc_id="doc_id"):
    """Documents whose crc32 of the id as text is divisible by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def components_sql(docs: str = "documents") -> str:
    """CTEs ``jn`` (set sizes) and ``reach`` (doc_id, every id it reaches) over the table ``docs``."""
    words = WORDS_SQL.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")
    return f"""jw AS (SELECT doc_id, {words} AS w FROM {docs}),
js AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM jw),
jn AS (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jo AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM js a JOIN js b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
jl AS (SELECT a, b FROM jo JOIN jn x ON x.doc_id = a JOIN jn y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
je AS (SELECT a, b FROM jl UNION ALL SELECT b, a FROM jl),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM {docs} UNION SELECT reach.doc_id, je.b FROM reach JOIN je ON reach.r = je.a)"""


@query("op1_ngram_jaccard_join", f"""WITH RECURSIVE {components_sql()}
SELECT d.doc_id, CAST(coalesce(any_value(jn.n), 0) AS BIGINT) AS n_shingles, min(reach.r) AS component_id
FROM documents d JOIN reach ON reach.doc_id = d.doc_id LEFT JOIN jn ON jn.doc_id = d.doc_id GROUP BY d.doc_id""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five-word shingles, Jaccard 0.75 or more."""
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


def mix_sql(docs: str = "documents") -> str:
    """CTEs up to ``mix`` (doc_id, source, text, size, source_size, target, taken) over the table ``docs``."""
    return f"""mt AS (SELECT *, CAST(len({WORDS_SQL.format("coalesce(text, '')")}) AS BIGINT) AS size, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mkey,
         coalesce('s' || source, 'n') AS sid FROM {docs}),
ms AS (SELECT sid, any_value(source) AS src, CAST(sum(size) AS BIGINT) AS source_size FROM mt GROUP BY sid),
mw AS (SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM ms),
ml AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM mw),
mg AS (SELECT level AS lv FROM ml WHERE level * weight <= cap ORDER BY cap / weight, sid LIMIT 1),
mp AS (SELECT sid, source_size, least(cap, lv * weight) AS target, CAST(floor(least(cap, lv * weight) + 0.5) AS BIGINT) AS budget FROM ml CROSS JOIN mg),
mq AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM mp),
mb AS (SELECT mt.*, mq.source_size, mq.target, mq.epochs, mq.budget - mq.epochs * mq.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY mt.sid ORDER BY mkey, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
       FROM mt JOIN mq ON mt.sid = mq.sid),
mix AS (SELECT *, CAST(epochs * size + greatest(0, least(rest - before, size)) AS BIGINT) AS taken FROM mb)"""


@query("op2_mixing", f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, taken FROM mix")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents' sources at weights 1, 2, 3, at most 3 epochs of each."""
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text to byte-level BPE ids and back; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe_encode(docs, **vocabulary()).select("doc_id", "n_tokens", "ids")
    back = bpe_decode(ids, **vocabulary(), text=False)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_exact_dedup", f"""WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents; the largest doc_id of each stays."""
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by profiles learned on those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = fit_profiles(docs.where(~held_out()))
    return identify_language(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles).drop("text")


@query("op9_embedding_dedup", """WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, x) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.x = l.a),
c AS (SELECT vec_id, min(x) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n ON n.a = c.vec_id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of the same label at cosine 0.98, over all rows."""
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op5_line_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that recur in two texts or more, or whose generalised template recurs in five."""
    out = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), literal_texts=LITERAL_TEXTS)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram piece counts of every whole text, with the score of its best segmentation."""
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every document names, by sentence rules."""
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return out.select("doc_id", join("licenses"), join("sentences"), join("unmatched"))


@query("op8_substring_dedup", f"""WITH w AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM p),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM g WHERE k > 1),
r AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda y: w[y]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 20-word windows that also start earlier."""
    return remove_repeated_windows(table(spark, sf_dir, "documents"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the first 16 whitened components of their distinct integer vectors."""
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op12_word_bpe")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text to word-level BPE ids and back; digests of both."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    back = word_bpe_decode(word_bpe_encode(docs, path).select("doc_id", "n_tokens", "ids"), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"))


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of the codebooks, written out one after the other."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, x[part * (len(x) // {parts}) + 1:(part + 1) * (len(x) // {parts})] AS s FROM v, range({parts}) AS r(part)),
k0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, s FROM p QUALIFY entry < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT vec_id, label, part, entry, p.s, CAST(list_sum(list_transform(range(1, len(p.s) + 1), lambda j: (p.s[j] - k.s[j]) * (p.s[j] - k.s[j]))) AS BIGINT) AS d
  FROM p JOIN k{i} k USING (part)),
a{i} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, part, min(s) AS s, min((d, entry))[1] AS d, min((d, entry))[2] AS entry FROM d{i} GROUP BY vec_id, part)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT part, entry, j, sum(s[j]) AS t, count(*) AS n FROM a{i}, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS j) GROUP BY part, entry, j),
k{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(any_value(q.s), any_value(k.s)) AS s FROM k{i} k
  LEFT JOIN (SELECT part, entry, list(CAST((t - ((t % n) + n) % n) // n AS BIGINT) ORDER BY j) AS s FROM m{i} GROUP BY part, entry) q USING (part, entry) GROUP BY part, entry)""")
    return f"""WITH {", ".join(steps)},
c AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM k{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""


@query("op13_vector_codes", codes_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes of 8 parts over codebooks of 16 entries, after 6 rounds."""
    coded, books = encode_vectors(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
