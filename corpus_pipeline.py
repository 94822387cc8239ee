"""The corpus pipeline: five operators in a row over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's documents, so a lost executor
costs a stage's tasks and nothing before them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm.bpe import bpe_decode, bpe_encode
from hearth.llm.exact_dedup import drop_exact_copies
from hearth.llm.graph import cut
from hearth.llm.langid import UNKNOWN, fit_profiles, identify_language
from hearth.llm.mixing import mixed_documents
from hearth.llm.ngram_join import ngram_jaccard_components
from hearth.llm.queries import held_out, table, vocabulary
from hearth.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; profiles are learned on those not held out.

    If no language could be learned there, nothing can be judged and every document stays.
    """
    profiles = fit_profiles(docs.where(~held_out()))
    if not profiles:
        return docs
    found = identify_language(docs, profiles)
    return found.where(F.col("lang_pred") != UNKNOWN).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of equal texts stays, the one with the largest doc_id."""
    return drop_exact_copies(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate component stays, the one with the smallest doc_id (a null one only if there is no other).

    Rows are told apart by a key of their own, so null and shared ids are decided like any others.
    """
    keyed = cut(docs.withColumn("_row_key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row"))))
    gone = ngram_jaccard_components(keyed, id_col="_row_key").where(F.col("component_id") != F.col("_row_key")).select("_row_key")
    return keyed.join(gone, "_row_key", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights: a row for each time a document is taken."""
    mixed = mixed_documents(docs)
    return mixed.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else mixed


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding them again."""
    ids = bpe_encode(docs.select("doc_id", "lang", "source", "text"), **vocabulary())
    back = bpe_decode(ids, **vocabulary(), text=False)
    return back.select("doc_id", "lang", "source", "n_tokens", "ids", (F.coalesce(F.col("text"), F.lit("")).cast("binary") == F.col("decoded")).alias("round_trip"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("ngram_join", ngram_join), ("mixing", mixing), ("byte_bpe", byte_bpe)]

#: Language identification learns profiles; SQL doesn't express it. Tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written under the shared checkpoint folder and read again."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
