"""A training corpus from the documents table: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm import decontaminate, forest, langid, mixing, sharding
from residua.llm import words as W
from residua.llm.queries import learned_language, table
from residua.scratch import written

SHARDS = 8
#: Documents whose language is told with less confidence are rejected, as are those without any letter.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is told with confidence. Null, empty and letterless texts are rejected; repeated rows are judged alike; if
    no document has a label, nothing can be told and nothing is kept."""
    tag = W.free_prefix(docs.columns)
    told = langid.predict(docs, "text", learned_language(docs), tag)
    return told.where((F.col(f"{tag}lang_pred") != langid.UNKNOWN) & (F.col(f"{tag}score") >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows that five-word shingles link at 0.8 or more: that with the smallest id.

    Rows and not ids are compared, so repeated rows of one id and rows with a null id are copies like any others; null
    ids come last, and rows of one id go by a hash of all columns. Rows without words have no copies and all stay.
    """
    row = W.free_prefix(docs.columns) + "row"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    told = forest.near_duplicates(rows, row, "text", size=5).select(row, F.col("component_id").alias("class"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), row)
    ranked = rows.select(row, rank.alias("rank")).join(told.hint("merge"), row)
    kept = ranked.groupBy("class").agg(F.min("rank")[row].alias(row)).select(row)
    return rows.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item; null and empty texts overlap with none, repeated rows go or stay together."""
    return decontaminate.drop_overlapping(docs, "text", table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says; null ids draw as the empty string, null sources are a source, documents without words have
    size 0 and are emitted like the others of their source."""
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.emit_copies(docs, "doc_id", "source", mixing.source_rates(sized, "doc_id", "source", "size"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``; copies of one document are rows like any others, a null id stands where the empty string does."""
    return sharding.ring_shards(docs, "doc_id", SHARDS, ties=("n_chars",))


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", mixture),
    ("sharding", shards),
]
#: Neither the classifier nor the signatures can be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
