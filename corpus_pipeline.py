"""A training-data pipeline of five text operators; each stage's result is written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame: all but the last the columns of
documents, with n_chars brought up to date. Stages work on every row their predecessor kept.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe, mixing, near, pii, quality
from panelwright.llm.common import keep, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above.

    Null and empty texts have the bias's score; repeated rows and rows without a key are scored like any other.
    """
    small_batches(spark)
    scored = quality.scored(docs, table(spark, sf_dir, "labels"), into="__score")
    return scored.where(F.col("__score") >= quality.KEEP_FROM).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, that of smallest key.

    Null texts are empty ones, so all empty texts are one class. Rows without a key stay. Rows that share
    a key but not a text are judged each by its own text; a repeated row stays once, if it stays. No rows, no result rows.
    """
    small_batches(spark)
    return near.one_of_each(docs.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind. All rows stay, null texts stay null, n_chars is counted again (null for null)."""
    small_batches(spark)
    return pii.mask_pii(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none to three times. Texts without words are never taken; rows without a key or source are rows like any other, repeated ones too."""
    mixed = mixing.copied(docs)
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to, for every row; null texts have no tokens."""
    small_batches(spark)
    return bpe.digest(bpe.encode(docs.select("doc_id", "text"), decoded="decoded", block_chars=8_000_000))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The classifier, the mix and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
