"""The registered queries of the text operators: each applies one operator to its whole table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, fingerprints, mixing, near, negatives, pages, pii, quality, rules, substrings, topk, toxicity
from .common import small_batches, table as read


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return read(spark, sf_dir, name)


def op1_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find_pii(docs))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digest(bpe.decode(bpe.encode(docs).select("doc_id", "ids")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.digest(quality.scored(docs, table(spark, sf_dir, "labels")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.digest(toxicity.scored(docs, table(spark, sf_dir, "labels")))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = rules.train(docs, table(spark, sf_dir, "labels"))
    return rules.digest(rules.measured(docs), learned)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.mislabelled(table(spark, sf_dir, "embeddings")))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.linked(table(spark, sf_dir, "documents"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_near, op2_pii, op3_bpe, op4_quality, op5_fingerprints, op6_mixing, op7_toxicity, op8_rules, op9_substrings, op10_pages, op11_negatives, op12_alignment, op13_topk)}
ORACLE_SQL: dict[str, str] = {"op9_substrings": substrings.SQL, "op11_negatives": negatives.SQL, "op13_topk": topk.SQL}
