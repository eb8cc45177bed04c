"""The corpus pipeline: each stage works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, with the
columns of documents for all but the last.

Defined cases, of every stage: null and empty texts are documents like any other (the classifier scores them by its bias;
all empty ones are one group of copies; none holds a passage; they have no tokens); rows without a doc_id are kept
but for exact copies; very long texts are used whole; of copies the row with the largest doc_id stays, of near copies the
one with the smallest, and rows that share a doc_id are one document there; an empty table passes through; columns
beside those of documents, whatever their names, are passed on (the last stage puts its own `epoch` in place of one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import op2_decontaminate, op3_quality, op7_mixing, op8_simhash, op10_exact
from tessera.llm.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return op3_quality.accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return op10_exact.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return op8_simhash.near_dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return op2_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture at target weights: documents with the epoch that takes them."""
    return op7_mixing.mix(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", clean), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: Three stages (a trained classifier, near copies, edited passages) have no SQL; tests hold each stage, and the whole run on
#: a small table, against brute force.
ORACLE_SQL = None
