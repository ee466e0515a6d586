"""The training-corpus pipeline: language identification, exact and near deduplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.common import scratch
from keelson.llm.exact_dedup import exact_dedup
from keelson.llm.language_id import identify, train
from keelson.llm.packing import best_fit_packing
from keelson.llm.simhash import drop_near_duplicates


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier, learned from the labelled ones among them, does not reject."""
    found = identify(docs, train(docs))
    return found.where("NOT rejected").select(*[f"`{c}`" for c in docs.columns])


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the smallest doc_id."""
    return exact_dedup(docs).where("kept").select(*[f"`{c}`" for c in docs.columns])


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints are linked by at most three differing bits, the one with the smallest
    doc_id (a null one only if there is no other). Null and empty texts are one group."""
    return drop_near_duplicates(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return best_fit_packing(docs)


STAGES = [("language_id", known_language), ("exact_dedup", unique_texts), ("near_dedup", distinct_texts), ("packing", packed_sequences)]
#: No SQL expresses the stages together; tests/llm compares them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written as Parquet and read again by the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
