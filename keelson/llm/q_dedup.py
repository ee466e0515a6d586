"""Registered queries of the exact and near deduplication operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .exact_dedup import exact_dedup
from .simhash import near_duplicates


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), payload=["doc_id"])


OP8_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256 FROM n JOIN g USING (text_sha256)"""

def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": (op1_simhash, None), "op8_exact_dedup": (op8_exact_dedup, OP8_SQL)}
