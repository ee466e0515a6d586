"""Registered queries of the operators on single texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bloom_lm
from .chat import chat_rotations
from .common import crc32_mod, table
from .language_id import identify, train
from .license_scan import license_scan


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 4) == 2
    classifier = train(docs.where(~held_out))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return identify(rows, classifier).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_mod(F.col("doc_id"), 7) == 2
    model, singles = bloom_lm.train(docs.where(~held_out).select(F.col("text").cast("binary")))
    return bloom_lm.score_texts(docs.select("doc_id", held_out.alias("held_out"), "text"), model, singles, learned=~F.col("held_out"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat_rotations(table(spark, sf_dir, "conversations"))
    ranges = F.transform("masks", lambda m: F.concat_ws("-", m["from"].cast("string"), m["to"].cast("string")))
    return found.withColumn("masks", F.array_join(ranges, ","))


OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS name, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name <> 'system'),
r AS (SELECT t.*, s.speaker, CASE WHEN name = speaker THEN '<|assistant|>' || chr(10) WHEN name = 'system' THEN '<|system|>' || chr(10)
    ELSE '<|user|>' || name || chr(10) END AS head, head || text || '<|end|>' || chr(10) AS segment
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, name, text
    ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(segment) AS pos FROM r),
q AS (SELECT *, pos // 32768 AS part, min(pos) OVER (PARTITION BY conv_id, speaker, pos // 32768) AS start FROM p)
SELECT conv_id, speaker, part, start, string_agg(segment, '' ORDER BY pos) AS rendered,
  coalesce(string_agg(CAST(pos - start + length(head) AS VARCHAR) || '-' || CAST(pos - start + length(segment) AS VARCHAR), ',' ORDER BY pos)
    FILTER (WHERE name = speaker), '') AS masks
FROM q GROUP BY conv_id, speaker, part, start"""


QUERIES = {"op3_chat_rotation": (op3_chat_rotation, OP3_SQL), "op6_bloom_lm": (op6_bloom_lm, None), "op4_language_id": (op4_language_id, None), "op5_license_scan": (op5_license_scan, None)}
