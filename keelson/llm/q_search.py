"""Registered query of the exact search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from .topk import exact_top_k


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.query_id, v.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.qe), len(v.e)) + 1),
  lambda i: q.qe[i] * v.e[i])) AS BIGINT) AS score FROM q JOIN v ON q.query_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

QUERIES = {"op10_top_k": (op10_top_k, OP10_SQL)}
