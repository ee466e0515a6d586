"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored

MAX_TURNS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest of them: larger neighbours (large star) or smaller ones.

    The smallest neighbour is an aggregate joined back to the edges, so no task holds a node's whole neighbourhood.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = both.join(least, "a")
    if large:
        linked = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where(F.col("a") != F.col("b")).distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one root and no root has another."""
    parents = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    return parents <= 1 and not stars.join(stars.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b): the smallest node that it is linked with. Nodes without edges
    are not listed. Every turn is written to the shared folder."""
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MAX_TURNS):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = stored(_star(_star(now, True), False), "stars")
    raise RuntimeError("the components did not settle")
