"""Exact top-k inner-product search by exhaustive term-at-a-time accumulation.

Vectors become blocks of a bounded number of rows, each a set of postings: per term (dimension) the rows in which it is not
zero and their weights (all rows' weights for a term that many have). Every block of queries meets every block of candidates: query blocks are copied to the groups of
candidate blocks and joined on the group. For such a pair the non-zero terms of the queries scatter their weighted postings
into a dense array of scores; each query keeps its k best of the block, and a ranking over the partial results merges them.
All arithmetic is on integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import stored

CANDIDATE_ROWS = 4_096
QUERY_ROWS = 256
TILE = 512
DENSE = 4
GROUPS_CONF = "spark.sql.shuffle.partitions"
LONG = np.iinfo(np.int64)
PARTIAL = "query_id bigint, query_part bigint, vec_id bigint, score bigint"


def quantised(vector: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where they fit, else as Python's."""
    v = np.floor(scale * vector.astype(np.float64))
    if not len(v) or np.abs(v).max() < 2 ** 62:
        return v.astype(np.int64)
    return np.array([int(x) for x in v], object)


def posted(pairs: list, rows: int) -> tuple:
    """(rows, weights) of a term from its (row, weight) pairs. A term that a quarter of the block's `rows` have gets a weight for each of
    them, zero included, and names none. Weights have the narrowest type that holds them: a block's copies for every group travel."""
    at, weights = [r for r, _ in pairs], [w for _, w in pairs]
    low, high = min(weights), max(weights)
    kind = next((t for t in (np.int16, np.int32) if np.iinfo(t).min <= low and high <= np.iinfo(t).max), np.int64 if max(-low, high) < 2 ** 62 else object)
    if len(at) * DENSE < rows:
        return np.array(at, np.int32), np.array(weights, kind)
    full = np.zeros(rows, kind)
    full[at] = weights
    return None, full


def vector_blocks(df: DataFrame, id_col: str, vector_col: str, rows: int, scale: int) -> DataFrame:
    """block, ids, postings: blocks of at most `rows` vectors, without those that take no part.

    The vectors are dealt out evenly first, else the blocks of a table in many small files would hold a few rows each.
    """
    plain = df.select(F.col(id_col).cast("bigint"), F.transform(F.col(vector_col), lambda x: x.cast("double")))
    plain = plain.repartition(-(-df.count() // rows) or 1)
    schema = df.sparkSession.createDataFrame([], "block bigint, ids array<bigint>, postings binary").schema

    def blocks(batches):
        import pickle
        number, ids, vectors = TaskContext.get().partitionId() << 32, [], []

        def block():
            terms: dict = {}
            for row, v in enumerate(vectors):
                for t in np.flatnonzero(v):
                    terms.setdefault(int(t), []).append((row, v[t]))
            postings = {t: posted(p, len(ids)) for t, p in terms.items()}
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                                               pa.array([pickle.dumps(postings)], pa.binary())], names=["block", "ids", "postings"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if np.isfinite(x).all():
                    ids.append(i)
                    vectors.append(quantised(x, scale))
                    if len(ids) == rows:
                        yield block()
                        number, ids, vectors = number + 1, [], []
        if ids:
            yield block()

    return plain.mapInArrow(blocks, schema)


def accumulate(queries: dict, n_queries: int, candidates: dict, n_candidates: int, kind) -> np.ndarray:
    """Dense scores, of the type `kind`, of all queries against all candidates of two blocks, term by term. Terms that name no rows in
    both blocks are added tile by tile, so that the scores they are added to stay in the cache."""
    scores, whole = np.zeros((n_queries, n_candidates), kind), []
    for term, (rows, weights) in queries.items():
        if term in candidates:
            docs, values = candidates[term]
            weights, values = weights.astype(kind), values.astype(kind)
            if rows is None and docs is None:
                whole.append((weights[:, None], values))
            elif docs is None:
                scores[rows] += weights[:, None] * values
            else:
                scores[np.ix_(np.arange(n_queries) if rows is None else rows, docs)] += weights[:, None] * values
    part = np.empty((n_queries, TILE), kind)
    for at in range(0, n_candidates if whole else 0, TILE):
        tile = scores[:, at:at + TILE]
        near, product = tile.copy(), part[:, :tile.shape[1]]
        for weights, values in whole:
            near += np.multiply(weights, values[at:at + TILE], out=product)
        tile[:] = near
    return scores


def largest(postings: dict) -> int:
    return max((max(-int(w.min()), int(w.max())) for _, w in postings.values()), default=0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, ties to the smaller id: a partition at the k-th score, then a sort of what reaches it."""
    places = np.arange(len(ids))
    if len(ids) > k and scores.dtype != object:
        least = -np.partition(-scores, k - 1)[k - 1]
        places = np.flatnonzero(scores >= least)
    order = sorted(places.tolist(), key=lambda p: (-scores[p], ids[p]))
    return np.array(order[:k], np.int64)


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
                scale: int = 1024, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: every query's k candidates of the highest integer inner product.

    Components become floor(scale * x). Candidates with the query's own identifier are left out; ties go to the smaller
    identifier. Vectors that are null or hold a null or non-finite component, and rows with a null identifier, take no part.
    Dimensions that only one of two vectors has count as zero. Rows that repeat an identifier are searched, and found, each
    by itself. Scores beyond 64 bits are set to the largest or smallest value. Empty tables give an empty result.
    """
    spark = candidates.sparkSession
    q = stored(vector_blocks(queries, id_col, vector_col, query_rows, scale), "query-blocks")
    c = stored(vector_blocks(candidates, id_col, vector_col, candidate_rows, scale), "candidate-blocks")
    groups = max(1, min(int(spark.conf.get(GROUPS_CONF, "200")), c.count()))
    q = q.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("postings").alias("q_postings"),
                 F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    c = c.select("ids", "postings", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"))
    # The copies of the query blocks are sized as the blocks alone, so Spark would gather and broadcast them; that must not happen.
    pairs = c.join(q.hint("merge"), "group").select("q_block", "q_ids", "q_postings", "ids", "postings")

    def search(batches):
        import pickle
        for b in batches:
            for q_block, q_ids, q_post, ids, post in zip(*[b.column(i) for i in range(5)]):
                mine, theirs = pickle.loads(q_post.as_py()), pickle.loads(post.as_py())
                own, ids = q_ids.values.to_numpy(), ids.values.to_numpy()
                bound = largest(mine) * largest(theirs) * max(1, len(mine))
                kind = next((t for t in (np.int32, np.int64) if bound <= np.iinfo(t).max), object)
                scores, out = accumulate(mine, len(own), theirs, len(ids), kind), []
                for row, query in enumerate(own.tolist()):
                    others = np.flatnonzero(ids != query)
                    line = scores[row, others]
                    out += [(query, (q_block.as_py() << 12) + row, int(ids[others[p]]), min(max(int(line[p]), LONG.min), LONG.max))
                            for p in best(line, ids[others], k)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [()] * 4)],
                                                 names=["query_id", "query_part", "vec_id", "score"])

    partial = pairs.mapInArrow(search, PARTIAL)
    order = Window.partitionBy("query_part", "query_id").orderBy(F.desc("score"), "vec_id")
    return (partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
