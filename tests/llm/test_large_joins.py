"""Tables whose rows are sized too low by Spark are joined without a broadcast."""

import numpy as np
import pandas as pd

from keelson.llm import simhash, topk


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_query_blocks_are_not_broadcast(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "vec_id bigint, embedding array<float>")
    found = topk.exact_top_k(vectors.where("vec_id % 10 = 0"), vectors, 3, query_rows=2, candidate_rows=7)
    assert "Broadcast" not in plan(found) and found.count() == 18


def test_tiles_and_narrow_weights_equal_plain_products(spark):
    """Terms that all, some or none of the vectors have, weights of every width."""
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (600, 6)) * np.array([1, 1000, 10 ** 6, 1, 1, 1])
    x[rng.random(600) < 0.5, 3] = 0
    x[:, 4] = 0
    x[:, 0] = np.abs(x[:, 0]) + 1
    x[0, 1] = -32768
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = topk.exact_top_k(vectors.where("vec_id % 50 = 0"), vectors, 4, scale=1, query_rows=5, candidate_rows=300).collect()
    scores = x @ x.T
    for q in range(0, 600, 50):
        want = sorted((-int(scores[q, i]), i) for i in range(600) if i != q)[:4]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_fingerprint_keys_are_not_broadcast(spark):
    """They are sized as the fingerprints, which have some 200 keys each."""
    values = np.random.default_rng(3).integers(-2 ** 63, 2 ** 63 - 1, 50)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": np.concatenate([values, values ^ 5])}))
    links = simhash.linked_fingerprints(nodes)
    assert "Broadcast" not in plan(links) and links.count() == 50
