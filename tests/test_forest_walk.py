"""Forest scores by the self-leading nodes, and the samples that a compiled filter prepares."""

import numpy as np
import pandas as pd

from keelson.operators import iforest


def test_walk_equals_plain_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    trees = [iforest.build_tree(x[rng.choice(300, 64, replace=False)], rng) for _ in range(7)]
    want = []
    for row in x:
        total = 0.0
        for t in trees:
            k = 0
            while t["feature"][k] >= 0:
                k = t["left"][k] if row[t["feature"][k]] <= t["split"][k] else t["right"][k]
            total += t["depth"][k]
        want.append(total)
    assert (iforest.path_sums([iforest.walkable(t) for t in trees], x, 7) == want).all()


def test_only_drawn_rows_reach_the_interpreted_lambda(spark, monkeypatch):
    """The same sample with and without the filter, which is in the plan once it may be."""
    n = 5000
    rows = spark.createDataFrame(pd.DataFrame({"rid": np.arange(n), "cluster_id": np.int32(0), "a": np.arange(n) * 1.0}))
    found = []
    for most in (iforest.UNROLLED, 0):
        monkeypatch.setattr(iforest, "UNROLLED", most)
        drawn = iforest.draw_samples(rows, 5, 32, 42, 10)
        assert (drawn._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") > 2) == bool(most)
        found.append(sorted(map(tuple, drawn.select("tree", "rid", "_k").collect())))
    assert found[0] == found[1] and len(found[0]) == 160
