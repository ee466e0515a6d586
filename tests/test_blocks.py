"""Passes of the clustering fits over blocks of rows."""

import numpy as np
import pandas as pd

from keelson.operators import exact, modes


def test_passes_read_blocks_and_equal_passes_over_rows(spark, monkeypatch):
    monkeypatch.setattr(exact, "CHUNK", 64)
    x = np.random.default_rng(3).random((1000, 2))
    rows = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).repartition(3)
    packed = exact.blocks(rows, ["a", "b"])
    assert packed.columns == [exact.BLOCK] and 1000 / 64 <= packed.count() <= 1000 / 64 + 3 * 2
    starts = [x[:3], x[5:8]]
    for got, want in zip(modes._lloyd(packed, ["a", "b"], starts, 20, 0), modes._lloyd(rows, ["a", "b"], starts, 20, 0)):
        assert (got[0] == want[0]).all() and got[1] == want[1]


def test_nearest_centres_take_the_first_of_equal_ones():
    x = np.array([[0.0, 0.0], [1.0, 0.0], [0.5, 0.0], [0.9, 0.2]])
    centres = np.array([[1.0, 0.0], [0.0, 0.0], [1.0, 0.0]])
    member, far = modes.nearest_centres(x, centres)
    want = modes.squared_distances(x, centres)
    assert member.argmax(axis=0).tolist() == want.argmin(axis=1).tolist() and (member.sum(axis=0) == 1).all()
    assert (far == want.min(axis=1)).all()
