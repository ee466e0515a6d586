"""An epoch of the autoencoder takes every mini-batch, whatever the number of rows."""

import numpy as np
import pandas as pd

from keelson.operators import autoencoder as ae


def test_an_epoch_has_a_step_for_every_batch(spark):
    x = np.random.default_rng(4).random((3200, 2))
    df = spark.createDataFrame(pd.DataFrame({"rid": np.arange(3200), "cluster_id": np.int32(0), "a": x[:, 0], "b": x[:, 1]}))
    assert ae.steps_of(3200, 32) == 100 and ae.steps_of(6_000_000, 32) == 187_500
    losses = ae.train(df, ["a", "b"], {0: 3200}, epochs=2)[1]
    assert len(losses[0]) == 200


def test_chunks_of_mini_batches_equal_numpy(spark):
    """With chunks of 7 mini-batches the training equals Adam on the batches that `epoch_parts` names, each row once an epoch."""
    x, n = np.random.default_rng(6).random((1000, 3)), 1000
    df = spark.createDataFrame(pd.DataFrame({"rid": np.arange(n), "cluster_id": np.int32(1), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    own, sizes, steps = ae.placed(df, {1: n}, 32, 42).toPandas(), ae.layer_sizes(3), ae.steps_of(n, 32)
    w = ae.initial_weights(sizes, [42, 2])
    state, want = (w, np.zeros(len(w)), np.zeros(len(w)), 0), []
    for epoch in range(2):
        dealt = ae.epoch_parts(42, epoch, 1, steps, 7)
        assert sorted(p for parts in dealt for p in parts) == list(range(ae.PARTS * steps))
        for parts in dealt:
            rows = own[own.part.isin(parts)][["a", "b", "c"]].to_numpy()
            want.append(((ae.forward(state[0], sizes, rows)[-1] - rows) ** 2).mean())
            state = ae.adam(state, ae.gradient(state[0], sizes, rows), ae.step_rate(1e-3, n, 32, steps))
    found, losses = ae.train(df, ["a", "b", "c"], {1: n}, epochs=2, chunk_steps=7)
    assert np.allclose(losses[1], want, rtol=0, atol=1e-9) and np.allclose(found[1], state[0], rtol=0, atol=1e-9)
