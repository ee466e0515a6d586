"""Keys of many fingerprints in one batch."""

import numpy as np
import pandas as pd

from keelson.llm import simhash


def test_every_fingerprint_is_keyed_once(spark):
    values = np.random.default_rng(5).integers(-2 ** 63, 2 ** 63 - 1, 2500)
    nodes = spark.createDataFrame(pd.DataFrame({"fp": values})).coalesce(1)
    want = len(simhash.fuzzy_keys(values.view(np.uint64), True)[0])
    assert simhash.keyed(nodes, True).count() == want
