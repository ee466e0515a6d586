"""The narrow step table and the one counting pass of the quantiles, behind the rule table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import metadata, quantiles, windows
from test_step_walk import DDL, readings


def test_rates_equal_those_of_the_steps(spark, large):
    df = spark.createDataFrame(readings(), DDL)
    rates = windows.rate_table(df, ["x", "y"], order=("rid",), max_step_s=900.0, frozen_s=metadata.FROZEN_SECONDS)
    steps = windows.signal_steps(df, ["x", "y"], order=("rid",), max_step_s=900.0)
    total = lambda rows: {tuple(r[:2]): tuple(r[2:]) for r in rows.collect()}
    want = total(steps.groupBy("vessel_id", "signal").agg(F.count("value"), F.count(F.when(F.col("dv") == 0, 1)), F.count("roc"), F.round(F.sum(F.abs("roc")), 9)))
    frozen = total(metadata.frozen_points(steps))
    for s in ("x", "y"):
        got = total(rates.groupBy("vessel_id", F.lit(s)).agg(F.count(f"_still_{s}"), F.sum(f"_still_{s}"), F.count(f"_rate_{s}"), F.round(F.sum(f"_rate_{s}"), 9)))
        assert {k: v for k, v in got.items() if v[0]} == {k: v for k, v in want.items() if k[1] == s}
        more = total(rates.groupBy("vessel_id", F.lit(s)).agg(F.sum(f"_more_{s}")).where(F.col(f"sum(_more_{s})").isNotNull()))
        assert more == {k: v for k, v in frozen.items() if k[1] == s}
    assert sum(v[0] for v in frozen.values()) > 20 and len(rates.columns) <= 0.5 * len(windows.step_table(df, ["x", "y"], order=("rid",)).columns)


def _unused(*_):
    raise AssertionError("the rows were unpivoted and joined")


@pytest.mark.parametrize("chunk", [1 << 17, 9])
def test_quantiles_count_in_one_wide_pass(spark, monkeypatch, chunk):
    """The same as by joining unpivoted rows, with NULL keys and values, both zeros, infinities and NaN."""
    rng = np.random.default_rng(3)
    special = [None, 0.0, -0.0, float("inf"), float("-inf"), float("nan")]
    rows = [(rng.choice(["a", None, "c"], p=[.1, .6, .3]), float(x), special[rng.integers(6)]) for x in rng.normal(size=600).round(2)] + [("void", None, None)]
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(5)
    call = lambda: {r["k"]: str((r["v"], r["w"])) for r in quantiles.quantiles(df, ["k"], {"v": "v", "w": F.when(~F.isnan("w"), F.col("w"))}, [0.0, 0.1, 0.5, 1.0], 40).collect()}
    monkeypatch.setattr(quantiles, "WIDE_NUMBERS", 0)
    joined = call()
    monkeypatch.setattr(quantiles, "WIDE_NUMBERS", 1000)
    monkeypatch.setattr(quantiles, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(quantiles, "_members", _unused)
    assert call() == joined and set(joined) == {"a", None, "c", "void"}


def test_order_of_doubles():
    x = np.array([float("-inf"), -2.5, -1e-300, 0.0, 1e-300, 2.5, float("inf"), float("nan")])
    codes = quantiles.in_order(x)
    assert (np.diff(codes) > 0).all() and np.array_equal(quantiles.from_order(codes), x, equal_nan=True)
    assert quantiles.in_order(np.array([-0.0, -float("nan")])).tolist() == [codes[3], codes[7]]
