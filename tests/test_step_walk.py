"""The walk over sorted partitions behind the signal steps."""

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.operators import metadata, ordered, windows

T0 = datetime(2024, 1, 1)
DDL = "vessel_id string, rid bigint, Date timestamp_ntz, x double, y double"


#: Half to even on the decimal form, as bround does.
ROUNDED = {1.00001: 1.0, 1.00005: 1.0, 1.00015: 1.0002}


def readings(n=400):
    rng = np.random.default_rng(5)
    value = lambda: rng.choice([None, 1.0, 1.00001, 1.00005, 1.00015, 2.0], p=[.3, .3, .2, .1, .05, .05])
    return [(rng.choice(["a", "b", None], p=[.1, .7, .2]), i, None if rng.random() < 0.05 else T0 + timedelta(seconds=400 * i), value(), value())
            for i in range(n)] + [("late", n + i, T0, 7.0, None) for i in range(30)]


def test_steps_match_a_plain_loop(spark, large):
    """Partitions of about seven rows: runs, gaps and keys cross them. Also checks against grouping the runs."""
    rows, want, frozen = readings(), [], {}
    for key in {r[0] for r in rows}:
        for s, name in ((3, "x"), (4, "y")):
            prev, run, held = None, 0, {}
            for pos, r in enumerate([r for r in rows if r[0] == key]):
                if r[s] is None:
                    continue
                same = prev is not None and ROUNDED.get(prev[s], prev[s]) == ROUNDED.get(r[s], r[s])
                run += not same
                held.setdefault(run, []).append(r)
                timed = prev is not None and None not in (prev[2], r[2])
                want.append((key, name, pos, r[s], None if prev is None else r[s] - prev[s], (r[2] - prev[2]).total_seconds() if timed else None, run))
                prev = r
            if held:
                long = [len(v) for v in held.values() if None not in (v[0][2], v[-1][2]) and (v[-1][2] - v[0][2]).total_seconds() >= 1200]
                frozen[key, name] = sum(long)
    steps = windows.signal_steps(spark.createDataFrame(rows, DDL), ["x", "y"], order=("rid",))
    got = [tuple(r) for r in steps.select("vessel_id", "signal", "pos", "value", "dv", "dt_s", "run_id").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {(r[0], r[1]): r[2] for r in metadata.frozen_points(steps).collect()} == frozen and sum(frozen.values()) > 20
    untimed = {(r[0], r[1]): r[2] for r in metadata.frozen_points(steps, timed=False).collect()}
    assert untimed["late", "x"] == 30


def test_partitions_grow_in_number_not_in_size(spark, monkeypatch):
    monkeypatch.setattr(ordered, "PART_ROWS", 50)
    rows = ordered.in_sequence(spark.range(2000).select(F.lit("v").alias("k"), "id"), ["k"], ["id"])
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 150


def test_frozen_points_group_no_runs(spark):
    plan = metadata.frozen_points(windows.signal_steps(spark.createDataFrame(readings(50), DDL), ["x", "y"], order=("rid",)))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "run_id" not in text.split("Project")[0] and text.count("Aggregate") == 1


def test_equal_at_four_decimals():
    pairs = [(1.0, 1.00001, True), (1.00005, 1.00015, False), (0.00005, 0.0, True), (0.00015, 0.0002, True), (float("nan"), float("nan"), True),
             (float("nan"), 1.0, False), (float("inf"), float("inf"), True), (1e300, 1e300, True), (-0.0, 0.0, True), (1.0, 2.0, False)]
    a, b, want = (np.array(c) for c in zip(*pairs))
    assert windows._same(a, b).tolist() == want.tolist()


@pytest.mark.parametrize("cut", range(1, 12))
def test_states_of_two_halves_add_up(cut):
    x = [None, 1.0, 1.0, 2.0, None, 2.0, 2.0, None, 3.0, 3.0, 3.0, 3.0]
    batch = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array(["k"] * (hi - lo)), pa.array(range(lo, hi), pa.int64()), pa.array(x[lo:hi], pa.float64())], names=["k", "t", "x"])
    walk = lambda lo, hi: windows.walked(batch(lo, hi), 1, 1, windows.SequenceState(1))[0]
    assert vars(walk(0, cut).followed_by(walk(cut, 12))) == vars(walk(0, 12))
