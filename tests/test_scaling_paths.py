"""Slices of any size must give what one slice gives, and what numpy gives."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from keelson.operators import audit, metadata, missing, ordered, profile, windows
from keelson.operators.quantiles import quantiles

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, values, keys=("a", "b")):
    rows = [(keys[i % 3 == 0], i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, rid bigint, v double")


def collect(df):
    return sorted(map(tuple, df.collect()), key=str)


@SLOW
@given(st.lists(st.one_of(st.none(), st.floats(-50, 50).map(lambda x: round(x, 1))), min_size=1, max_size=60))
def test_quantiles_match_numpy(spark, values):
    df = frame(spark, values)
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    for most in (10 ** 6, 8):                       # 8: brackets are narrowed until they hold next to nothing
        out = {r["k"]: (r["q"], r["w"]) for r in quantiles(df, ["k"], {"q": "v", "w": -F.col("v")}, probs, 40, most).collect()}
        assert set(out) == {("a", "b")[i % 3 == 0] for i in range(len(values))}
        for key in out:
            own = [v for i, v in enumerate(values) if v is not None and ("a", "b")[i % 3 == 0] == key]
            for found, side in zip(out[key], (1, -1)):
                assert (found == pytest.approx(np.percentile([side * v for v in own], [100 * p for p in probs]), abs=1e-9)) if own else found is None


def test_quantiles_with_hot_values_and_tiny_sketch(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(4000, 3.0), rng.normal(size=3000), rng.integers(0, 5, 3000).astype(float)])
    df = spark.createDataFrame([("x", float(v)) for v in values], "k string, v double").repartition(8)
    probs = [0.001, 0.05, 0.333, 0.5, 0.77, 0.95, 0.999]
    for most in (10 ** 6, 30):
        got = quantiles(df, ["k"], {"q": "v"}, probs, 100, most).first()["q"]
        assert got == pytest.approx(np.percentile(values, [100 * p for p in probs]), abs=1e-12)


def test_quantiles_of_many_distinct_values_in_narrow_brackets(spark):
    """10**6 distinct values beside a heavy one, with brackets cut down to 500 values."""
    df = spark.range(10 ** 6, numPartitions=8).select((F.col("id") * 1.5 - 7).alias("v")).union(spark.range(400_000).select(F.lit(99.5)))
    want = np.percentile(np.concatenate([np.arange(10 ** 6) * 1.5 - 7, np.full(400_000, 99.5)]), [0.001, 2, 28.576, 50, 99.9])
    got = quantiles(df, [], {"q": "v"}, [0.00001, 0.02, 0.28576, 0.5, 0.999], accuracy=1000, most=500).first()["q"]
    assert got == pytest.approx(want, abs=1e-9)


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(0, 2).map(float)), min_size=1, max_size=50))
def test_runs_and_positions_sliced_equal_plain(spark, values):
    df = frame(spark, values)

    def everything():
        run = ordered.runs(df, ["k"], ["rid"], F.col("v"))
        o = ordered.Ordered(df, ["k"], ["rid"]).position("p").frame(
            lambda w: {"m": F.sum("v").over(w.rowsBetween(-2, 3))}, before=2, after=3).running(
            sums={"s": F.coalesce("v", F.lit(0.0))}, lasts={"l": F.col("v")}).result()
        return collect(run.select("k", "rid", "run_id")), collect(o.select("k", "rid", "p", "m", "s", "l"))

    plain = everything()
    spark.conf.set(ordered.SLICE_CONF, "5")
    try:
        assert everything() == plain
    finally:
        spark.conf.unset(ordered.SLICE_CONF)
    lengths = {}
    for k, rid, run_id in plain[0]:
        lengths[k, run_id] = lengths.get((k, run_id), 0) + 1
    assert sum(lengths.values()) == len(values)


@pytest.mark.parametrize("report", [
    lambda v: audit.time_audit_summary(v, ["DRAFTAFT", "DRAFTFWD"], 300),
    lambda v: missing.outage_blocks(v, ["Main_Engine_Power_kW", "DRAFTAFT"]),
    lambda v: windows.signal_steps(v, ["Main_Engine_Power_kW", "DRAFTAFT"], max_step_s=3600.0),
    lambda v: windows.rolling_mean_centered(v, ["GPSSpeed_kn"], rows=6, at_least=2).select("rid", F.round("roll_GPSSpeed_kn", 9)),
    lambda v: windows.rolling_rate(v.withColumn("is_anomaly", F.col("GPSSpeed_kn") > 9)).select("rid", F.round("rolling_rate_pct", 9)),
    lambda v: profile.box_stats(v, ["vessel_id"], "GPSSpeed_kn"),
    lambda v: metadata.frozen_points(windows.signal_steps(v, ["DRAFTAFT"], order=("rid",))),
    lambda v: profile.ecdf(v, ["GPSSpeed_kn"], points=50),
])
def test_reports_do_not_depend_on_the_slices(spark, report):
    from oracle_check import SF
    from workload.base import vessel
    plain = collect(report(vessel(spark, SF)))
    spark.conf.set(ordered.SLICE_CONF, "60")
    try:
        assert collect(report(vessel(spark, SF))) == plain and plain
    finally:
        spark.conf.unset(ordered.SLICE_CONF)


def test_sample_is_exact_and_repeatable(spark, large):
    from keelson.operators.normalize import sample_n
    df = spark.range(20_000).withColumnRenamed("id", "rid").repartition(4)
    first = {r["rid"] for r in sample_n(df, 300).collect()}
    assert first == {r["rid"] for r in sample_n(df.repartition(9), 300).collect()} and len(first) == 300
    assert sample_n(df, 50_000).count() == 20_000


def test_null_keys_keep_their_rows(spark, large):
    df = spark.createDataFrame([(None, i, float(i)) for i in range(30)] + [("a", i, 1.0) for i in range(30, 40)], "k string, rid bigint, v double")
    out = ordered.lagged(df, ["k"], ["rid"], {"p": F.col("v")})
    assert out.count() == 40 and out.where("k IS NULL AND p IS NOT NULL").count() == 29
    assert {r["k"]: r["v"][0] for r in quantiles(df, ["k"], {"v": "v"}, [0.5]).collect()} == {None: 14.5, "a": 1.0}


def test_a_burst_gets_slices_of_its_own(spark):
    from pyspark.sql import Window
    rows = [("a", i, 1_700_000_000 + (i // 40 if i < 2000 else i * 7)) for i in range(2600)] + [("b", 9000 + i, 1_700_000_000 + 900 * i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, rid bigint, t bigint").withColumn("Date", F.timestamp_seconds("t").cast("timestamp_ntz"))
    spark.conf.set(ordered.SLICE_CONF, "30")
    try:
        got = collect(ordered.trailing_range(df, ["k"], "Date", 60_000_000, lambda w: {"n": F.count("rid").over(w)}).select("k", "rid", "n"))
    finally:
        spark.conf.unset(ordered.SLICE_CONF)
    plain = Window.partitionBy("k").orderBy("t").rangeBetween(-59, 0)
    assert got == collect(df.select("k", "rid", F.count("rid").over(plain).alias("n")))


def test_detectors_do_not_depend_on_the_layout(spark):
    from keelson.operators.autoencoder import Autoencoder
    from keelson.operators.iforest import IsolationForest
    from keelson.operators.modes import ModeModel
    rng = np.random.default_rng(3)
    data = [(i, *map(float, rng.normal(size=3))) for i in range(1500)] + [(2000 + i, 9.0, -9.0, 9.0) for i in range(8)]
    df = spark.createDataFrame(data, "rid bigint, a double, b double, c double")
    modes = ModeModel(["a", "b", "c"], [[0.0, 0.0, 0.0]], [-10.0] * 3, [10.0] * 3)
    for kind, settings_, column in ((IsolationForest, {"trees": 15}, "score_iforest"), (Autoencoder, {"epochs": 2}, "score_autoencoder")):
        found = []
        for parts in (4, 12):
            laid = df.repartition(parts)
            model = kind.fit(laid, ["a", "b", "c"], modes=modes, **settings_)
            found.append({r["rid"]: (round(r[column], 9), r[f"is_{model.name}_anomaly"]) for r in model.transform(laid).collect()})
        assert found[0] == found[1] and any(flag for _, flag in found[0].values())
    with pytest.raises(Exception, match="rid is null"):
        IsolationForest.fit(df.withColumn("rid", F.lit(None).cast("bigint")), ["a", "b", "c"], modes=modes, trees=3)


def blobs(spark, n=3000, centres=((0, 0, 0), (6, 0, 3), (0, 8, -3))):
    rng = np.random.default_rng(5)
    data = [(i, *map(float, rng.normal(centres[i % len(centres)], 0.5))) for i in range(n)]
    return spark.createDataFrame(data, "rid bigint, a double, b double, c double")


def test_clustering_does_not_depend_on_the_layout(spark):
    from keelson.operators.modes import gmm_modes, kmeans_modes
    df, found = blobs(spark), []
    for parts in (4, 12):
        laid = df.repartition(parts)
        means = kmeans_modes(laid, ["a", "b", "c"], 3)
        mixtures = [gmm_modes(laid, ["a", "b", "c"], 3, kind, restarts=2) for kind in ("full", "diag", "spherical")]
        found.append((means.centres, [(m.means.tolist(), m.covariances.tolist(), m.log_likelihood) for m in mixtures]))
    assert found[0] == found[1]
    assert np.abs(np.sort(np.array(found[0][0]), axis=0) - np.sort([(0, 0, 0), (6, 0, 3), (0, 8, -3)], axis=0)).max() < 0.1
    assert all(m.converged and m.weights.max() < 0.36 for m in mixtures)


def test_kmeans_equals_plain_iterations(spark):
    """Every restart ends where plain Lloyd iterations from the same start end, and the cheapest wins."""
    from keelson.operators import modes
    df = blobs(spark, 900, ((0, 0, 0), (2, 0, 1), (0, 2, -1), (2, 2, 0)))
    vectors, lo, hi = modes._scaled_vectors(df, ["a", "b", "c"])
    x = vectors.select("a", "b", "c").toPandas().to_numpy()
    starts, variance = modes._starts(vectors, ["a", "b", "c"], 4, 42, 3)
    assert variance == pytest.approx(x.var(axis=0).mean())
    for start, (centres, cost) in zip(starts, modes._lloyd(vectors, ["a", "b", "c"], starts, 300, 1e-8)):
        c = start
        for _ in range(300):
            own = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([x[own == j].mean(axis=0) for j in range(4)])
            if ((new - c) ** 2).sum() <= 1e-8:
                break
            c = new
        assert np.allclose(centres, c, atol=1e-9) and np.isclose(cost, ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1).sum())
    with pytest.raises(ValueError, match="no complete row"):
        modes.kmeans_modes(df.where("false").withColumn("a", F.lit(None).cast("double")), ["a", "b", "c"], 2)


def test_one_cluster_and_equal_rows(spark):
    from keelson.operators.modes import kmeans_modes
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(20)], "rid bigint, a double, b double")
    assert kmeans_modes(same, ["a", "b"], 3).centres == [[1.0, 2.0]] * 3
    assert kmeans_modes(blobs(spark, 60), ["a"], 1).centres[0][0] == pytest.approx(blobs(spark, 60).agg({"a": "avg"}).first()[0], abs=1e-8)


def test_exact_sums_do_not_depend_on_the_order(spark):
    from keelson.operators.exact import SCALE, fixed, row_sums
    rng = np.random.default_rng(1)
    values = rng.normal(0, 100, 30_000) * 10.0 ** rng.integers(-9, 1, 30_000)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    sums = [row_sums(df.repartition(p), ["v"], 1, lambda x: np.array([fixed(x[:, 0]).sum()]))[0] for p in (1, 5, 16)]
    assert sums[0] == sums[1] == sums[2] and abs(sums[0] - values.sum()) < len(values) / SCALE


def test_autoencoder_losses_equal_numpy(spark):
    """The training equals mini-batch Adam in numpy on the same batches, whatever the layout."""
    from keelson.operators import autoencoder as ae
    rng = np.random.default_rng(2)
    data = [(i, i % 2, *map(float, rng.uniform(size=3))) for i in range(1400)] + [(5000 + i, 2, 0.5, 0.5, 0.1 * i / 60) for i in range(60)]
    df, columns, rows = spark.createDataFrame(data, "rid bigint, cluster_id int, a double, b double, c double"), ["a", "b", "c"], {0: 700, 1: 700, 2: 60}
    place = ae.placed(df, rows, 32, 42).toPandas()
    sizes, want = ae.layer_sizes(3), {}
    for c, n in rows.items():
        own, steps = place[place.cluster_id == c], ae.steps_of(n, 32)
        w = ae.initial_weights(sizes, [42, c + 1])
        state, want[c] = (w, np.zeros(len(w)), np.zeros(len(w)), 0), []
        for epoch in range(3):
            for parts in ae.epoch_parts(42, epoch, c, steps):
                x = own[own.part.isin(parts)][columns].to_numpy()
                if len(x):
                    want[c].append(((ae.forward(state[0], sizes, x)[-1] - x) ** 2).mean())
                    state = ae.adam(state, ae.gradient(state[0], sizes, x), ae.step_rate(1e-3, n, 32, steps))
    got = [ae.train(df.repartition(p), columns, rows, epochs=3) for p in (4, 12)]
    assert got[0][1] == got[1][1] and all((got[0][0][c] == got[1][0][c]).all() for c in rows)
    for c in rows:
        assert len(want[c]) == 3 * ae.steps_of(rows[c], 32) and np.allclose(got[0][1][c], want[c], rtol=0, atol=1e-8)
    assert ae.steps_of(10 ** 9, 32) == ae.MAX_STEPS
