"""Edge cases on hand-made frames."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson import config as cfg
from keelson.functions import columns as X
from keelson.operators import audit, classify, ensemble, flags, metadata, missing, modes, normalize, profile, windows
from keelson.operators.autoencoder import Autoencoder, forward, gradient, initial_weights, layer_sizes
from keelson.operators.iforest import IsolationForest, average_path
from keelson.operators.svd import ClusteredSVD

T0 = datetime(2024, 7, 1)


def series(spark, steps, **cols):
    """Rows at cumulative second offsets."""
    at, rows = 0, []
    for i, s in enumerate(steps):
        at += s
        rows.append(("v", i, T0 + timedelta(seconds=at), *[c[i] for c in cols.values()]))
    ddl = "vessel_id string, rid bigint, Date timestamp_ntz" + "".join(f", {c} double" for c in cols)
    return spark.createDataFrame(rows, ddl)


def one(df):
    return df.collect()[0].asDict()


def test_text_cleanup(spark):
    df = spark.createDataFrame([("  ",), ("",), (" 4.5 ",), ("2.445833333 N",), ("NaN",), (None,)], "c string")
    assert [r[0] for r in df.select(X.blank_to_null("c").isNull()).collect()] == [True, True, False, False, False, True]
    assert [r[0] for r in df.select(X.to_numeric("c")).collect()] == [None, None, 4.5, None, None, None]


def test_mixed_dates(spark):
    df = spark.createDataFrame([("01/07/2024 00:05",), ("2024-08-01 00:00:13.440",), ("2024/08/02 10:00:00",), ("31-12-2024 23:59:59",), ("garbage",), ("2024-07-01T10:00:00+02:00",), ("2024-07-01 10:00:00Z",)], "c string")
    assert [r[0] for r in df.select(X.parse_timestamp("c")).collect()] == [
        datetime(2024, 7, 1, 0, 5), datetime(2024, 8, 1, 0, 0, 13, 440000), datetime(2024, 8, 2, 10), datetime(2024, 12, 31, 23, 59, 59), None, datetime(2024, 7, 1, 8), datetime(2024, 7, 1, 10)]


def test_units_in_names(spark):
    names = ["SPEED THROUGH WATER [kn]", "ME Fuel Mass Net (kg/hr)", "Blr DO Temp In (Â°C)", "AE Emerg DO Mode ()", "x [12]", "plain", "COURSE OVER GROUND [ ° ]"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r[0] for r in df.select(X.unit_in_name("c")).collect()] == ["kn", "kg/hr", "°C", "", "", "", "°"]


def test_vessel_detection():
    assert cfg.detect_vessel("/data/StenaTeknik/x.csv").vessel_id == "stenateknik"
    assert cfg.detect_vessel("/data/none").vessel_id == "default"
    assert cfg.group_of("Nautical_Miles") == "trip" and cfg.group_of("unheard_of") == "other"


def test_sentinel_and_average_draft(spark):
    df = spark.createDataFrame([(5.0, -9999.0, 4.0), (5.0, 6.0, 5.5)], "DRAFTAFT double, DRAFTFWD double, Avg_draft_m double")
    out = normalize.null_bad_avg_draft(normalize.sentinel_to_null(df, cfg.DEFAULT.sentinels)).collect()
    assert [r["Avg_draft_m"] for r in out] == [None, 5.5]


@pytest.mark.parametrize("mid,expected", [(1.99, True), (2.01, False)])
def test_radian_threshold(spark, mid, expected):
    df = spark.createDataFrame([("v", mid, 0.1)], "vessel_id string, GPS_LAT double, GPS_LON double")
    assert (one(normalize.radians_to_degrees(df))["GPS_LAT"] > 90) == expected


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(7.0, 1.0), (7.0, 3.0)], "a double, b double")
    assert [tuple(r) for r in normalize.minmax_scale(df, ["a", "b"]).orderBy("b").collect()] == [(0.0, 0.0), (0.0, 1.0)]


def test_interval_counts(spark):
    df = series(spark, [0, 14, 28, 42, 20, 139, 140, 141])
    assert one(audit.missed_beats(df, 14))["n_missed_beats"] == 1 + 2 + 0 + 9 + 9 + 9
    assert one(audit.irregular_gaps(df, 14))["n_irregular_gaps"] == 1          # only the 20 s step
    gaps = audit.long_gap_catalogue(df, 14).collect()
    assert len(gaps) == 1 and gaps[0]["duration_min"] == 2.35
    row = one(audit.missed_beats(df, 14).withColumn("e", F.col("n_unique") + F.col("n_missed_beats")))
    assert row["e"] == row["n_unique"] + row["n_missed_beats"]


def test_gap_across_midnight_belongs_to_its_start_day(spark):
    df = spark.createDataFrame([("v", 0, datetime(2024, 7, 1, 23, 59)), ("v", 1, datetime(2024, 7, 2, 0, 9))], "vessel_id string, rid bigint, Date timestamp_ntz")
    days = {r["date"]: r["missed_beats"] for r in audit.coverage_by_day(df, 60).collect()}
    assert days == {"2024-07-01": 9, "2024-07-02": 0}


def test_duplicates_and_order(spark):
    df = spark.createDataFrame([("v", i, T0 + timedelta(seconds=s)) for i, s in enumerate([0, 0, 10, 10, 10, 5])], "vessel_id string, rid bigint, Date timestamp_ntz")
    assert {r["n_occurrences"] for r in audit.duplicate_timestamps(df).collect()} == {2, 3}
    assert one(audit.sort_order_check(df))["n_out_of_order"] == 1


@pytest.mark.parametrize("before,blocks", [(2, 0), (3, 1)])
def test_repeated_block_needs_three_rows(spark, before, blocks):
    steps = [14] * before + [1000] + [14] * 5
    df = series(spark, steps, x=[4.0] * len(steps))
    assert one(audit.repeated_blocks(df, ["x"], 14))["n_repeated_blocks"] == blocks


def test_null_run_classes(spark):
    lengths = [1, 2, 3, 4, 200, 201]
    values = [v for n in lengths for v in [1.0] + [None] * n]
    df = series(spark, [10] * len(values), x=values)
    out = missing.outage_blocks(df, ["x"]).orderBy("row_start").collect()
    assert [(r["n_rows"], r["gap_type"]) for r in out] == [
        (2, "isolated"), (3, "isolated"), (4, "short_outage"), (200, "short_outage"), (201, "long_outage")]
    assert out[-1]["row_end"] == len(values) - 1


def test_jaccard_edges(spark):
    df = series(spark, [1] * 4, a=[None, None, 1.0, 1.0], b=[None, None, 2.0, 2.0], c=[1.0] * 4)
    j = {(r["signal_a"], r["signal_b"]): r["jaccard"] for r in missing.comissing_jaccard(df, ["a", "b", "c"]).collect()}
    assert j["a", "b"] == j["b", "a"] == 1.0 and j["c", "c"] == 0.0 and j["a", "c"] == 0.0


@pytest.mark.parametrize("span,frozen", [(1199, 0), (1200, 4)])
def test_frozen_needs_twenty_minutes(spark, span, frozen):
    df = series(spark, [0, 400, 400, span - 800, 60], x=[1.00001, 1.00002, 1.00003, 1.00004, 9.0])
    steps = windows.signal_steps(df, ["x"], order=("rid",), max_step_s=900.0)
    assert one(metadata.frozen_points(steps))["n_frozen"] == frozen


def test_rate_limits(spark):
    df = series(spark, [0, 300, 301, 0], x=[0.0, 300.0, 0.0, 5.0])
    got = [r["roc"] for r in windows.signal_steps(df, ["x"]).orderBy("pos").collect()]
    assert got == [None, 1.0, None, None]


def test_seasonal_thresholds(spark):
    def flag(n, swing, months=2):
        rows = [("v", i, datetime(2024, 1 + i % months, 1), 100.0 + (swing / 2 if i % 2 else -swing / 2)) for i in range(n)]
        df = spark.createDataFrame(rows, "vessel_id string, rid bigint, Date timestamp_ntz, x double")
        return one(metadata.seasonal_flag(df, ["x"]))["seasonal"]
    assert not flag(500, 20.0) and flag(500, 20.2) and not flag(498, 20.2) and not flag(500, 20.2, months=1)


def test_metadata_smoke_frame(spark):
    rng = np.random.default_rng(0)
    rows = [("v", i, datetime(2020, 1, 1) + timedelta(minutes=2 * i), *map(float, (rng.uniform(0, 20), rng.uniform(0, 4000), rng.uniform(0, 120))))
            for i in range(200)]
    df = spark.createDataFrame(rows, "vessel_id string, rid bigint, Date timestamp_ntz, GPSSpeed_kn double, Main_Engine_Power_kW double, Speed_rpm double")
    out = {r["variable_name"]: r for r in metadata.variable_metadata(df, ["GPSSpeed_kn", "Main_Engine_Power_kW", "Speed_rpm"]).collect()}
    assert len(out) == 3 and out["Speed_rpm"]["hard_filter"] == "remove_negative; remove_gt_160.0"
    assert out["GPSSpeed_kn"]["treat_low_values_as_idle"] and out["GPSSpeed_kn"]["pct_missing"] == 0.0


def test_classification_priority(spark):
    df = spark.createDataFrame([(True, -1.0, 9.0, -2.0, 9.0, 1.0), (True, 50.0, 0.0, 5.0, 5.0, 5.0), (True, None, 0.0, 5.0, 9.0, 5.0), (False, -1.0, 0.0, 5.0, 5.0, 5.0)],
                               "is_anomaly boolean, Main_Engine_Power_kW double, Trim_m double, Avg_draft_m double, GPSSpeed_kn double, Fuel_Consumption_t_per_day double")
    out = [(r["anomaly_type"], r["primary_type"]) for r in classify.classify_anomalies(df).collect()]
    assert out == [("negative_power,extreme_trim,invalid_draft,high_speed_low_power", "negative_power"), ("multivariate_outlier",) * 2,
                   ("multivariate_outlier",) * 2, ("normal", "normal")]


def test_threshold_is_strict_and_votes(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (9, 5.0)], "cluster_id int, s double")
    lim = spark.createDataFrame([(0, 1.0)], "cluster_id int, threshold double")
    assert sorted((r["s"], r["hit"]) for r in ensemble.apply_thresholds(df, lim, "s", "hit").collect()) == [(1.0, False), (2.0, True), (5.0, False)]
    votes = spark.createDataFrame([(True, False, False), (True, True, False), (True, True, True)], "is_a_anomaly boolean, is_b_anomaly boolean, is_c_anomaly boolean")
    assert [r[0] for r in votes.select(ensemble.majority_vote(["a", "b", "c"])).collect()] == [False, True, True]
    assert [r[0] for r in votes.select(ensemble.majority_vote(["c"])).collect()] == [False, False, True]
    with pytest.raises(ValueError):
        ensemble.majority_vote([])


def test_recall_without_constraint_rows(spark):
    df = spark.createDataFrame([(False, True, True)], "flag_any_constraint boolean, is_a_anomaly boolean, is_ensemble_anomaly boolean")
    assert {r["recall"] for r in ensemble.constraint_recall(df, ["a"]).collect()} == {0.0}


def test_correlation_of_constant_is_null(spark):
    df = series(spark, [1, 1, 1], a=[1.0, 2.0, 3.0], b=[5.0, 5.0, 5.0])
    assert one(profile.correlation_matrix(df, ["a", "b"]))["corr"] is None


def blobs(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, 1, (n, 3)), rng.normal(20, 1, (n, 3)), [[0.0, 9.0, -9.0]]])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "rid bigint, a double, b double, c double"), x


def test_detectors_find_the_planted_row_and_reload(spark, tmp_path):
    df, x = blobs(spark)
    feats = ["a", "b", "c"]
    shared = modes.kmeans_modes(df, feats, 2, restarts=2)
    for cls, extra in ((ClusteredSVD, {"n_components": 1}), (IsolationForest, {"trees": 60}), (Autoencoder, {"epochs": 15, "batch": 16})):
        model = cls.fit(df, feats, modes=shared, percentile=99.0, **extra)
        rows = model.transform(df).toPandas().sort_values("rid")
        score, flag = rows[f"score_{model.name}"], rows[f"is_{model.name}_anomaly"]
        assert flag.iloc[-1] and 4 <= flag.sum() <= 12, model.name
        assert score.rank(ascending=False).iloc[-1] <= 3 and (score >= 0).all()
        model.save(spark, f"{tmp_path}/{model.name}")
        args = (1,) if cls is ClusteredSVD else ()
        again = cls.load(spark, f"{tmp_path}/{model.name}", *args).transform(df).toPandas().sort_values("rid")
        assert np.allclose(again[f"score_{model.name}"], score)


def test_short_cluster_has_no_model(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(60)] + [(60, 500.0, 500.0), (61, 501.0, 500.0)], "rid bigint, a double, b double")
    model = ClusteredSVD.fit(df, ["a", "b"], n_clusters=2, n_components=3, restarts=2)
    rows = {r["rid"]: r for r in model.transform(df).collect()}
    assert rows[60]["score_svd"] == float("inf") and not rows[60]["is_svd_anomaly"]
    forest = IsolationForest.fit(df, ["a", "b"], n_clusters=2, trees=5, restarts=2)
    assert {r["rid"]: r for r in forest.transform(df).collect()}[60]["score_iforest"] == 0.0


def test_incomplete_rows_are_never_flagged(spark):
    df, _ = blobs(spark, 50)
    model = ClusteredSVD.fit(df, ["a", "b", "c"], n_clusters=2, n_components=1, restarts=1)
    row = one(model.transform(spark.createDataFrame([(1, None, 1.0, 1.0)], "rid bigint, a double, b double, c double")))
    assert row["cluster_id"] is None and row["score_svd"] is None and row["is_svd_anomaly"] is False


def test_autoencoder_gradient_matches_finite_differences():
    sizes = layer_sizes(3, (5, 4), 2)
    w, x = initial_weights(sizes, 3), np.random.default_rng(1).uniform(size=(6, 3))
    g = gradient(w, sizes, x)
    for i in range(0, len(w), 7):
        e = np.zeros_like(w)
        e[i] = 1e-6
        diff = (((forward(w + e, sizes, x)[-1] - x) ** 2).mean() - ((forward(w - e, sizes, x)[-1] - x) ** 2).mean()) / 2e-6
        assert g[i] == pytest.approx(diff, abs=1e-6)


def test_average_path_constants():
    assert list(average_path([1, 2])) == [0.0, 1.0] and average_path(256) == pytest.approx(10.244770, abs=1e-5)


def test_mixture_recovers_two_groups(spark):
    df, x = blobs(spark, 200)
    for kind in ("full", "diag", "spherical"):
        m = modes.gmm_modes(df, ["a", "b", "c"], 2, kind, restarts=1, max_iter=50)
        rows = m.predict_proba(df).toPandas().sort_values("rid")
        labels = rows["cluster_id"].to_numpy()
        assert len(set(labels[:200])) == 1 and len(set(labels[200:400])) == 1 and labels[0] != labels[250], kind
        assert np.allclose(rows["probabilities"].map(sum), 1.0)
        assert m.scores()["bic"] > m.scores()["aic"]
