"""User-visible jobs: clean, cluster, detect, classify, save, and the whole run in order."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as cfg
from ..operators import classify, ensemble, flags, modes, normalize, profile, windows
from ..operators.detectors import DETECTORS
from ..operators.metadata import refresh_metadata
from ..sources import store as st
from ..sources.files import load_raw
from .together import one, together


@dataclass
class RunConfig:
    data: str
    root: str
    skip_eda: bool = False
    skip_metadata: bool = False
    metadata_full_mode: bool = False
    vessel: str | None = None
    only_stage: str | None = None
    methods: tuple = ("svd", "iforest", "autoencoder")
    n_clusters: int = 4
    n_components: int = 3
    threshold_pct: float = 95.0
    random_state: int = 42
    restarts: int = 10
    model_version: str = "clustered_svd_v1"
    trees: int = 100
    epochs: int = 50
    encoding_dim: int = 3

    def folder(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    def store_root(self) -> str:
        return f"{self.root}/results"


def clean(df: DataFrame) -> DataFrame:
    """Draft repair, constraint flags and the moving flag: projections only, so cleaning is one scan."""
    return flags.is_moving(flags.constraint_flags(normalize.null_bad_avg_draft(df)))


def sort_by_time(df: DataFrame, time: str = "Date") -> DataFrame:
    """Range-partitioned by time and sorted inside partitions: ordered files without a single sorted task."""
    return df.repartitionByRange(F.col(time), F.col("rid")).sortWithinPartitions(time, "rid")


def load_and_clean(spark: SparkSession, path: str, config: cfg.VesselConfig | None = None) -> DataFrame:
    return sort_by_time(clean(load_raw(spark, path, config)))


def stage_clean(spark: SparkSession, run: RunConfig) -> dict:
    """Complete rows to the `cleaned` table, the rest to the missing-record table, and the cleaning report."""
    config = cfg.detect_vessel(run.data)
    df = clean(load_raw(spark, run.data, config))
    features = [f for f in config.feature_cols or cfg.DEFAULT.feature_cols if f in df.columns]
    good, bad = flags.split_complete_cases(df, features)
    sort_by_time(good).write.mode("overwrite").parquet(run.folder("cleaned"))
    n_missing = st.ResultStore(spark, run.store_root()).create().append_missing_records(bad, features)
    profile.cleaning_report(df, features).coalesce(1).write.mode("overwrite").parquet(run.folder("cleaning_report"))
    return {"features": features, "n_missing": n_missing}


def _cleaned(spark: SparkSession, run: RunConfig) -> tuple[DataFrame, list]:
    """The cleaned rows, all complete; without that stage all loaded rows, incomplete ones included. And the features."""
    df = st.stage_or(spark, run.folder("cleaned"), lambda: load_and_clean(spark, run.data))
    wanted = cfg.feature_columns(run.data)
    return df, [f for f in wanted if f in df.columns]


def stage_cluster(spark: SparkSession, run: RunConfig) -> dict:
    df, features = _cleaned(spark, run)
    df = df.where(flags.complete(features))
    model = modes.kmeans_modes(df, features, run.n_clusters, run.random_state, run.restarts)
    model.save(spark, run.folder("modes"))
    labelled = model.assign(df)
    labelled.write.mode("overwrite").parquet(run.folder("clustered"))
    stored = spark.read.parquet(run.folder("clustered"))
    modes.cluster_summary(stored, model).coalesce(1).write.mode("overwrite").parquet(run.folder("cluster_summary"))
    st.write_names_json(model.centre_table(spark), run.folder("cluster_names"))
    return {"features": features, "n_clusters": run.n_clusters}


def fit_detector(method: str, df: DataFrame, features, run: RunConfig, shared_modes=None):
    extra = {"svd": {"n_components": run.n_components}, "iforest": {"trees": run.trees},
             "autoencoder": {"epochs": run.epochs, "encoding": run.encoding_dim}}[method]
    return DETECTORS[method].fit(df, features, n_clusters=run.n_clusters, percentile=run.threshold_pct, seed=run.random_state,
                                 restarts=run.restarts, modes=shared_modes, **extra)


def stage_detect(spark: SparkSession, run: RunConfig) -> dict:
    """Fit the detectors on one shared clustering, annotate every row, and write the detector reports.

    Rows that lack a feature are not scored: cluster -1, 'Unknown', anomalous by the constraints alone.
    """
    every, features = _cleaned(spark, run)
    df = every.where(flags.complete(features))
    if not run.methods:
        raise ValueError("no method produced predictions")
    shared = modes.kmeans_modes(df, features, run.n_clusters, run.random_state, run.restarts)

    def fitted(method):
        started = time.time()
        model = fit_detector(method, df, features, run, shared)
        model.save(spark, run.folder(f"detector_{method}"))
        return model, time.time() - started

    found = together(spark, [partial(fitted, m) for m in run.methods])
    models, seconds = ({m: f[i] for m, f in zip(run.methods, found)} for i in (0, 1))
    rows = shared.assign(every)
    for model in models.values():
        rows = model.transform(rows)
    names = shared.centre_table(spark).select("cluster_id", F.col("name").alias("cluster_name"))
    named = ensemble.lookup_cluster_names(rows, names).withColumns({
        "cluster_id": F.coalesce("cluster_id", F.lit(-1)), "cluster_name": F.coalesce("cluster_name", F.lit("Unknown"))})
    annotated = ensemble.annotate(named, list(run.methods))
    annotated.write.mode("overwrite").parquet(run.folder("annotated"))
    annotated = spark.read.parquet(run.folder("annotated"))
    thresholds = {m: model.thresholds for m, model in models.items()}
    reports = {
        "detection_summary": lambda: ensemble.detection_summary(annotated, run.methods, thresholds),
        "method_comparison": lambda: ensemble.method_comparison(annotated, run.methods, seconds),
        "method_recall": lambda: ensemble.constraint_recall(annotated, run.methods),
        "method_agreement": lambda: ensemble.pairwise_agreement(annotated, run.methods),
        "score_histogram": lambda: ensemble.score_histogram(annotated, run.methods),
    }

    def write(build):
        for name, table in build().items():
            (table.coalesce(1) if name in reports else table).write.mode("overwrite").parquet(run.folder(name))

    together(spark, [partial(write, build) for build in [*detect_tables(annotated, features), *(one(n, r) for n, r in reports.items())]])
    return {"methods": list(run.methods), "avg_threshold": ensemble.avg_threshold(thresholds).first()[0]}


def detect_tables(annotated: DataFrame, features) -> list:
    """Groups of the reports on the annotated rows, those that the columns allow; each returns name -> table. Some have a row per
    reading."""
    have = set(annotated.columns)

    def sequences():
        runs = windows.anomaly_runs(annotated)
        return {"anomaly_runs": runs, "anomaly_run_lengths": windows.run_length_histogram(runs)}

    def rolling():
        return windows.rolling_rate(annotated).select("vessel_id", "rid", "Date", "rolling_rate_pct")

    out = [sequences, one("rolling_anomaly_rate", rolling), one("cluster_anomaly_rate", ensemble.cluster_anomaly_rate, annotated),
           one("feature_boxes", ensemble.feature_box_normal_vs_anomaly, annotated, features),
           one("flagged_series", ensemble.flagged_series, annotated, features), one("cluster_pairs", ensemble.cluster_pair_table, annotated)]
    if {"GPS_LAT", "GPS_LON"} <= have:
        out.append(one("spatial_scores", ensemble.spatial_score_table, annotated))
    fuel = next((c for c in cfg.FUEL_COLUMNS if c in have), None)
    if fuel and {"GPSSpeed_kn", "Main_Engine_Power_kW"} <= have:
        out.append(one("power_speed_fuel", ensemble.power_speed_fuel_diag, annotated, fuel=fuel))
    return out


def stage_classify(spark: SparkSession, run: RunConfig) -> dict:
    out = classify.classify_anomalies(spark.read.parquet(run.folder("annotated")))
    out.write.mode("overwrite").parquet(run.folder("classified"))
    done = spark.read.parquet(run.folder("classified"))
    classify.type_breakdown(done).coalesce(1).write.mode("overwrite").parquet(run.folder("type_breakdown"))
    classify.daily_type_pivot(done).write.mode("overwrite").parquet(run.folder("daily_types"))
    return {"n_anomalies": done.where("is_anomaly").count()}


def stage_save(spark: SparkSession, run: RunConfig, avg_threshold: float | None = None) -> dict:
    df = st.classified_or_annotated(spark, run.folder("classified"), run.folder("annotated"))
    if avg_threshold is None:
        avg_threshold = ensemble.saving_threshold(df).first()["threshold"]
    store = st.ResultStore(spark, run.store_root()).create()
    n = df.agg(F.count(F.lit(1)), F.sum(F.col("is_anomaly").cast("bigint"))).first()
    run_id = store.append_detection_run(run.model_version, run.data, n[0], n[1] or 0, avg_threshold, run.n_components, run.threshold_pct)
    logged = store.append_anomalies(df.where("is_anomaly"), avg_threshold, run.model_version)
    st.export_labelled(df, run.folder("export"))
    st.write_report(st.run_report(df, store), run.folder("report"))
    return {"run_id": run_id, "n_anomalies_logged": logged}


def run_all(spark: SparkSession, run: RunConfig) -> dict:
    """The seven stages in order, `only_stage` / `skip_*` honoured; returns one entry per stage that ran."""
    from .eda import run_eda
    results: dict = {}

    def wanted(stage, skip=False):
        return run.only_stage == stage if run.only_stage else not skip

    if wanted("01", run.skip_eda):
        results["01_eda"] = run_eda(spark, run.data, run.folder("eda"))
    if wanted("02", run.skip_metadata):
        results["02_metadata"] = refresh_metadata(spark, run.folder("eda"), run.data if run.metadata_full_mode else None, run.vessel)
    if wanted("03"):
        results["03_cleaning"] = stage_clean(spark, run)
    if wanted("04"):
        results["04_clustering"] = stage_cluster(spark, run)
    if wanted("05"):
        results["05_detection"] = stage_detect(spark, run)
    if wanted("06"):
        results["06_classification"] = stage_classify(spark, run)
    if wanted("07"):
        results["07_saving"] = stage_save(spark, run, results.get("05_detection", {}).get("avg_threshold"))
    return results
