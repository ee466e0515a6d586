"""Thresholds, votes, annotation and the reports on detector output."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import count_where, half_even, null_safe_join, unpivot
from .ordered import attach
from .profile import box_stats, histogram
from .quantiles import quantile, quantiles, with_quantiles

CLUSTER = ("cluster_id",)


def threshold_by_group(df: DataFrame, score: str, percentile: float = 95.0, keys=CLUSTER) -> DataFrame:
    """Percentile of the score per group, as a small (group, threshold) table."""
    return quantile(df, keys, score, percentile / 100.0, "threshold")


def apply_thresholds(df: DataFrame, thresholds: DataFrame, score: str, flag: str, keys=CLUSTER) -> DataFrame:
    """Strictly above the group's threshold; a group without one never fires."""
    limit = F.coalesce(F.col("threshold"), F.lit(float("inf")))
    return attach(df, thresholds, keys).withColumn(flag, F.coalesce(F.col(score) > limit, F.lit(False))).drop("threshold")


def flag_methods(df: DataFrame, methods, percentile: float = 95.0, keys=CLUSTER) -> DataFrame:
    """`is_<m>_anomaly` for several scored methods at once: one quantile pass and one join for all of them."""
    limits = quantiles(df, keys, {f"_t_{m}": f"score_{m}" for m in methods}, [percentile / 100.0])
    out = attach(df, limits, keys).withColumns({
        f"is_{m}_anomaly": F.coalesce(F.col(f"score_{m}") > F.col(f"_t_{m}")[0], F.lit(False)) for m in methods})
    return out.drop(*[f"_t_{m}" for m in methods])


def lookup_cluster_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """Names by cluster id, 'Cluster_<id>' where none is known."""
    default = F.concat(F.lit("Cluster_"), F.col("cluster_id").cast("string"))
    return (df.join(F.broadcast(names), "cluster_id", "left")
            .withColumn("cluster_name", F.coalesce("cluster_name", default)))


def majority_vote(methods) -> Column:
    """At least n // 2 + 1 of the methods that ran; one method decides alone."""
    if not methods:
        raise ValueError("no method produced predictions")
    votes = reduce(lambda a, b: a + b, [F.col(f"is_{m}_anomaly").cast("int") for m in methods])
    return votes >= len(methods) // 2 + 1


def scatter_back(df: DataFrame, scored: DataFrame, methods, on=("rid",)) -> DataFrame:
    """Detector columns joined to the full table; rows that were not scored get false / NULL / -1 / 'Unknown'."""
    cols = ["cluster_id", "cluster_name", *[c for m in methods for c in (f"is_{m}_anomaly", f"score_{m}")]]
    out = df.join(scored.select(*on, *cols), list(on), "left")
    return out.withColumns({
        "cluster_id": F.coalesce("cluster_id", F.lit(-1)), "cluster_name": F.coalesce("cluster_name", F.lit("Unknown")),
        **{f"is_{m}_anomaly": F.coalesce(f"is_{m}_anomaly", F.lit(False)) for m in methods}})


def annotate(df: DataFrame, methods) -> DataFrame:
    """`anomaly_score` (SVD or first method), `is_ensemble_anomaly`, `is_anomaly` = vote or constraint.

    Works on rows that already carry the method columns, unscored rows included.
    """
    primary = "svd" if "svd" in methods else methods[0]
    vote = F.coalesce(majority_vote(methods), F.lit(False))
    rule = F.coalesce(F.col("flag_any_constraint"), F.lit(False)) if "flag_any_constraint" in df.columns else F.lit(False)
    return df.withColumns({"anomaly_score": F.col(f"score_{primary}"), "is_ensemble_anomaly": vote}).withColumn(
        "is_anomaly", F.col("is_ensemble_anomaly") | rule)


def constraint_recall(df: DataFrame, methods, keys=()) -> DataFrame:
    """Share of the constraint rows each method (and the vote) flags; 0 when there are none."""
    names = [*methods, "ensemble"]
    rule = F.col("flag_any_constraint")
    wide = df.groupBy(*keys).agg(*[F.coalesce(F.avg(F.when(rule, F.col(f"is_{m}_anomaly").cast("double"))), F.lit(0.0))
                                   .alias(m) for m in names])
    return wide.unpivot(list(keys), names, "method", "recall")


def detection_summary(df: DataFrame, methods, thresholds: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per cluster: rows, flagged rows, rate and threshold of every method and of the vote."""
    names = [*methods, "ensemble"]
    out = df.where("cluster_id >= 0").groupBy("cluster_id", "cluster_name").agg(
        F.count(F.lit(1)).alias("total"), *[count_where(F.col(f"is_{m}_anomaly")).alias(f"{m}_anomalies") for m in names])
    out = out.withColumns({f"{m}_rate_pct": half_even(F.col(f"{m}_anomalies") / F.col("total") * 100, 2) for m in names})
    for m, t in (thresholds or {}).items():
        out = null_safe_join(out, t.withColumnRenamed("threshold", f"{m}_threshold"), CLUSTER)
    return out


def method_comparison(df: DataFrame, methods, fit_seconds: dict | None = None) -> DataFrame:
    """One row per method, best constraint recall first."""
    rule = F.coalesce(F.col("flag_any_constraint"), F.lit(False)) if "flag_any_constraint" in df.columns else F.lit(False)
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"is_{m}_anomaly").alias("hit"), F.col(f"score_{m}").alias("score"))
                      for m in methods])
    rows = df.select(rule.alias("_rule"), F.inline(cells))
    seconds_of = {m: float((fit_seconds or {}).get(m, 0.0)) for m in methods}
    lookup = F.create_map(*[x for m, v in seconds_of.items() for x in (F.lit(m), F.lit(v))])
    hit = F.col("hit").cast("double")
    return rows.groupBy("method").agg(
        count_where(F.col("hit")).alias("n_anomalies"), half_even(F.avg(hit) * 100, 3).alias("anomaly_rate"),
        half_even(F.coalesce(F.avg(F.when(F.col("_rule"), hit)), F.lit(0.0)) * 100, 1).alias("recall_known"),
        half_even(F.avg("score"), 6).alias("avg_score"), half_even(F.max("score"), 6).alias("max_score")).withColumn(
        "fit_time_sec", half_even(lookup[F.col("method")], 2)).orderBy(F.desc("recall_known"))


def pairwise_agreement(df: DataFrame, methods, keys=()) -> DataFrame:
    """Percent of rows on which two methods agree, for every ordered pair."""
    pairs = list(product(methods, methods))
    wide = df.groupBy(*keys).agg(*[(F.avg((F.col(f"is_{a}_anomaly") == F.col(f"is_{b}_anomaly")).cast("double")) * 100)
                                   .alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), F.col(f"p{i}").alias("agreement_pct"))
        for i, (a, b) in enumerate(pairs)])))


def avg_threshold(thresholds: dict[str, DataFrame], fallback: float = 0.1) -> DataFrame:
    """Mean of the SVD cluster thresholds, else of all thresholds, else 0.1 (one row)."""
    chosen = {"svd": thresholds["svd"]} if "svd" in thresholds else thresholds
    every = reduce(lambda a, b: a.unionByName(b), [t.select("threshold") for t in chosen.values()])
    return every.agg(F.coalesce(F.avg("threshold"), F.lit(fallback)).alias("avg_threshold"))


def saving_threshold(df: DataFrame, fallback: float = 0.1, keys=()) -> DataFrame:
    """5th percentile of the anomalies' scores, else 0.1."""
    out = quantile(df.where("is_anomaly"), keys, "anomaly_score", 0.05, "threshold")
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(fallback)))


def feature_box_normal_vs_anomaly(df: DataFrame, features, keys=("vessel_id",)) -> DataFrame:
    label = F.when(F.coalesce(F.col("is_anomaly"), F.lit(False)), "Anomaly").otherwise("Normal")
    return box_stats(unpivot(df.withColumn("label", label), [*keys, "label"], features), [*keys, "signal", "label"])


def cluster_anomaly_rate(df: DataFrame, keys=("cluster_name",)) -> DataFrame:
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), count_where(F.col("is_anomaly")).alias("anomalies"))
    return out.withColumns({"normal": F.col("total") - F.col("anomalies"),
                            "anomaly_rate": half_even(F.col("anomalies") / F.col("total") * 100, 2)}).orderBy(F.desc("anomaly_rate"))


def spatial_score_table(df: DataFrame, keys=("vessel_id",), extra=("cluster_name",), keep=("rid",)) -> DataFrame:
    """Positioned rows with score (missing = 0), label and the 5th / 99th percentile of the scores."""
    rows = df.na.drop(subset=["GPS_LAT", "GPS_LON"]).withColumn("score", F.coalesce("anomaly_score", F.lit(0.0)))
    q = with_quantiles(rows, keys, {"score": "score"}, [0.05, 0.99], ["p05", "p99"])
    return attach(rows, q, keys).select(*keys, *keep, "GPS_LAT", "GPS_LON", "score", *extra,
                                        F.coalesce(F.col("is_anomaly"), F.lit(False)).alias("is_anomaly"), "score_p05", "score_p99")


def power_speed_fuel_diag(df: DataFrame, keys=("vessel_id",), keep=("rid",), fuel="Fuel_Consumption_t_per_day") -> DataFrame:
    """Speed-power-fuel rows with the colour range (p5, p97) of the scores that have a fuel reading."""
    rows = df.na.drop(subset=["GPSSpeed_kn", "Main_Engine_Power_kW"])
    q = with_quantiles(rows.na.drop(subset=[fuel, "anomaly_score"]), keys, {"score": "anomaly_score"}, [0.05, 0.97], ["p05", "p97"])
    return attach(rows, q, keys).select(*keys, *keep, "GPSSpeed_kn", "Main_Engine_Power_kW", fuel, "is_anomaly", "anomaly_score",
                                        "score_p05", "score_p97")


def flagged_series(df: DataFrame, features, keys=("vessel_id",), time="Date", keep=("rid",)) -> DataFrame:
    """Feature values over time with the anomaly flag, one row per reading."""
    dated = df.where(F.col(time).isNotNull()).withColumn("is_anomaly", F.coalesce(F.col("is_anomaly"), F.lit(False)))
    return unpivot(dated, [*keys, *keep, time, "is_anomaly"], features)


PAIRS = (("GPSSpeed_kn", "Main_Engine_Power_kW"), ("Main_Engine_Power_kW", "Fuel_Consumption_t_per_day"),
         ("Speed_rpm", "Main_Engine_Power_kW"), ("Avg_draft_m", "GPSSpeed_kn"))


def cluster_pair_table(df: DataFrame, pairs=PAIRS, keep=("vessel_id", "rid")) -> DataFrame:
    """Points of each feature pair the data has, with cluster and flag."""
    pairs = [p for p in pairs if set(p) <= set(df.columns)]
    cells = F.array(*[F.struct(F.lit(f"{x}|{y}").alias("pair"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
                      for x, y in pairs])
    return df.select(*keep, F.coalesce("cluster_name", F.lit("Unknown")).alias("cluster_name"),
                     F.coalesce(F.col("is_anomaly"), F.lit(False)).alias("is_anomaly"), F.inline(cells))


def score_histogram(df: DataFrame, methods, bins: int = 69, keys=(), overflow: bool = True) -> DataFrame:
    """Score density per method and label, `bins` cells from 0 to the method's p99.5.

    Higher scores are counted in one more bin, number `bins`, or left out if `overflow` is false.

    `p95` is the reference line of the method.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"score_{m}").alias("score"), F.col(f"is_{m}_anomaly").alias("hit"))
                      for m in methods])
    rows = df.select(*keys, F.inline(cells)).where(F.col("score").isNotNull())
    q = with_quantiles(rows, [*keys, "method"], {"s": "score"}, [0.95, 0.995], ["p95", "cap"])
    rows = attach(rows, q, [*keys, "method"]).where((F.col("score") >= 0) & (F.lit(overflow) | (F.col("score") <= F.col("s_cap"))))
    width = F.col("s_cap") / bins
    b = F.when(F.col("score") > F.col("s_cap"), bins).otherwise(F.least(F.floor(F.col("score") / width).cast("int"), F.lit(bins - 1)))
    label = F.when(F.col("hit"), "anomaly").otherwise("normal")
    counts = rows.groupBy(*keys, "method", label.alias("label"), b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first(width).alias("width"), F.first("s_p95").alias("p95"))
    total = counts.groupBy(*keys, "method", "label").agg(F.sum("count").alias("_t"))
    return null_safe_join(counts, total, [*keys, "method", "label"]).select(
        *keys, "method", "label", "bin", (F.col("bin") * F.col("width")).alias("bin_lo"), "count",
        (F.col("count") / (F.col("_t") * F.col("width"))).alias("density"), "p95")
