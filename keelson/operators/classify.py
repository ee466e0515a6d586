"""Rule-based types for anomalous rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import day_key, half_even, null_safe_join
from .profile import box_stats

OTHER = "multivariate_outlier"
HIGH_SPEED, LOW_POWER, IDLE_SPEED, HIGH_POWER_IDLE = 8.0, 200.0, 1.0, 500.0


def constraint_types() -> dict[str, Column]:
    return {"negative_power": F.col("Main_Engine_Power_kW") < 0, "extreme_trim": F.abs("Trim_m") > 5,
            "invalid_draft": F.col("Avg_draft_m") <= 0}


def context_types(fuel: str = "Fuel_Consumption_t_per_day") -> dict[str, Column]:
    speed, power, used = F.col("GPSSpeed_kn"), F.col("Main_Engine_Power_kW"), F.col(fuel)
    burning = F.when((power > 0) & (used > 0), power / used)
    return {"high_speed_low_power": (speed > HIGH_SPEED) & (power < LOW_POWER),
            "low_speed_high_power": (speed < IDLE_SPEED) & (power > HIGH_POWER_IDLE),
            "fuel_efficiency_outlier": (burning > 200) | (burning < 5)}


def _needs(name: str, fuel: str) -> set:
    return {"negative_power": {"Main_Engine_Power_kW"}, "extreme_trim": {"Trim_m"}, "invalid_draft": {"Avg_draft_m"},
            "fuel_efficiency_outlier": {"Main_Engine_Power_kW", fuel}}.get(name, {"GPSSpeed_kn", "Main_Engine_Power_kW"})


def _matching(rules: dict[str, Column], columns, fuel: str) -> Column:
    hits = [F.when(test, F.lit(name)) for name, test in rules.items() if _needs(name, fuel) <= set(columns)]
    found = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER)))


def classify_rules(df: DataFrame, fuel="Fuel_Consumption_t_per_day") -> DataFrame:
    """All matching types per row, in priority order, as an array."""
    return df.withColumn("types", _matching(constraint_types() | context_types(fuel), df.columns, fuel))


def classify_anomalies(df: DataFrame, fuel="Fuel_Consumption_t_per_day") -> DataFrame:
    """`anomaly_type` (comma list) and `primary_type` (its first entry); normal rows are 'normal'."""
    hit = F.coalesce(F.col("is_anomaly"), F.lit(False))
    tagged = classify_rules(df, fuel)
    return tagged.withColumns({
        "anomaly_type": F.when(hit, F.concat_ws(",", "types")).otherwise("normal"),
        "primary_type": F.when(hit, F.col("types")[0]).otherwise("normal")}).drop("types")


def db_type(columns) -> Column:
    """The three-rule type kept in the result table."""
    return F.concat_ws(",", _matching(constraint_types(), columns, ""))


def type_breakdown(df: DataFrame, keys=("vessel_id",)) -> DataFrame:
    """Count, score and share of each primary type among the anomalies, most frequent first."""
    counts = df.where("is_anomaly").groupBy(*keys, "primary_type").agg(
        F.count(F.lit(1)).alias("count"), F.avg("anomaly_score").alias("avg_score"), F.max("anomaly_score").alias("max_score"))
    total = counts.groupBy(*keys).agg(F.sum("count").alias("_t"))
    return (null_safe_join(counts, total, keys).withColumn("pct", half_even(F.col("count") / F.col("_t") * 100, 2))
            .drop("_t").orderBy(F.desc("count")))


def score_by_type(df: DataFrame, keys=("vessel_id",)) -> DataFrame:
    return box_stats(df.where("is_anomaly"), [*keys, "primary_type"], "anomaly_score").orderBy(F.desc("median"))


TYPES = ("negative_power", "extreme_trim", "invalid_draft", "high_speed_low_power", "low_speed_high_power",
         "fuel_efficiency_outlier", OTHER)


def daily_type_pivot(df: DataFrame, keys=("vessel_id",), time="Date") -> DataFrame:
    """Anomalies per day and primary type, 0 where there are none."""
    hits = df.where(F.col("is_anomaly") & F.col(time).isNotNull())
    return (hits.groupBy(*keys, day_key(time).alias("obs_day")).pivot("primary_type", list(TYPES))
            .agg(F.count(F.lit(1))).na.fill(0))
