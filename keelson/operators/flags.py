"""Row predicates and the reports built on them. Flags are never NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as cfg
from ..functions.columns import all_of, any_of, count_where, half_even, null_safe_join, share
from .ordered import attach
from .quantiles import quantiles, with_quantiles


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def constraint_flags(df: DataFrame) -> DataFrame:
    """flag_negative_power / flag_extreme_trim / flag_invalid_draft for the columns present, and their OR."""
    rules = {"flag_negative_power": ("Main_Engine_Power_kW", lambda c: c < 0),
             "flag_extreme_trim": ("Trim_m", lambda c: F.abs(c) > 5),
             "flag_invalid_draft": ("Avg_draft_m", lambda c: c <= 0)}
    flags = {name: _flag(test(F.col(c))) for name, (c, test) in rules.items() if c in df.columns}
    return df.withColumns({**flags, "flag_any_constraint": any_of(list(flags.values()))})


def is_moving(df: DataFrame, speed: str = "GPSSpeed_kn", above: float = 0.5) -> DataFrame:
    return df.withColumn("is_moving", _flag(F.col(speed) > above)) if speed in df.columns else df


def complete(features) -> Column:
    return all_of([F.col(f).isNotNull() for f in features])


def split_complete_cases(df: DataFrame, features) -> tuple[DataFrame, DataFrame]:
    return df.where(complete(features)), df.where(~complete(features))


def constraint_violation_report(df: DataFrame, keys=("vessel_id",)) -> DataFrame:
    """Count and share of rows per named check; -1 where a column is missing."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[(count_where(F.expr(sql)) if set(needs) <= set(df.columns) else F.lit(None).cast("bigint")).alias(f"_c{i}")
          for i, (sql, needs) in enumerate(cfg.CONSTRAINT_CHECKS.values())])
    rows = F.array(*[F.struct(F.lit(label).alias("check"), F.coalesce(F.col(f"_c{i}"), F.lit(-1)).alias("count"),
                              F.coalesce(share(f"_c{i}", "_n", 4), F.lit(-1.0)).alias("pct"))
                     for i, label in enumerate(cfg.CONSTRAINT_CHECKS)])
    return counts.select(*keys, F.inline(rows))


def missing_reason(df: DataFrame, features, time: str = "Date") -> DataFrame:
    names = F.concat_ws(",", *[F.when(F.col(f).isNull(), f) for f in features if f in df.columns])
    return df.withColumns({
        "reason": F.when(names != "", "missing_feature_data").when(F.col(time).isNull(), "missing_timestamp")
        .otherwise("invalid_record"),
        "missing_columns": F.nullif(names, F.lit(""))})


def outside_limits(signal: str, limits: dict) -> tuple[Column, Column]:
    """(below, above) predicates for one signal; open or unknown bounds never fire."""
    lo, hi = limits.get(signal, (None, None))
    return (F.col(signal) < lo if lo is not None else F.lit(False),
            F.col(signal) > hi if hi is not None else F.lit(False))


def physical_limit_flags(df: DataFrame, signals, limits: dict | None = None, keys=("vessel_id",)) -> DataFrame:
    """Per signal: readings below / above its physical limits (`config.physical_limits` of a vessel)."""
    limits = cfg.physical_limits() if limits is None else limits
    return aggregate_signals(df, keys, signals, lambda s: dict(zip(
        ("n_below", "n_above"), map(count_where, outside_limits(s, limits)))))


#: Aggregates that one pass takes: more columns than some hundred, counting the sums behind a deviation, are not compiled.
AT_ONCE = 36


def aggregate_signals(df: DataFrame, keys, signals, metrics) -> DataFrame:
    """Wide aggregates, reshaped to one row per (key, signal). `metrics(signal) -> {name: aggregate}`.

    The data is never unpivoted: only the aggregated row of each key is. Many signals are taken in groups, a scan each.
    """
    per = {s: metrics(s) for s in signals}
    most = max(1, AT_ONCE // max(map(len, per.values()), default=1))

    def some(group):
        wide = df.groupBy(*keys).agg(*[c.alias(f"{s}|{m}") for s in group for m, c in per[s].items()])
        return wide.select(*keys, F.inline(F.array(*[
            F.struct(F.lit(s).alias("signal"), *[F.col(f"`{s}|{m}`").alias(m) for m in per[s]]) for s in group])))

    names = list(per)
    return reduce(DataFrame.unionByName, [some(names[i:i + most]) for i in range(0, max(len(names), 1), most)])


def fuel_power_envelope(df: DataFrame, config: cfg.VesselConfig, fuel="Fuel_Consumption_rate",
                        power="Main_Engine_Power_kW") -> DataFrame:
    expected = F.col(fuel) * config.fuel_power_slope
    outside = ((F.col(power) < expected + config.fuel_power_offset_low)
               | (F.col(power) > expected + config.fuel_power_offset_high))
    return df.withColumn("outside_envelope", _flag(outside))


def select_anomalies(df: DataFrame) -> DataFrame:
    return df.where("is_anomaly")


def power_speed_flags(df: DataFrame, keys=("vessel_id",), power="Main_Engine_Power_kW",
                      speed="GPSSpeed_kn") -> DataFrame:
    p, s = F.col(power), F.col(speed)
    return df.where(p.isNotNull() & s.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_valid"), count_where(p < 0).alias("n_negative_power"),
        count_where((s == 0) & (p > 0)).alias("n_power_at_rest"),
        F.max(p).alias("max_power"), F.max(s).alias("max_speed"))


def high_power_low_speed(df: DataFrame, keys=("vessel_id",), power="Main_Engine_Power_kW",
                         speed="GPSSpeed_kn") -> DataFrame:
    """Rows with power above its upper and speed below its lower quartile (among non-negative pairs)."""
    valid = df.where((F.col(power) >= 0) & (F.col(speed) >= 0))
    q = with_quantiles(valid, keys, {"p": power, "s": speed}, [0.25, 0.75], ["q25", "q75"])
    hit = (F.col(power) > F.col("p_q75")) & (F.col(speed) < F.col("s_q25"))
    return attach(valid, q, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_valid"), count_where(hit).alias("n_high_power_low_speed"))


def simultaneous_failure(df: DataFrame, sensors=cfg.PRIORITY_SENSORS, at_least: int = 3, time: str = "Date",
                         keep=("vessel_id",)) -> DataFrame:
    """Rows on which at least three priority sensors are missing together; none if fewer are present."""
    present = [s for s in sensors if s in df.columns]
    missing = reduce(lambda a, b: a + b, [F.col(s).isNull().cast("int") for s in present], F.lit(0))
    return (df.withColumns({"timestamp": F.col(time), "n_sensors_missing": missing})
            .where((F.col("n_sensors_missing") >= at_least) & F.lit(len(present) >= at_least))
            .select(*keep, "timestamp", "n_sensors_missing", *present))


def spatial_valid_rows(df: DataFrame, lat="GPS_LAT", lon="GPS_LON") -> DataFrame:
    return df.na.drop(subset=[lat, lon])


def range_quantiles(df: DataFrame, signals, keys=("vessel_id",), speed="GPSSpeed_kn", above: float = 0.5, probs=(0.1, 0.9)) -> DataFrame:
    """Quantiles of every signal, and as `<signal>|m` over underway rows alone, in one call."""
    under = {f"{s}|m": F.when(F.col(speed) > above, F.col(s)) for s in signals}
    return quantiles(df, keys, {**{s: s for s in signals}, **under}, probs)


def underway_range(df: DataFrame, signals, keys=("vessel_id",), speed="GPSSpeed_kn", above: float = 0.5,
                   at_least: int = 100, found: DataFrame | None = None) -> DataFrame:
    """Q10/Q90 per signal over underway rows when there are more than 100 of them, else over all rows. `found`: the
    `range_quantiles`, if known."""
    moving = F.col(speed) > above
    found = range_quantiles(df, signals, keys, speed, above) if found is None else found
    counts = df.groupBy(*keys).agg(*[F.count(F.when(moving, F.col(s))).alias(f"{s}_nm") for s in signals])
    joined = null_safe_join(found, counts, keys)

    def pick(s, i):
        use = (F.col(f"{s}_nm") > at_least) if s != speed else F.lit(False)
        return half_even(F.when(use, F.col(f"`{s}|m`")[i]).otherwise(F.col(s)[i]), 4)

    return joined.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), F.col(f"{s}_nm").alias("n_moving"), pick(s, 0).alias("normal_lo"),
                 pick(s, 1).alias("normal_hi")) for s in signals])))
