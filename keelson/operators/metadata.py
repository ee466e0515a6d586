"""Per-signal data-quality rules derived from the data, and their cheap refresh from cached reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import config as cfg
from ..functions.columns import count_where, half_even, month_key, null_safe_join, seconds, share, unit_in_name
from .flags import aggregate_signals, fuel_power_envelope, outside_limits, range_quantiles, underway_range
from .normalize import describe_signals, signal_profiles
from .ordered import attach, lagged, settled
from .quantiles import quantiles
from .windows import MAX_STEP_S, rate_table

KEYS = ("vessel_id",)
FROZEN_SECONDS, FROZEN_ROWS, SPIKE_FACTOR = 1200, 12, 3.0


def roc_quantiles(steps: DataFrame, keys=KEYS) -> DataFrame:
    """Median and 99th percentile of the absolute rate of change per signal."""
    q = quantiles(steps.where(F.col("roc").isNotNull()), [*keys, "signal"], {"_q": F.abs("roc")}, [0.5, 0.99])
    return q.select(*keys, "signal", F.col("_q")[0].alias("roc_p50"), F.col("_q")[1].alias("roc_p99"))


def roc_limits(steps: DataFrame, signals, keys=KEYS) -> DataFrame:
    """One row per key of a `rate_table`: `<signal>|roc`, the median and 99th percentile of its absolute rate of change."""
    found = quantiles(steps, keys, {s: f"_rate_{s}" for s in signals}, [0.5, 0.99])
    return found.select(*keys, *[F.col(s).alias(f"{s}|roc") for s in signals])


def roc_by_signal(limits: DataFrame, signals, keys=KEYS) -> DataFrame:
    """The same by signal, for signals that have rates."""
    rows = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(f"`{s}|roc`")[0].alias("roc_p50"), F.col(f"`{s}|roc`")[1].alias("roc_p99")) for s in signals])
    return limits.select(*keys, F.inline(rows)).where("roc_p50 IS NOT NULL")


def signal_dynamics(df: DataFrame, signals, keys=KEYS, time="Date", rid="rid", max_step_s: float = MAX_STEP_S,
                    roc: DataFrame | None = None) -> DataFrame:
    """'stable' when the median rate is below 1e-4 of the signal's range, else 'dynamic'."""
    if roc is None:
        roc = roc_by_signal(roc_limits(rate_table(df, signals, keys, time, (rid,), max_step_s), signals, keys), signals, keys)
    span = aggregate_signals(df, keys, signals, lambda s: {"_range": F.max(s) - F.min(s)})
    relative = F.coalesce("roc_p50", F.lit(0.0)) / (F.col("_range") + 1e-12)
    return null_safe_join(span, roc, [*keys, "signal"]).select(
        *keys, "signal", F.coalesce("roc_p50", F.lit(0.0)).alias("roc_p50"),
        F.when(relative < 1e-4, "stable").otherwise("dynamic").alias("dynamics"))


def consecutive_duplicates(steps: DataFrame, keys=KEYS) -> DataFrame:
    return steps.groupBy(*keys, "signal").agg(count_where(F.col("dv") == 0).alias("n_consecutive_duplicates"))


def _newly_frozen(length: Column, lasted: Column, lasted_before: Column, timed: bool = True) -> Column:
    """By how much a reading raises the number of frozen ones: all of its run on the reading that makes the run long enough, then one
    each. A run counts by its first and last reading, so one without a time takes the run back until a timed one follows."""
    if timed:
        now, then = lasted >= FROZEN_SECONDS, lasted_before >= FROZEN_SECONDS
    else:
        now, then = length >= FROZEN_ROWS, length - 1 >= FROZEN_ROWS
    return F.when(now, length).otherwise(0) - F.when(then, length - 1).otherwise(0)


def frozen_points(steps: DataFrame, keys=KEYS, timed: bool = True) -> DataFrame:
    """Readings in runs of one value (4 decimals) lasting 20 minutes or more; without times, 12 rows or more."""
    more = _newly_frozen(F.col("run_length"), F.col("run_s"), F.col("run_before_s"), timed)
    return steps.groupBy(*keys, "signal").agg(F.sum(more).alias("n_frozen"))


def spike_count(steps: DataFrame, keys=KEYS, roc: DataFrame | None = None) -> DataFrame:
    """Rates above three times the signal's 99th percentile."""
    roc = roc_quantiles(steps, keys) if roc is None else roc
    hit = (F.col("roc_p99") > 0) & (F.abs("roc") > SPIKE_FACTOR * F.col("roc_p99"))
    return attach(steps, roc, [*keys, "signal"]).groupBy(*keys, "signal").agg(count_where(hit).alias("n_spikes"))


def step_findings(steps: DataFrame, limits: DataFrame, signals, keys=KEYS) -> DataFrame:
    """Consecutive duplicates, spikes, frozen points and the longest step, one pass over a `rate_table` and its `roc_limits`."""
    def found(s):
        high = F.col(f"`{s}|roc`")[1]
        return {"_n": F.count(f"_still_{s}"), "n_consecutive_duplicates": count_where(F.col(f"_still_{s}") == 1),
                "n_spikes": count_where((high > 0) & (F.col(f"_rate_{s}") > SPIKE_FACTOR * high)),
                "n_frozen": F.coalesce(F.sum(f"_more_{s}"), F.lit(0)), "max_step_s": F.max("step_us") / 1e6}

    return aggregate_signals(null_safe_join(steps, limits, keys), keys, signals, found).where("_n > 0").drop("_n")


def bimodal_flag(df: DataFrame, signals, keys=KEYS, mid: DataFrame | None = None) -> DataFrame:
    """Many readings near zero and many above half the median, for signals with 100 readings or more. `mid`: the medians, if known."""
    mid = quantiles(df, keys, {f"_m_{s}": s for s in signals}, [0.5]) if mid is None else mid
    rows = attach(df.select(*keys, *signals), mid, keys)

    def shares(s):
        m = F.col(f"_m_{s}")[0]
        return {"n": F.count(s), "m": F.first(m), "near": count_where(F.col(s) < m * 0.05), "high": count_where(F.col(s) > m * 0.5)}

    flag = ((F.col("n") >= 100) & (F.col("m") >= 0.5) & (F.col("near") / F.col("n") > 0.10)
            & (F.col("high") / F.col("n") > 0.20))
    return aggregate_signals(rows, keys, signals, shares).select(
        *keys, "signal", F.coalesce(flag, F.lit(False)).alias("bimodal"))


def seasonal_flag(df: DataFrame, signals, keys=KEYS, time="Date") -> DataFrame:
    """Monthly means more than 20 % of the overall mean apart; needs 500 readings and two months."""
    months = df.groupBy(*keys, month_key(time).alias("_m")).agg(
        *[f(s).alias(f"{s}|{n}") for s in signals for f, n in ((F.sum, "s"), (F.count, "n"))])

    def spread(s):
        total, n = F.col(f"`{s}|s`"), F.col(f"`{s}|n`")
        mean = F.when(F.col("_m").isNotNull(), total / F.nullif(n, F.lit(0)))
        return {"n": F.sum(n), "overall": F.sum(total) / F.nullif(F.sum(n), F.lit(0)), "k": F.count(mean),
                "gap": F.max(mean) - F.min(mean)}

    flag = (F.col("n") >= 500) & (F.col("k") >= 2) & (F.col("gap") / F.nullif(F.abs("overall"), F.lit(0.0)) > 0.20)
    return aggregate_signals(months, keys, signals, spread).select(
        *keys, "signal", F.coalesce(flag, F.lit(False)).alias("seasonal"))


def suspicious_unit(unit: Column, largest: Column) -> Column:
    return ((unit == "m") & (largest > 100)) | ((unit == "kn") & (largest > 80))


def _rules(*parts: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws("; ", *parts), F.lit("")), F.lit("none"))


def hard_filter_rule(lo: Column, hi: Column, negative: Column) -> Column:
    return _rules(F.when(negative, F.lit("remove_negative")),
                  F.when(hi.isNotNull(), F.concat(F.lit("remove_gt_"), hi.cast("string"))),
                  F.when(lo.isNotNull() & (lo != 0), F.concat(F.lit("remove_lt_"), lo.cast("string"))))


def soft_warning_rule(violations: Column, spikes: Column, frozen: Column, envelope: Column) -> Column:
    def counted(c, text):
        return F.when(c > 0, F.concat(c.cast("string"), F.lit(text)))
    return _rules(counted(violations, "_phys_violations"), counted(spikes, "_rate_spikes"),
                  F.when(frozen > 0, F.lit("frozen_periods_detected")), counted(envelope, "_fuel_power_envelope_violations"))


def limits_text(lo: Column, hi: Column) -> Column:
    return (F.when(lo.isNotNull() & hi.isNotNull(), F.concat(lo.cast("string"), F.lit(" – "), hi.cast("string")))
            .when(lo.isNotNull(), F.concat(F.lit(">= "), lo.cast("string")))
            .when(hi.isNotNull(), F.concat(F.lit("<= "), hi.cast("string"))).otherwise(""))


def interpolation_allowed(dynamics: Column, missing: Column, total: Column, longest_gap: Column) -> Column:
    return (dynamics == "stable") & (missing / total < 0.05) & (longest_gap <= 600)


def longest_step(df: DataFrame, keys=KEYS, time="Date", rid="rid") -> DataFrame:
    """Largest time step between rows in ingest order."""
    rows = lagged(df.select(*keys, time, rid), keys, [rid], {"_prev": F.col(time)})
    return rows.groupBy(*keys).agg(F.max(seconds("_prev", time)).alias("max_step_s"))


def longest_missing_run(df: DataFrame, signals, keys=KEYS, time="Date", rid="rid") -> DataFrame:
    """Longest span of missing readings per signal in seconds (the option `gap='missing_run'`)."""
    from .missing import outage_blocks
    blocks = outage_blocks(df, signals, keys, time, rid, at_least=1)
    return blocks.groupBy(*keys, F.col("column").alias("signal")).agg(F.max(seconds("start_ts", "end_ts")).alias("max_run_s"))


def variable_metadata(df: DataFrame, signals, config: cfg.VesselConfig = cfg.DEFAULT, keys=KEYS, time="Date", rid="rid",
                      max_step_s: float = MAX_STEP_S, gap: str = "largest_step", at_least: int = 10) -> DataFrame:
    """The 23-column rule table (plus `bimodal`), one row per key and numeric signal with 10 readings or more."""
    spark, on = df.sparkSession, [*keys, "signal"]
    signals = [s for s in signals if s in df.columns]
    limits = cfg.physical_limits(config)

    def counts(s):
        low, high = outside_limits(s, limits)
        return {"n_total": F.count(F.lit(1)), "n_valid": F.count(s), "vmin": F.min(s).cast("double"),
                "vmax": F.max(s).cast("double"), "n_viol": count_where(low) + count_where(high)}

    base = aggregate_signals(df, keys, signals, counts).where(F.col("n_valid") >= at_least)
    steps = rate_table(df, signals, keys, time, (rid,), max_step_s, FROZEN_SECONDS)
    limits_roc = settled(roc_limits(steps, signals, keys))
    ranges = settled(range_quantiles(df, signals, keys, probs=(0.1, 0.5, 0.9)))
    mid = ranges.select(*keys, *[F.array(F.col(s)[1]).alias(f"_m_{s}") for s in signals])
    edges = ranges.select(*keys, *[F.array(F.col(c)[0], F.col(c)[2]).alias(c) for c in ranges.columns if c not in keys])
    findings = step_findings(steps, limits_roc, signals, keys)
    if gap == "missing_run":
        findings = findings.drop("max_step_s")
    parts = [base, underway_range(df, signals, keys, found=edges).drop("n_moving"), findings.withColumnRenamed("max_step_s", "_gap"),
             signal_dynamics(df, signals, keys, time, rid, max_step_s, roc_by_signal(limits_roc, signals, keys)).drop("roc_p50"),
             bimodal_flag(df, signals, keys, mid), seasonal_flag(df, signals, keys, time)]
    if gap == "missing_run":
        parts.append(longest_missing_run(df, signals, keys, time, rid).withColumnRenamed("max_run_s", "_gap"))
    table = reduce(lambda a, b: null_safe_join(a, b, on), parts)
    if {"Main_Engine_Power_kW", "Fuel_Consumption_rate"} <= set(df.columns):
        outside = fuel_power_envelope(df, config).groupBy(*keys).agg(count_where(F.col("outside_envelope")).alias("_env"))
        table = null_safe_join(table, outside, keys)
    else:
        table = table.withColumn("_env", F.lit(0))
    raw = {std: name for name, std in config.column_map.items()}
    names = cfg.local_table(spark, [(s, raw.get(s, s), cfg.group_of(s, config), *limits.get(s, (None, None))) for s in signals],
                            "signal string, raw_column_name string, feature_group string, lo double, hi double")
    described = describe_signals(signal_profiles(names))
    t = table.join(F.broadcast(described), "signal")
    missing = F.col("n_total") - F.col("n_valid")
    gap_s = F.when(missing > 0, F.coalesce("_gap", F.lit(0.0))).otherwise(0.0)
    envelope = F.when(F.col("signal") == "Main_Engine_Power_kW", F.col("_env")).otherwise(0)
    unit = F.coalesce(F.nullif("unit", F.lit("")), unit_in_name("raw_column_name"))
    return t.select(
        *keys, F.col("signal").alias("variable_name"), "feature_group", "raw_column_name", unit.alias("unit"),
        F.col("description").alias("column_description"), limits_text(F.col("lo"), F.col("hi")).alias("physical_limits"),
        F.concat(F.lit("Q10="), F.col("normal_lo").cast("string"), F.lit(",  Q90="), F.col("normal_hi").cast("string"))
        .alias("normal_operating_range"),
        F.col("dynamics").alias("stable_or_highly_dynamic"), half_even("vmin", 4).alias("observed_min"),
        half_even("vmax", 4).alias("observed_max"), share(missing, "n_total", 3).alias("pct_missing"), missing.alias("n_missing"),
        "n_consecutive_duplicates", "n_spikes", F.col("n_frozen").alias("n_frozen_periods"),
        suspicious_unit(F.col("unit"), F.col("vmax")).alias("suspicious_unit_flag"), F.col("seasonal").alias("seasonal_effects"),
        hard_filter_rule(F.col("lo"), F.col("hi"), F.col("negative_is_anomaly")).alias("hard_filter"),
        soft_warning_rule(F.col("n_viol"), F.col("n_spikes"), F.col("n_frozen"), envelope).alias("soft_warning"),
        interpolation_allowed(F.col("dynamics"), missing, F.col("n_total"), gap_s).alias("interpolation_allowed"),
        (F.col("n_frozen") > 0).alias("remove_repeated_values"),
        F.col("signal").isin(*cfg.ZERO_MEANS_IDLE).alias("treat_low_values_as_idle"), "notes", "bimodal")


def estimate_violations(lo: Column, hi: Column, observed_min: Column, observed_max: Column, missing: Column) -> Column:
    """Violations of new limits guessed from cached quantiles (columns of the univariate report)."""
    valid = F.col("n_total") - missing

    def part(rules, otherwise):
        chain = F
        for share_of, q, test in rules:
            chain = chain.when(test(F.col(q)), F.floor(valid * share_of))
        return chain.otherwise(otherwise)

    low = part([(f, q, lambda c: c >= lo) for f, q in ((.01, "q01"), (.05, "q05"), (.10, "q10"), (.25, "q25"), (.50, "q50"))], F.lit(0))
    high = part([(f, q, lambda c: c > hi) for f, q in ((.01, "q99"), (.05, "q95"), (.10, "q90"), (.25, "q75"))], F.floor(valid * 0.01))
    known = F.col("n_total").isNotNull() & (valid > 0)
    below = F.when(known & (observed_min < lo), F.when(lo == 0, F.col("n_negative")).otherwise(low)).otherwise(0)
    above = F.when(known & (observed_max > hi), high).otherwise(0)
    return (below + above).cast("bigint")


def metadata_patch(metadata: DataFrame, univariate: DataFrame, config: cfg.VesselConfig, keys=KEYS) -> DataFrame:
    """Refresh unit, limits, hard filter and violation count from cached reports; `n_changed` counts new cells.

    Unlike the full derivation it uses the vessel's own limits only and prefers the unit in the raw name.
    """
    limits = cfg.local_table(metadata.sparkSession, [(s, lo, hi) for s, (lo, hi) in config.physical_limits.items()],
                             "variable_name string, _lo double, _hi double")
    cached = univariate.select(*keys, F.col("signal").alias("variable_name"), "n_total", "n_negative",
                               "q01", "q05", "q10", "q25", "q50", "q75", "q90", "q95", "q99")
    t = null_safe_join(metadata, cached, [*keys, "variable_name"]).join(F.broadcast(limits), "variable_name", "left")
    lo, hi = F.col("_lo"), F.col("_hi")
    violations = estimate_violations(lo, hi, F.col("observed_min"), F.col("observed_max"), F.col("n_missing"))
    kept = F.filter(F.transform(F.split("soft_warning", ";"), lambda p: F.trim(p)),
                    lambda p: ~p.isin("none", "") & ~p.contains("_phys_violations"))
    fresh = {
        "unit": F.coalesce(F.nullif(unit_in_name("raw_column_name"), F.lit("")), "unit", F.lit("")),
        "physical_limits": F.when(lo.isNotNull() | hi.isNotNull(), limits_text(lo, hi)).otherwise(
            F.coalesce("physical_limits", F.lit(""))),
        "hard_filter": hard_filter_rule(lo, hi, F.col("variable_name").isin(*cfg.STRICTLY_NON_NEGATIVE) & F.coalesce(lo == 0, F.lit(False))),
        "soft_warning": _rules(F.when(violations > 0, F.concat(violations.cast("string"), F.lit("_phys_violations"))),
                               F.concat_ws("; ", kept)),
    }
    # concat_ws of an empty list is '', which must not leave a dangling separator
    fresh["soft_warning"] = F.regexp_replace(F.regexp_replace(fresh["soft_warning"], "; $", ""), "^$", "none")
    changed = sum([(~F.col(c).eqNullSafe(e)).cast("int") for c, e in fresh.items()], F.lit(0))
    out = t.withColumns({f"_new_{c}": e for c, e in fresh.items()} | {"n_changed": changed})
    return out.select(*[F.col(f"_new_{c}").alias(c) if c in fresh else F.col(c) for c in metadata.columns], "n_changed")


def refresh_metadata(spark: SparkSession, reports: str, raw_path: str | None = None, vessel_id: str | None = None) -> dict:
    """Full derivation when a raw path is given, else a patch of every vessel that has cached metadata."""
    from ..sources.files import load_raw, path_exists
    if raw_path:
        config = cfg.detect_vessel(raw_path)
        df = load_raw(spark, raw_path, config)
        numeric = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
        target = f"{reports}/{config.vessel_id}/metadata"
        variable_metadata(df, numeric, config).write.mode("overwrite").parquet(target)
        return {config.vessel_id: target}
    done = {}
    for config in cfg.VESSELS:
        folder = f"{reports}/{config.vessel_id}"
        if vessel_id in (None, config.vessel_id) and path_exists(spark, f"{folder}/metadata"):
            patched = metadata_patch(spark.read.parquet(f"{folder}/metadata"), spark.read.parquet(f"{folder}/univariate_report"), config)
            patched.drop("n_changed").write.mode("overwrite").parquet(f"{folder}/metadata_patched")
            done[config.vessel_id] = f"{folder}/metadata_patched"
    return done


def apply_quality_rules(df: DataFrame, metadata: DataFrame, signals, keys=KEYS) -> DataFrame:
    """Null readings outside the limits that a signal's hard filter names (extension; off by default)."""
    bound = metadata.where(F.col("variable_name").isin(*signals)).groupBy(*keys).agg(*[
        F.first(F.when(F.col("variable_name") == s, F.regexp_extract("hard_filter", rf"{rule}(-?[0-9.]+)", 1).try_cast("double")),
                ignorenulls=True).alias(f"{s}|{rule}") for s in signals for rule in ("remove_gt_", "remove_lt_")],
        *[F.max(F.when(F.col("variable_name") == s, F.col("hard_filter").contains("remove_negative"))).alias(f"{s}|neg")
          for s in signals])

    def keep(s):
        v = F.col(s)
        bad = ((v > F.col(f"`{s}|remove_gt_`")) | (v < F.col(f"`{s}|remove_lt_`")) | (F.col(f"`{s}|neg`") & (v < 0)))
        return F.when(~F.coalesce(bad, F.lit(False)), v)

    out = attach(df, bound, keys).withColumns({s: keep(s) for s in signals})
    return out.drop(*[f"{s}|{k}" for s in signals for k in ("remove_gt_", "remove_lt_", "neg")])
