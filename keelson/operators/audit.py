"""Time-axis audit. Every operator works on distinct timestamps, counted with map-side combine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import (any_of, col, count_where, day_key, half_even, month_key, null_safe_join, seconds,
                                 share)
from .ordered import Ordered, lagged
from .quantiles import quantile, quantiles

KEYS = ("vessel_id",)


def temporal_coverage(df: DataFrame, keys=KEYS, time="Date", rid="rid", per_day: bool = False) -> DataFrame:
    """Records per day with the key's median and largest gap (or, per_day, those of each day)."""
    narrow = df.where(F.col(time).isNotNull()).select(*keys, time, rid)
    rows = lagged(narrow, keys, [time, rid], {"_prev": F.col(time)})
    rows = rows.select(*keys, day_key(time).alias("date"), seconds("_prev", time).alias("_gap"))
    gap_keys = [*keys, "date"] if per_day else list(keys)
    days = rows.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("records"))
    largest = rows.groupBy(*gap_keys).agg(F.max("_gap").alias("max_gap_sec"))
    return null_safe_join(null_safe_join(days, quantile(rows, gap_keys, "_gap", 0.5, "median_gap_sec"), gap_keys),
                          largest, gap_keys)


def timestamp_counts(df: DataFrame, keys=KEYS, time="Date") -> DataFrame:
    return df.where(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n"))


def duplicate_timestamps(df: DataFrame, keys=KEYS, time="Date") -> DataFrame:
    """Timestamps on more than one row, most repeated first."""
    return (timestamp_counts(df, keys, time).where("n > 1")
            .select(*keys, F.col(time).alias("timestamp"), F.col("n").alias("n_occurrences"),
                    month_key(time).alias("month")).orderBy(F.desc("n_occurrences")))


def duplicate_summary(df: DataFrame, keys=KEYS, time="Date") -> DataFrame:
    return timestamp_counts(df, keys, time).groupBy(*keys).agg(
        F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_unique"), count_where(F.col("n") > 1).alias("n_dup_ts"),
        F.sum(F.col("n") - 1).alias("n_dup_rows"),
        share(F.sum(F.col("n") - 1), F.sum("n"), 3).alias("pct_dup"))


def sort_order_check(df: DataFrame, keys=KEYS, time="Date", rid="rid") -> DataFrame:
    """Backward time steps between rows in ingest order."""
    rows = lagged(df.where(F.col(time).isNotNull()).select(*keys, time, rid), keys, [rid], {"_prev": F.col(time)})
    return rows.groupBy(*keys).agg(count_where(F.col(time) < F.col("_prev")).alias("n_out_of_order")).withColumn(
        "is_sorted", F.col("n_out_of_order") == 0)


def distinct_timestamps(df: DataFrame, keys=KEYS, time="Date") -> DataFrame:
    return df.where(F.col(time).isNotNull()).select(*keys, time).distinct()


def time_steps(df: DataFrame, keys=KEYS, time="Date") -> DataFrame:
    """Distinct timestamps with the step to the next one; the key's last timestamp has none."""
    return (Ordered(timestamp_counts(df, keys, time), keys, [time])
            .frame(lambda w: {"next_ts": F.lead(time).over(w)}, after=1).result()
            .withColumn("step_s", seconds(time, "next_ts")))


def tolerance(interval_s: float) -> int:
    return max(2, int(interval_s * 0.05))


def missed_beats_of(step, interval_s: float):
    return F.coalesce(F.greatest(F.lit(0.0), half_even(col(step) / interval_s) - 1), F.lit(0.0)).cast("bigint")


def interval_stats(df: DataFrame, interval_s: float, keys=KEYS, time="Date", steps: DataFrame | None = None) -> DataFrame:
    steps = time_steps(df, keys, time) if steps is None else steps
    tol = tolerance(interval_s)
    near = F.col("step_s").between(interval_s - tol, interval_s + tol)
    out = steps.groupBy(*keys).agg(share(count_where(near), F.count("step_s"), 2).alias("pct_at_expected"))
    mid = quantile(steps, keys, "step_s", 0.5, "_m")
    return null_safe_join(out, mid, keys).select(*keys, half_even("_m", 1).alias("median_interval_sec"), "pct_at_expected")


def interval_distribution(df: DataFrame, keys=KEYS, time="Date", steps: DataFrame | None = None) -> DataFrame:
    """Mean, p95, p99, max interval, and the most common interval in whole seconds (smallest on ties)."""
    steps = (time_steps(df, keys, time) if steps is None else steps).where(F.col("step_s").isNotNull())
    q = quantiles(steps, keys, {"q": "step_s"}, [0.5, 0.95, 0.99])
    basic = steps.groupBy(*keys).agg(F.avg("step_s").alias("mean"), F.max("step_s").alias("max"))
    counted = steps.groupBy(*keys, half_even("step_s").alias("s")).agg(F.count(F.lit(1)).alias("c"))
    common = counted.groupBy(*keys).agg(F.min_by("s", F.struct(-F.col("c"), "s")).alias("most_common_interval"))
    return null_safe_join(null_safe_join(basic, q, keys), common, keys).select(
        *keys, half_even(F.col("q")[0], 4).alias("median_interval"), half_even("mean", 4).alias("mean_interval"),
        half_even(F.col("q")[1], 4).alias("p95_interval"), half_even(F.col("q")[2], 4).alias("p99_interval"),
        half_even("max", 4).alias("max_interval"), "most_common_interval")


def missed_beats(df: DataFrame, interval_s: float, keys=KEYS, time="Date", steps: DataFrame | None = None) -> DataFrame:
    steps = time_steps(df, keys, time) if steps is None else steps
    n, missed = F.count(F.lit(1)), F.sum(missed_beats_of("step_s", interval_s))
    return steps.groupBy(*keys).agg(n.alias("n_unique"), missed.alias("n_missed_beats"),
                                    share(n, n + missed, 2).alias("pct_coverage"))


def coverage_by_day(df: DataFrame, interval_s: float, keys=KEYS, time="Date", steps: DataFrame | None = None) -> DataFrame:
    """Records, missed beats and coverage per day; a step is charged to the day it starts on."""
    steps = time_steps(df, keys, time) if steps is None else steps
    days = steps.groupBy(*keys, day_key(time).alias("date")).agg(
        F.count(F.lit(1)).alias("n_records"), F.sum(missed_beats_of("step_s", interval_s)).alias("missed_beats"))
    expected = F.col("n_records") + F.col("missed_beats")
    return days.withColumns({"n_expected": expected, "pct_coverage": share("n_records", F.greatest(expected, F.lit(1)), 2)})


def outer_align_daily(records: DataFrame, missed: DataFrame, keys=KEYS, day="date") -> DataFrame:
    """Full outer alignment of two per-day tables, absent counts as 0."""
    on = [*keys, day]
    return records.join(missed, on, "full_outer").na.fill(0)


def irregular_gaps(df: DataFrame, interval_s: float, keys=KEYS, time="Date", steps: DataFrame | None = None) -> DataFrame:
    steps = time_steps(df, keys, time) if steps is None else steps
    return steps.groupBy(*keys).agg(count_where(_irregular(interval_s)).alias("n_irregular_gaps"))


def _irregular(interval_s):
    s = F.col("step_s")
    off = F.least(s % interval_s, interval_s - s % interval_s)
    return (s >= 2) & (s < 10 * interval_s) & (off > tolerance(interval_s))


def long_gap_catalogue(df: DataFrame, interval_s: float, keys=KEYS, time="Date", steps: DataFrame | None = None) -> DataFrame:
    """Every step longer than ten intervals."""
    steps = time_steps(df, keys, time) if steps is None else steps
    return steps.where(F.col("step_s") > 10 * interval_s).select(
        *keys, F.col(time).alias("gap_start"), F.col("next_ts").alias("gap_end"),
        half_even(F.col("step_s") / 60, 2).alias("duration_min"), half_even(F.col("step_s") / 3600, 3).alias("duration_h"),
        missed_beats_of("step_s", interval_s).alias("missed_beats"),
        month_key(time).alias("month"), day_key(time).alias("day"))


def gap_neighbourhood(df: DataFrame, signals, interval_s: float, keys=KEYS, time="Date", rid="rid", rows: int = 10) -> DataFrame:
    """One row per long gap: count, first, min and max of each signal in the rows around its end."""
    def cols(w):
        sides = {"pre": w.rowsBetween(-rows, -1), "post": w.rowsBetween(0, rows - 1)}
        out = {"gap_s": seconds(F.lag(time).over(w), F.col(time))}
        for side, f in sides.items():
            out[f"n_{side}"] = F.count(F.lit(1)).over(f)
            for s in signals:
                out[f"{s}_{side}"] = F.struct(F.first(s).over(f).alias("first"), F.min(s).over(f).alias("lo"),
                                              F.max(s).over(f).alias("hi"))
        return out

    narrow = df.where(F.col(time).isNotNull()).select(*keys, time, rid, *signals)
    return (Ordered(narrow, keys, [time, rid]).frame(cols, before=rows, after=rows - 1).result()
            .where(F.col("gap_s") > 10 * interval_s))


def repeated_blocks(df: DataFrame, signals, interval_s: float, keys=KEYS, time="Date", rid="rid") -> DataFrame:
    """Long gaps with some signal stuck at one and the same value on both sides (three rows or more each)."""
    signals = list(signals)
    around = gap_neighbourhood(df, signals, interval_s, keys, time, rid)
    stuck = any_of([
        F.coalesce((F.col(f"{s}_pre.lo") == F.col(f"{s}_pre.hi")) & (F.col(f"{s}_post.lo") == F.col(f"{s}_post.hi"))
                   & (F.col(f"{s}_pre.first") == F.col(f"{s}_post.first")), F.lit(False)) for s in signals])
    enough = (F.col("n_pre") >= 3) & (F.col("n_post") >= 3)
    return around.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_long_gaps"),
                                     count_where(enough & stuck).alias("n_repeated_blocks"))


def time_audit_summary(df: DataFrame, signals, interval_s: float, keys=KEYS, time="Date", rid="rid") -> DataFrame:
    """The sixteen audit scalars, one row per key and metric; keys with under two timestamps are skipped."""
    steps = time_steps(df, keys, time)
    tol = tolerance(interval_s)
    s = F.col("step_s")
    missed = F.sum(missed_beats_of("step_s", interval_s))
    n = F.count(F.lit(1))
    core = steps.groupBy(*keys).agg(
        F.sum("n").alias("n_total_timestamps"), n.alias("n_unique_timestamps"),
        count_where(F.col("n") > 1).alias("n_duplicate_timestamps"), F.sum(F.col("n") - 1).alias("n_duplicate_rows"),
        share(F.sum(F.col("n") - 1), F.sum("n"), 3).alias("pct_duplicates"),
        share(count_where(s.between(interval_s - tol, interval_s + tol)), F.count(s), 2).alias("pct_at_expected"),
        missed.alias("n_missed_beats"), share(n, n + missed, 2).alias("pct_coverage"),
        count_where(_irregular(interval_s)).alias("n_irregular_gaps"),
        count_where(s > 10 * interval_s).alias("n_long_gaps"),
        half_even(F.coalesce(F.sum(F.when(s > 10 * interval_s, half_even(s / 3600, 3))), F.lit(0.0)), 2)
        .alias("total_gap_hours"))
    bad = df.groupBy(*keys).agg(count_where(F.col(time).isNull()).alias("n_unparseable"))
    mid = quantile(steps, keys, "step_s", 0.5, "_m").select(*keys, half_even("_m", 1).alias("median_interval_sec"))
    blocks = repeated_blocks(df, signals, interval_s, keys, time, rid).select(*keys, "n_repeated_blocks")
    parts = [core, bad, sort_order_check(df, keys, time, rid), mid, blocks]
    row = reduce(lambda a, b: null_safe_join(a, b, keys), parts).where("n_total_timestamps >= 2")
    row = row.withColumn("n_repeated_blocks", F.coalesce("n_repeated_blocks", F.lit(0)))
    names = ["n_total_timestamps", "n_unparseable", "n_unique_timestamps", "n_duplicate_timestamps", "n_duplicate_rows",
             "pct_duplicates", "is_sorted", "n_out_of_order", "median_interval_sec", "pct_at_expected", "n_missed_beats",
             "pct_coverage", "n_irregular_gaps", "n_long_gaps", "total_gap_hours", "n_repeated_blocks"]
    return row.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(
        list(keys), names, "metric", "value")


def month_spine(span: DataFrame, keys=KEYS, first="first_ts", last="last_ts") -> DataFrame:
    """Every month from a key's first to its last timestamp."""
    months = F.sequence(F.trunc(F.to_date(first), "month"), F.trunc(F.to_date(last), "month"), F.expr("INTERVAL 1 MONTH"))
    return span.select(*keys, F.explode(months).alias("_m")).select(*keys, month_key("_m").alias("month"))


def monthly_gap_coverage(df: DataFrame, interval_s: float, keys=KEYS, time="Date") -> DataFrame:
    """Long gaps, their minutes and mean daily coverage for every month, 0 where nothing happened."""
    steps = time_steps(df, keys, time)
    span = steps.groupBy(*keys).agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))
    gaps = long_gap_catalogue(df, interval_s, keys, time, steps).groupBy(*keys, "month").agg(
        F.count(F.lit(1)).alias("n_gaps"), F.sum("duration_min").alias("total_gap_min"))
    cover = (coverage_by_day(df, interval_s, keys, time, steps).groupBy(*keys, F.substring("date", 1, 7).alias("month"))
             .agg(half_even(F.avg("pct_coverage"), 2).alias("mean_coverage")))
    on = [*keys, "month"]
    return null_safe_join(null_safe_join(month_spine(span, keys), gaps, on), cover, on).na.fill(
        0, ["n_gaps", "total_gap_min", "mean_coverage"])


def coverage_calendar(df: DataFrame, interval_s: float, keys=KEYS, time="Date") -> DataFrame:
    """Month x day-of-month grid of daily coverage."""
    days = coverage_by_day(df, interval_s, keys, time).select(
        *keys, F.substring("date", 1, 7).alias("month"), F.substring("date", 9, 2).cast("int").alias("dom"), "pct_coverage")
    grid = days.groupBy(*keys, "month").pivot("dom", list(range(1, 32))).agg(F.first("pct_coverage"))
    return grid.withColumnsRenamed({str(d): f"d{d:02d}" for d in range(1, 32)})
