"""Missingness audit. Per-column results come from one wide aggregate; the rows are never unpivoted."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as cfg
from ..functions.columns import (blank_to_null, col, count_where, day_key, half_even, month_key, null_safe_join, seconds,
                                 share, week_span_key)
from .flags import aggregate_signals, simultaneous_failure
from .ordered import Ordered

KEYS = ("vessel_id",)


def is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or blank text."""
    return (blank_to_null(F.col(c)) if df.schema[c].dataType.typeName() == "string" else F.col(c)).isNull()


def missing_report(df: DataFrame, columns=None, keys=KEYS) -> DataFrame:
    """Missing count and share per column, most missing first."""
    columns = columns or [c for c in df.columns if c not in keys]
    counts = aggregate_signals(df, keys, columns, lambda c: {
        "missing_count": count_where(is_missing(df, c)), "_n": F.count(F.lit(1))})
    return (counts.withColumn("missing_pct", share("missing_count", "_n", 3)).drop("_n")
            .orderBy(F.desc("missing_count"), "signal"))


def columns_of_interest(report: DataFrame, priority=cfg.PRIORITY_SENSORS, at_most: int | None = None, keys=KEYS) -> DataFrame:
    """Priority columns first, then any other column with gaps; the first `at_most` of them per key if that is given."""
    order = cfg.local_table(report.sparkSession, [(c, i) for i, c in enumerate(priority)], "signal string, place int")
    ranked = (report.join(F.broadcast(order), "signal", "left").where("place IS NOT NULL OR missing_count > 0")
              .dropDuplicates([*keys, "signal"]))
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("place"), F.desc("missing_pct"), "signal")
    return (ranked.withColumn("position", F.row_number().over(w)).where(F.lit(True) if at_most is None else F.col("position") <= at_most)
            .select(*keys, "position", "signal", "missing_count", "missing_pct"))


def missingness_by_period(df: DataFrame, columns, period: str = "day", keys=KEYS, time="Date") -> DataFrame:
    """Percent missing per column and day, week (Monday/Sunday label) or month; undated rows are left out."""
    label = {"day": day_key, "week": week_span_key, "month": month_key}[period]
    dated = df.where(F.col(time).isNotNull()).withColumn("period", label(time))
    return dated.groupBy(*keys, "period").agg(*[
        share(count_where(is_missing(df, c)), F.count(F.lit(1)), 2).alias(c) for c in columns])


def comissing_jaccard(df: DataFrame, columns, keys=KEYS) -> DataFrame:
    """Share of rows where both columns are missing among those where either is, for all pairs at once."""
    columns = list(columns)
    null = {c: F.col(c).isNull() for c in columns}
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.groupBy(*keys).agg(*[x for i, (a, b) in enumerate(pairs) for x in (
        count_where(null[a] & null[b]).alias(f"_b{i}"), count_where(null[a] | null[b]).alias(f"_e{i}"))])
    value = {p: F.coalesce(F.col(f"_b{i}") / F.nullif(F.col(f"_e{i}"), F.lit(0)), F.lit(0.0)) for i, p in enumerate(pairs)}
    cells = [F.struct(F.lit(a).alias("signal_a"), F.lit(b).alias("signal_b"),
                      value[(a, b) if (a, b) in value else (b, a)].alias("jaccard")) for a in columns for b in columns]
    return wide.select(*keys, F.inline(F.array(*cells)))


def outage_blocks(df: DataFrame, columns, keys=KEYS, time="Date", rid="rid", at_least: int = 2) -> DataFrame:
    """Maximal runs of missing rows per column in ingest order, with their class and span.

    The wide rows are ordered once for all columns; only missing cells are exploded, and they are
    collapsed map-side, so one column that is missing everywhere does not pile up in a task.
    """
    o = Ordered(df.select(*dict.fromkeys([*keys, rid, time, *columns])), keys, [rid]).position("pos")
    o.frame(lambda w: {f"_p_{c}": F.lag(F.col(c).isNull()).over(w) for c in columns}, before=1)
    o.running(sums={f"_b_{c}": (F.col(c).isNull() & ~F.coalesce(F.col(f"_p_{c}"), F.lit(False))).cast("bigint")
                    for c in columns})
    cells = F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").alias("block"))) for c in columns]))
    found = o.result().select(*keys, F.col(time).alias("_t"), "pos", F.inline(cells)).groupBy(*keys, "column", "block").agg(
        F.min("pos").alias("row_start"), F.max("pos").alias("row_end"), F.count(F.lit(1)).alias("n_rows"),
        F.min_by("_t", "pos").alias("start_ts"), F.max_by("_t", "pos").alias("end_ts"))
    kind = (F.when(F.col("n_rows") <= 3, "isolated").when(F.col("n_rows") <= 200, "short_outage").otherwise("long_outage"))
    return found.where(F.col("n_rows") >= at_least).select(
        *keys, "column", kind.alias("gap_type"), "row_start", "row_end", "n_rows",
        half_even(seconds("start_ts", "end_ts") / 60, 2).alias("duration_min"), "start_ts", "end_ts")


def outage_block_summary(blocks: DataFrame, keys=KEYS) -> DataFrame:
    return blocks.groupBy(*keys, "column", "gap_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("n_rows").alias("total_rows"))


def missing_audit_summary(df: DataFrame, columns, keys=KEYS, time="Date", rid="rid") -> DataFrame:
    """The eight scalars of the missingness audit, one row per key."""
    report = missing_report(df, [*columns], keys)
    most = F.max_by(F.struct("signal", "missing_pct"), F.struct("missing_count", "missing_pct", "signal"))
    overall = report.groupBy(*keys).agg(count_where(F.col("missing_count") > 0).alias("n_cols_with_missing"), most.alias("m"))
    kinds = outage_blocks(df, columns, keys, time, rid).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_block_outages_total"),
        count_where(F.col("gap_type") == "isolated").alias("n_isolated_gaps"),
        count_where(F.col("gap_type") == "short_outage").alias("n_short_outages"),
        count_where(F.col("gap_type") == "long_outage").alias("n_long_outages"))
    together = simultaneous_failure(df, keep=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_simultaneous_failure_rows"))
    return null_safe_join(null_safe_join(overall, kinds, keys), together, keys).select(
        *keys, "n_cols_with_missing", F.col("m.signal").alias("most_missing_col"),
        F.col("m.missing_pct").alias("most_missing_pct"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_block_outages_total", "n_isolated_gaps", "n_short_outages",
                                                     "n_long_outages", "n_simultaneous_failure_rows")])
