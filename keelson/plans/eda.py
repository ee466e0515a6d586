"""The exploratory run: every audit and profile report over one stored, normalised table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as cfg
from ..operators import audit, bivariate, flags, metadata, missing, profile, windows
from ..operators.ordered import durable
from ..sources.files import load_raw
from .together import one, together

#: Longer distribution curves are thinned to this many evenly spaced ranks.
CURVE_POINTS = 1_000


def eda_reports(df: DataFrame, config: cfg.VesselConfig) -> dict[str, DataFrame]:
    """Report name -> DataFrame, phases in order. Reports that need absent columns are left out."""
    out: dict = {}
    for build in report_groups(df, config):
        out |= build()
    return out


def report_groups(df: DataFrame, config: cfg.VesselConfig) -> list:
    """Functions that build the reports, phases in order. Each returns name -> DataFrame and needs no other."""
    signals = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    e = config.expected_interval_s
    out: list = []
    if "Date" in df.columns:
        watched = [c for c in cfg.NUMERIC_COLS if c in df.columns] or signals
        out += [one("time_axis_report", audit.time_audit_summary, df, watched, e),
                one("time_axis_duplicates", audit.duplicate_timestamps, df),
                one("time_axis_gaps", audit.long_gap_catalogue, df, e),
                one("time_axis_missing_by_day", audit.coverage_by_day, df, e),
                one("time_axis_monthly", audit.monthly_gap_coverage, df, e),
                one("time_axis_calendar", audit.coverage_calendar, df, e)]
    out += [lambda: missing_reports(df), one("unit_sanity", profile.unit_sanity_check, df),
            one("summary_statistics", profile.summary_stats, df, signals), one("constraint_violations", flags.constraint_violation_report, df)]
    features = [c for c in config.feature_cols or cfg.DEFAULT.feature_cols if c in df.columns]
    if len(features) > 1:
        out.append(one("correlations", profile.correlation_matrix, df, features))
    out += [one("temporal_coverage", audit.temporal_coverage, df), one("univariate_report", profile.univariate_report, df, signals, config),
            one("grouped_correlations", profile.grouped_correlations, df, signals, config), one("overview", profile.series_overview, df, signals)]
    return [*out, *distributions(df, signals, config), *signal_pairs(df), one("metadata", metadata.variable_metadata, df, signals, config)]


def missing_reports(df: DataFrame) -> dict[str, DataFrame]:
    """Name -> report on missing readings, most of them of the columns that miss some."""
    out: dict = {}
    report = missing.missing_report(df, [c for c in df.columns if c not in ("vessel_id", "rid")])
    out["missingness_overall"] = report
    ranked = missing.columns_of_interest(report).groupBy("signal").agg(F.min("position").alias("position"))
    interest = [r["signal"] for r in ranked.orderBy("position", "signal").collect()]     # one row per column
    out["missingness_comissing"] = missing.comissing_jaccard(df, interest)
    out["missingness_blocks"] = missing.outage_blocks(df, interest)
    out["missingness_block_summary"] = missing.outage_block_summary(missing.outage_blocks(df, interest))
    out["missingness_summary"] = missing.missing_audit_summary(df, interest)
    out["missingness_simultaneous"] = flags.simultaneous_failure(df)
    for period in ("day", "week", "month"):
        out[f"missingness_by_{period}"] = missing.missingness_by_period(df, interest, period)
    return out


def distributions(df: DataFrame, signals, config: cfg.VesselConfig) -> list:
    """Groups of reports on the distribution of every signal, of its rate of change, and per month and week."""
    out = [one("histogram", profile.signal_histogram, df, signals), one("grouped_histogram", profile.grouped_histogram, df, signals, config),
           one("kde", profile.kde_curve, df, signals), one("ecdf", profile.ecdf, df, signals, points=CURVE_POINTS)]
    if "Date" in df.columns:
        out.append(lambda: {"rate_of_change": profile.roc_histogram(windows.signal_steps(df.where(F.col("Date").isNotNull()), signals))})
        out += [one(f"period_boxes_{p}", profile.period_box_stats, df, signals, p) for p in ("month", "week")]
    return out


def cubic_reports(df: DataFrame) -> dict[str, DataFrame]:
    fit = bivariate.cubic_fit(df)
    return {"cubic_fit": fit, "cubic_curve": bivariate.cubic_curve(fit)}


def wind_reports(df: DataFrame) -> dict[str, DataFrame]:
    """Residuals of power by wind speed, and by sector where the angle is there."""
    wind = bivariate.WIND
    residuals = durable(bivariate.detrended_residuals(df))
    out = {"rolling_residual": windows.rolling_median_by(residuals, "residual", wind).select("vessel_id", "rid", wind, "clipped", "rolling_median")}
    if bivariate.ANGLE in df.columns:
        out["wind_sectors"] = bivariate.wind_sector_stats(residuals)
        out["wind_rose"] = bivariate.wind_rose(df)
    return out


def rolling_fuel_power(df: DataFrame, fuel: str) -> DataFrame:
    power = bivariate.POWER
    rows = df.where((F.col(power) >= 0) & (F.col(fuel) >= 0))
    return windows.rolling_mean_centered(rows, [fuel, power]).select("vessel_id", "rid", "Date", f"roll_{fuel}", f"roll_{power}")


def track(df: DataFrame) -> DataFrame:
    return bivariate.track_points(df).select("vessel_id", "rid", "GPS_LAT", "GPS_LON")


def signal_pairs(df: DataFrame) -> list:
    """Groups of reports on speed, power, fuel, draft, wind and position, as far as the columns are there."""
    have, out = set(df.columns), []
    fuel = next((c for c in cfg.FUEL_COLUMNS if c in have), None)
    power, speed, draft, wind = bivariate.POWER, bivariate.SPEED, bivariate.DRAFT, bivariate.WIND
    if {power, speed} <= have:
        out += [one("power_speed_density", profile.density_2d, df), lambda: cubic_reports(df)]
        if draft in have:
            out.append(one("draft_bands", bivariate.draft_quartile_bands, df))
        if "GPS_LAT" in have:
            out.append(one("leg_directions", bivariate.leg_direction_split, df))
        if "Date" in have:
            out.append(one("monthly_split", bivariate.monthly_split, df))
        if wind in have:
            out.append(lambda: wind_reports(df))
    if fuel and power in have:
        out.append(one("fuel_power_fit", bivariate.linear_fit, df, power, fuel))
        if "Date" in have:
            out += [one("monthly_slopes", bivariate.monthly_slopes, df, power, fuel), one("rolling_fuel_power", rolling_fuel_power, df, fuel)]
    if fuel and {power, speed, draft, wind} <= have:
        out.append(one("bivariate_report", bivariate.bivariate_report, df, fuel=fuel))
    points = {n: tuple(fuel if fuel and c == bivariate.FUEL else c for c in t) for n, t in bivariate.POINT_TABLES.items()}
    points = {n: t for n, t in points.items() if set(t[:3]) <= have}
    if points:
        out.append(one("point_tables", bivariate.bivariate_point_tables, df, tables=points))
    if {"GPS_LAT", "GPS_LON"} <= have:
        out += [one("track", track, df), one("track_summary", bivariate.track_summary, df)]
    return out


def run_eda(spark: SparkSession, path: str, output: str) -> dict:
    """Load once, store the normalised rows, and write every report under <output>/<vessel>, several at a time."""
    config = cfg.detect_vessel(path)
    folder = f"{output}/{config.vessel_id}"
    load_raw(spark, path, config).write.mode("overwrite").parquet(f"{folder}/normalised")
    df = spark.read.parquet(f"{folder}/normalised")

    def write(build):
        for name, report in build().items():
            report.write.mode("overwrite").parquet(f"{folder}/{name}")

    # the last group, the rule table, takes longest
    together(spark, [partial(write, build) for build in reversed(report_groups(df, config))])
    return {"vessel_id": config.vessel_id, "folder": folder}
