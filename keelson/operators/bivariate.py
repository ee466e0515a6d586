"""Pairs of signals: fits, residuals, sectors, bands and the point tables behind them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import config as cfg
from ..functions.columns import count_where, half_even, month_key, null_safe_join, wrap_angle
from .ordered import attach, settled
from .normalize import thin_every_kth
from .profile import box_stats
from .quantiles import quantile, quantiles, with_quantiles
from .windows import leg_direction

KEYS = ("vessel_id",)
POWER, SPEED, FUEL = "Main_Engine_Power_kW", "GPSSpeed_kn", "Fuel_Consumption_t_per_day"
DRAFT, TRIM, WIND, ANGLE = "Avg_draft_m", "Trim_m", "RelWindSpeed_kn", "RelWindAngle_deg"


def linear_fit(df: DataFrame, x=POWER, y=FUEL, keys=KEYS, more_than: int = 50) -> DataFrame:
    """Least-squares line over non-negative pairs with the 5th and 95th percentile of its residuals."""
    rows = df.where((F.col(x) >= 0) & (F.col(y) >= 0))
    fit = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
                                  F.regr_intercept(y, x).alias("intercept")).where(F.col("n") > more_than)
    fit = settled(fit)
    resid = null_safe_join(rows, fit, keys, "inner").withColumn(
        "r", F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept")))
    return null_safe_join(fit, with_quantiles(resid, keys, {"residual": "r"}, [0.05, 0.95], ["p05", "p95"]), keys)


def monthly_slopes(df: DataFrame, x=POWER, y=FUEL, keys=KEYS, time="Date", at_least: int = 50) -> DataFrame:
    """Slope per month with enough rows; flagged when 15 % above the median month."""
    rows = df.where((F.col(x) >= 0) & (F.col(y) >= 0) & F.col(time).isNotNull())
    months = settled(rows.groupBy(*keys, month_key(time).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), half_even(F.regr_slope(y, x), 6).alias("slope")).where(F.col("n") >= at_least))
    mid = quantile(months, keys, "slope", 0.5, "median_slope")
    return attach(months, mid, keys).withColumn("above_median", F.col("slope") > F.col("median_slope") * 1.15)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _cubic_coefficients(sums: pd.Series) -> pd.Series:
    """Coefficients from the moment sums s0..s6, t0..t3 of one key (one row per key reaches this)."""
    def solve(m):
        gram = np.array([[m[i + j] for j in range(4)] for i in range(4)])
        return np.linalg.lstsq(gram, np.asarray(m[7:11]), rcond=None)[0]
    return sums.map(solve)


def cubic_fit(df: DataFrame, x=SPEED, y=POWER, keys=KEYS, more_than: int = 100) -> DataFrame:
    """Least-squares cubic y ~ c0 + c1 u + c2 u² + c3 u³ with u = x / max|x|.

    One pass finds the scale, one pass the eleven power sums; the 4x4 system of each key is solved from
    those sums on the executors, so no readings leave the JVM and nothing is collected.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    scale = rows.groupBy(*keys).agg(F.coalesce(F.nullif(F.max(F.abs(x)), F.lit(0.0)), F.lit(1.0)).alias("x_scale"),
                                    F.max(x).alias("x_max"))
    u = F.col(x) / F.col("x_scale")

    def power(k):
        out = F.lit(1.0)
        for _ in range(k):
            out = out * u
        return out

    sums = attach(rows, scale, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("x_scale").alias("x_scale"), F.first("x_max").alias("x_max"),
        *[F.avg(power(k)).alias(f"s{k}") for k in range(7)], *[F.avg(power(k) * F.col(y)).alias(f"t{k}") for k in range(4)])
    moments = F.array(*[F.col(f"s{k}") for k in range(7)], *[F.col(f"t{k}") for k in range(4)])
    solved = sums.where(F.col("n") > more_than).withColumn("_c", _cubic_coefficients(moments))
    return solved.select(*keys, "n", "x_scale", "x_max", *[F.col("_c")[k].alias(f"c{k}") for k in range(4)])


def cubic_value(x: Column) -> Column:
    """Value of a joined `cubic_fit` row at x."""
    u = x / F.col("x_scale")
    return F.col("c0") + u * (F.col("c1") + u * (F.col("c2") + u * F.col("c3")))


def cubic_curve(fit: DataFrame, keys=KEYS, points: int = 200) -> DataFrame:
    """The fitted curve on an even grid from 0 to the largest x, clipped at 0."""
    x = F.col("x_max") * F.col("i") / (points - 1)
    return fit.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        *keys, "i", x.alias("x"), F.greatest(cubic_value(x), F.lit(0.0)).alias("y"))


def detrended_residuals(df: DataFrame, y=POWER, x=SPEED, keys=KEYS, more_than: int = 0) -> DataFrame:
    """Underway rows (x > 1) with y ≥ 0 and a wind reading: `residual` = y - cubic(x)."""
    rows = df.where((F.col(y) >= 0) & (F.col(x) > 1) & (F.col(WIND) >= 0))
    fit = cubic_fit(rows, x, y, keys, more_than)
    return (attach(rows, fit, keys, "inner").withColumn("residual", F.col(y) - cubic_value(F.col(x)))
            .drop("n", "x_scale", "x_max", "c0", "c1", "c2", "c3"))


def wind_sector_stats(residuals: DataFrame, angle=ANGLE, keys=KEYS, width: int = 45) -> DataFrame:
    """Box statistics of the residual per 45° sector of the wrapped wind angle."""
    sector = (F.floor(wrap_angle(angle) / width) * width).cast("int")
    return box_stats(residuals.where(F.col(angle).isNotNull()).withColumn("sector_deg", sector), [*keys, "sector_deg"], "residual")


def wind_rose(df: DataFrame, wind=WIND, angle=ANGLE, keys=KEYS, bins: int = 36, more_than: int = 50) -> DataFrame:
    """Mean wind speed per 10° bin, 0 for an empty bin; needs more than 50 readings."""
    rows = df.where((F.col(wind) >= 0) & F.col(angle).isNotNull())
    b = F.least(F.floor(wrap_angle(angle) * bins / 360).cast("int"), F.lit(bins - 1))
    per = rows.groupBy(*keys, b.alias("bin")).agg(F.avg(wind).alias("mean_wind"), F.count(F.lit(1)).alias("n"))
    spine = (per.groupBy(*keys).agg(F.sum("n").alias("total")).where(F.col("total") > more_than)
             .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    return null_safe_join(spine, per, [*keys, "bin"]).na.fill(0.0, ["mean_wind"]).na.fill(0, ["n"])


def draft_quartile_bands(df: DataFrame, keys=KEYS, at_least: int = 20) -> DataFrame:
    """Speed-power rows labelled by draft quartile band. Neighbouring bands overlap by 0.01 m."""
    rows = df.where((F.col(POWER) >= 0) & (F.col(SPEED) >= 0) & F.col(DRAFT).isNotNull())
    q = quantiles(rows, keys, {"_e": DRAFT}, [0.0, 0.25, 0.5, 0.75, 1.0])
    d, e = F.col(DRAFT), F.col("_e")
    bands = F.array_compact(F.array(*[
        F.when((d >= e[i]) & (d < e[i + 1] + 0.01), F.struct(
            F.lit(i + 1).alias("band"), e[i].alias("band_lo"), e[i + 1].alias("band_hi"))) for i in range(4)]))
    placed = attach(rows, q, keys).select(*keys, SPEED, POWER, DRAFT, F.inline(bands))
    sizes = placed.groupBy(*keys, "band").agg(F.count(F.lit(1)).alias("band_n")).where(F.col("band_n") >= at_least)
    return attach(placed, sizes, [*keys, "band"], "inner")


def leg_direction_split(df: DataFrame, lat="GPS_LAT", keys=KEYS, order=("rid",)) -> DataFrame:
    """Counts and mean speed / power of northing and southing rows."""
    rows = df.where((F.col(POWER) >= 0) & (F.col(SPEED) >= 0))
    return leg_direction(rows, lat, keys, order).groupBy(*keys, "leg").agg(
        F.count(F.lit(1)).alias("n"), F.avg(SPEED).alias("mean_speed"), F.avg(POWER).alias("mean_power"))


def monthly_split(df: DataFrame, keys=KEYS, time="Date") -> DataFrame:
    rows = df.where((F.col(POWER) >= 0) & (F.col(SPEED) >= 0) & F.col(time).isNotNull())
    return rows.groupBy(*keys, month_key(time).alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(SPEED).alias("mean_speed"), F.avg(POWER).alias("mean_power"),
        F.max(SPEED).alias("max_speed"), F.max(POWER).alias("max_power"))


def bivariate_report(df: DataFrame, keys=KEYS, time="Date", fuel=FUEL) -> DataFrame:
    """The four report sections in long form: key, section, metric, value."""
    p, s, d, w, f = (F.col(c) for c in (POWER, SPEED, DRAFT, WIND, fuel))
    a = df.where((p >= 0) & (s >= 0))
    qa = with_quantiles(a, keys, {"s": SPEED, "p": POWER}, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    sec_a = attach(a, qa, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_valid"), count_where(s < 0.5).alias("n_at_rest_speed"),
        count_where((p > F.col("p_q75")) & (s < F.col("s_q25"))).alias("n_high_power_low_speed"),
        half_even(F.first("s_q50"), 3).alias("speed_p50"), half_even(F.first("p_q50"), 3).alias("power_p50"))
    b = df.where((p >= 0) & (f >= 0))
    fit = linear_fit(df, POWER, fuel, keys)
    slopes = monthly_slopes(df, POWER, fuel, keys, time).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_monthly_slopes"))
    sec_b = null_safe_join(null_safe_join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid")), fit, keys), slopes, keys).select(
        *keys, "n_valid", half_even("slope", 6).alias("linear_slope"), half_even("residual_p95", 4).alias("residual_p95"),
        F.coalesce("n_monthly_slopes", F.lit(0)).alias("n_monthly_slopes"))
    c = df.where((d > 0) & p.isNotNull())
    sec_c = _counted(c, keys, DRAFT, {"draft_p25": 0.25, "draft_p75": 0.75})
    e = df.where((w >= 0) & (p >= 0) & (s > 1))
    sec_d = _counted(e, keys, WIND, {"aws_p50": 0.5, "aws_p95": 0.95})
    out = None
    for name, part in (("A_power_vs_speed", sec_a), ("B_fuel_vs_power", sec_b), ("C_draft_vs_power", sec_c),
                       ("D_wind_vs_power", sec_d)):
        metrics = [m for m in part.columns if m not in keys]
        long = part.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
            list(keys), metrics, "metric", "value").withColumn("section", F.lit(name))
        out = long if out is None else out.unionByName(long)
    return out


def _counted(rows, keys, value, probs: dict):
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_valid"))
    q = quantiles(rows, keys, {"_q": value}, list(probs.values()))
    return null_safe_join(n, q, keys).select(*keys, "n_valid", *[half_even(F.col("_q")[i], 3).alias(m) for i, m in enumerate(probs)])


POINT_TABLES = {      # name -> (x, y, third variable, lower and upper quantile of its colour range)
    "speed_power_draft": (SPEED, POWER, DRAFT, 0.05, 0.95),
    "speed_power_wind": (SPEED, POWER, WIND, 0.0, 0.95),
    "draft_power": (DRAFT, POWER, DRAFT, 0.25, 0.75),
    "draft_fuel": (DRAFT, FUEL, DRAFT, 0.25, 0.75),
    "trim_power": (TRIM, POWER, TRIM, 0.02, 0.98),
}


def bivariate_point_tables(df: DataFrame, keys=KEYS, rid="rid", tables=POINT_TABLES) -> DataFrame:
    """Valid points of each pair with the third variable's bounds; thin with `sample_n` for display."""
    out = None
    for name, (x, y, z, lo, hi) in tables.items():
        ok = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()
        for c in {x, y, z}:
            ok = ok & {POWER: (F.col(c) >= 0) if x == SPEED else F.lit(True), SPEED: F.col(c) >= 0, DRAFT: F.col(c) > 0,
                       WIND: F.col(c) >= 0, FUEL: F.col(c) >= 0}.get(FUEL if c in cfg.FUEL_COLUMNS else c, F.lit(True))
        rows = df.where(ok)
        part = attach(rows, with_quantiles(rows, keys, {"z": z}, [lo, hi], ["lo", "hi"]), keys).select(
            F.lit(name).alias("point_table"), *keys, rid, F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"), "z_lo", "z_hi")
        out = part if out is None else out.unionByName(part)
    return out


def track_points(df: DataFrame, lat="GPS_LAT", lon="GPS_LON", keys=KEYS, order=("rid",), cap: int | None = None) -> DataFrame:
    """Valid positions; with `cap`, thinned to about that many per key, evenly in `order`."""
    valid = df.na.drop(subset=[lat, lon])
    return valid if cap is None else thin_every_kth(valid, keys, order, cap)


def track_summary(df: DataFrame, lat="GPS_LAT", lon="GPS_LON", keys=KEYS, rid="rid") -> DataFrame:
    """First and last point, ranges and median centre of each track."""
    rows = df.na.drop(subset=[lat, lon])
    point = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.min_by(point, rid).alias("a"), F.max_by(point, rid).alias("z"),
        F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"))
    mid = with_quantiles(rows, keys, {"lat": lat, "lon": lon}, [0.5], ["centre"])
    return null_safe_join(base, mid, keys).select(
        *keys, "n_points", F.col("a.lat").alias("start_lat"), F.col("a.lon").alias("start_lon"), F.col("z.lat").alias("end_lat"),
        F.col("z.lon").alias("end_lon"), "lat_min", "lat_max", "lon_min", "lon_max", "lat_centre", "lon_centre")
