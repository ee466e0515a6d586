"""Signal profiles: summaries, correlations, distributions, unit checks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as cfg
from ..functions.columns import (all_of, count_where, half_even, iso_week_key, month_key,
                                 null_safe_join, share, unpivot)
from .flags import aggregate_signals, outside_limits
from .moments import pair_correlations
from .normalize import signal_profiles
from .ordered import Ordered, attach
from .quantiles import quantiles
from .windows import MAX_STEP_S, rate_table

KEYS = ("vessel_id",)


def signal_quantiles(df: DataFrame, signals, probs, names, keys=KEYS) -> DataFrame:
    """keys, signal, one column per prob."""
    q = quantiles(df, keys, {s: s for s in signals}, probs)
    return q.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("signal"), *[F.col(s)[i].alias(n) for i, n in enumerate(names)]) for s in signals])))


def summary_stats(df: DataFrame, signals=cfg.NUMERIC_COLS, keys=KEYS, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std, min, quantiles, max per signal at 4 decimals."""
    signals = [s for s in signals if s in df.columns]
    base = aggregate_signals(df, keys, signals, lambda s: {
        "count": F.count(s), "mean": half_even(F.avg(s), 4), "std": half_even(F.stddev_samp(s), 4),
        "min": half_even(F.min(s), 4), "max": half_even(F.max(s), 4)})
    names = [f"p{round(p * 100):02d}" for p in probs]
    q = signal_quantiles(df, signals, probs, names, keys)
    return null_safe_join(base, q.withColumns({n: half_even(n, 4) for n in names}), [*keys, "signal"])


def numeric_describe_ext(df: DataFrame, signals=cfg.NUMERIC_COLS, keys=KEYS) -> DataFrame:
    signals = [s for s in signals if s in df.columns]
    missing = aggregate_signals(df, keys, signals, lambda s: {"missing": count_where(F.col(s).isNull())})
    return null_safe_join(summary_stats(df, signals, keys, (0.01, 0.05, 0.5, 0.95, 0.99)), missing, [*keys, "signal"])


def correlation_matrix(df: DataFrame, signals, keys=KEYS) -> DataFrame:
    """Pairwise-complete Pearson for every pair a < b (in list order), all pairs in one aggregate."""
    return pair_correlations(df, signals, keys).select(*keys, "signal_a", "signal_b", "corr")


def grouped_correlations(df: DataFrame, signals, config: cfg.VesselConfig | None = None, keys=KEYS,
                         anchors=("Main_Engine_Power_kW", "GPSSpeed_kn"), at_least: int = 20) -> DataFrame:
    """Correlations inside each feature group plus the two anchors; sparse columns are left out."""
    members = {g: [s for s in signals if cfg.group_of(s, config) == g] for g in cfg.FEATURE_GROUPS}
    both = {g: list(dict.fromkeys([*m, *[a for a in anchors if a in df.columns]])) for g, m in members.items()}
    pairs = sorted({tuple(sorted(p)) for m in both.values() for p in combinations(m, 2)})
    found = pair_correlations(df, sorted({s for p in pairs for s in p}), keys, pairs)
    # the groups that list a pair, and whether either side there is a guest that need not have enough readings
    listed = cfg.local_table(df.sparkSession, [
        (g, a, b, a in anchors and a not in members[g], b in anchors and b not in members[g])
        for g, m in both.items() for a, b in sorted({tuple(sorted(p)) for p in combinations(m, 2)})],
        "feature_group string, signal_a string, signal_b string, _free_a boolean, _free_b boolean")
    usable = (F.col("_free_a") | (F.col("n_a") >= at_least)) & (F.col("_free_b") | (F.col("n_b") >= at_least))
    return found.join(F.broadcast(listed), ["signal_a", "signal_b"]).where(usable).select(*keys, "feature_group", "signal_a", "signal_b", "corr")


def top_correlations(matrix: DataFrame, n: int = 15, keys=KEYS) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.abs("corr")), "signal_a", "signal_b")
    return (matrix.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def target_correlations(df: DataFrame, target: str, signals, keys=KEYS) -> DataFrame:
    """Correlation of every signal with one target, strongest first."""
    others = [s for s in signals if s != target]
    found = pair_correlations(df, [*others, target], keys, [(s, target) for s in others])
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.abs("corr")), "signal")
    return found.select(*keys, F.col("signal_a").alias("signal"), "corr").withColumn("rank", F.row_number().over(w))


PROBS = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
QNAMES = ("q01", "q05", "q10", "q25", "q50", "q75", "q90", "q95", "q99")


def univariate_report(df: DataFrame, signals, config: cfg.VesselConfig | None = None, keys=KEYS, time="Date", rid="rid",
                      max_step_s: float = MAX_STEP_S, at_least: int = 20) -> DataFrame:
    """One row per signal with at least 20 readings. Outliers are judged by the global limits only."""
    signals = [s for s in signals if s in df.columns]
    limits = cfg.physical_limits()

    def counts(s):
        low, high = outside_limits(s, limits)
        return {"n_total": F.count(F.lit(1)), "n_valid": F.count(s), "mean": half_even(F.avg(s), 4),
                "std": half_even(F.stddev_samp(s), 4), "min": half_even(F.min(s), 4), "max": half_even(F.max(s), 4),
                "n_negative": count_where(F.col(s) < 0), "n_zero": count_where(F.col(s) == 0),
                "n_physical_outliers": count_where(low) + count_where(high)}

    base = aggregate_signals(df, keys, signals, counts).where(F.col("n_valid") >= at_least)
    q = signal_quantiles(df, signals, PROBS, QNAMES, keys)
    q = q.withColumns({n: half_even(n, 4) for n in QNAMES})
    steps = rate_table(df.where(F.col(time).isNotNull()), signals, keys, time, (time, rid), max_step_s)
    rates = quantiles(steps, keys, {s: f"_rate_{s}" for s in signals}, [0.5, 0.99])
    roc = rates.select(*keys, F.inline(F.array(*[F.struct(F.lit(s).alias("signal"), *[
        half_even(F.col(s)[i], 8).alias(f"roc_{n}_per_s") for i, n in enumerate(("median", "p99"))]) for s in signals])))
    on = [*keys, "signal"]
    names = cfg.feature_group_table(df.sparkSession, signals, config)
    named = signal_profiles(names).select("signal", "feature_group", "label", "unit")
    out = null_safe_join(null_safe_join(base, q, on), roc, on).join(F.broadcast(named), "signal")
    missing = F.col("n_total") - F.col("n_valid")
    return out.withColumns({"n_missing": missing, "pct_missing": share(missing, "n_total", 2)}).na.fill(
        0.0, ["roc_median_per_s", "roc_p99_per_s"])


def box_stats(long: DataFrame, keys, value: str = "value") -> DataFrame:
    """n, quartiles and 1.5 IQR whiskers (the most extreme readings inside, never inside the box)."""
    long = long.where(F.col(value).isNotNull())
    q = quantiles(long, keys, {"_q": value}, [0.25, 0.5, 0.75])
    rows = attach(long, q, keys)
    q1, med, q3 = (F.col("_q")[i] for i in range(3))
    v, reach = F.col(value), 1.5 * (q3 - q1)
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first(q1).alias("q1"), F.first(med).alias("median"), F.first(q3).alias("q3"),
        F.min(F.when(v >= q1 - reach, v)).alias("whisker_lo"), F.max(F.when(v <= q3 + reach, v)).alias("whisker_hi"))
    return out.withColumns({"whisker_lo": F.least("whisker_lo", "q1"), "whisker_hi": F.greatest("whisker_hi", "q3")})


def period_box_stats(df: DataFrame, signals, period: str = "month", keys=KEYS, time="Date") -> DataFrame:
    """Box statistics per signal and month or ISO week, for signals seen in two periods or more."""
    label = {"month": month_key, "week": iso_week_key}[period](time)
    long = unpivot(df.where(F.col(time).isNotNull()).withColumn("period", label), [*keys, "period"], signals)
    stats = box_stats(long, [*keys, "signal", "period"])
    w = Window.partitionBy(*keys, "signal")
    return stats.withColumn("_p", F.count(F.lit(1)).over(w)).where("_p >= 2").drop("_p")


def histogram(long: DataFrame, keys, value: str = "value", bins=60, clip: tuple | None = None) -> DataFrame:
    """Equal-width counts and density. `bins` is a number or a function of the group size column.

    With `clip=(p, q)` values are first clipped to those quantiles. A constant group gets one unit of width.
    """
    long = long.where(F.col(value).isNotNull())
    size = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    if clip:
        q = quantiles(long, keys, {"_q": value}, list(clip))
        size = null_safe_join(size.drop("_lo", "_hi"), q, keys).withColumns(
            {"_lo": F.col("_q")[0], "_hi": F.col("_q")[1]}).drop("_q")
    flat = F.col("_lo") == F.col("_hi")
    size = size.withColumns({"_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
                             "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")),
                             "_k": (bins(F.col("_n")) if callable(bins) else F.lit(bins)).cast("int")})
    rows = attach(long, size, keys)
    x = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_k")
    b = F.least(F.floor((x - F.col("_lo")) / width).cast("int"), F.col("_k") - 1)
    return rows.groupBy(*keys, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first(F.col("_lo") + b * width).alias("bin_lo"),
        F.first(width).alias("_w"), F.first("_n").alias("_n")).select(
        *keys, "bin", "bin_lo", (F.col("bin_lo") + F.col("_w")).alias("bin_hi"), "count",
        (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"))


def adaptive_bins(n: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(20), F.floor(F.pow(n, F.lit(0.38)))))


def adaptive_roc_bins(n: Column) -> Column:
    return F.least(F.lit(80), F.greatest(F.lit(20), F.floor(F.pow(n, F.lit(0.35)))))


def signal_histogram(df: DataFrame, signals, keys=KEYS, bins=adaptive_bins, clip=(0.001, 0.999)) -> DataFrame:
    return histogram(unpivot(df, keys, signals), [*keys, "signal"], bins=bins, clip=clip)


def grouped_histogram(df: DataFrame, signals, config: cfg.VesselConfig | None = None, keys=KEYS) -> DataFrame:
    """50 bins on the 1-99 % range, labelled with the feature group."""
    groups = cfg.feature_group_table(df.sparkSession, signals, config)
    return signal_histogram(df, signals, keys, 50, (0.01, 0.99)).join(F.broadcast(groups), "signal")


def roc_histogram(steps: DataFrame, keys=KEYS) -> DataFrame:
    """Distribution of rates of change, clipped to 0.5-99.5 %, for signals with more than 20 of them."""
    rates = steps.where(F.col("roc").isNotNull()).select(*keys, "signal", "roc")
    enough = rates.groupBy(*keys, "signal").agg(F.count(F.lit(1)).alias("_c")).where("_c > 20").drop("_c")
    kept = attach(rates, enough.withColumn("_keep", F.lit(True)), [*keys, "signal"], "inner")
    return histogram(kept, [*keys, "signal"], "roc", adaptive_roc_bins, (0.005, 0.995))


def kde_curve(df: DataFrame, signals, keys=KEYS, points: int = 400, cells: int = 2048) -> DataFrame:
    """Gaussian density estimate (Silverman width) of the 0.1-99.9 % clipped values on an even grid.

    Values are first summed into narrow cells, so the kernel runs over the cells of a key and signal, of which there are at most
    `cells`, and not over rows: the cost after one map-side aggregation does not depend on the table size.
    """
    on = [*keys, "signal"]
    long = unpivot(df, keys, signals).where(F.col("value").isNotNull())
    q = quantiles(long, on, {"_q": "value"}, [0.001, 0.999]).select(
        *on, F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi")).where("_hi > _lo + 1e-12")
    rows = attach(long, q, on, "inner").withColumn(
        "x", F.least(F.greatest(F.col("value"), F.col("_lo")), F.col("_hi")))
    cell = F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells).cast("int"), F.lit(cells - 1))
    binned = rows.groupBy(*on, cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("c"), F.avg("x").alias("m"))
    spread = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                                   F.first("_lo").alias("lo"), F.first("_hi").alias("hi"))
    grouped = null_safe_join(binned, spread, on).withColumn("h", F.col("sd") * F.pow(F.col("n") * 0.75, F.lit(-0.2)))
    shape = grouped.select(*on, F.lit(0).alias("i"), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).schema

    def smoothed(pdf: pd.DataFrame) -> pd.DataFrame:
        """The kernel over the cells of one signal at every grid point: at most `points` x `cells` numbers, not rows."""
        pdf, first = pdf.sort_values("cell"), pdf.iloc[0]
        x = first["lo"] + (first["hi"] - first["lo"]) * np.arange(points) / (points - 1)
        z = (x[:, None] - pdf["m"].to_numpy()[None]) / first["h"]
        density = np.exp(-0.5 * z * z) @ pdf["c"].to_numpy(dtype=float) / (first["n"] * first["h"] * np.sqrt(2 * np.pi))
        return pd.DataFrame({**{k: [first[k]] * points for k in on}, "i": np.arange(points, dtype=np.int32), "x": x, "density": density})

    return grouped.groupBy(*on).applyInPandas(smoothed, shape)


def ecdf(df: DataFrame, signals, keys=KEYS, rid="rid", points: int | None = None) -> DataFrame:
    """Sorted values with i/n; with `points`, longer signals are thinned to that many evenly spaced ranks."""
    on = [*keys, "signal"]
    long = unpivot(df, [*keys, rid], signals).where(F.col("value").isNotNull())
    n = long.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    ranked = attach(Ordered(long, on, ["value", rid]).position("i").result(), n, on)
    last = (points or 1 << 62) - 1
    nearest = half_even(F.col("i") * last / (F.col("n") - 1))
    kept = F.lit(points is None) | (F.col("n") <= (points or 0)) | (half_even(nearest * (F.col("n") - 1) / last) == F.col("i"))
    return ranked.where(kept).select(*on, "value", ((F.col("i") + 1) / F.col("n")).alias("cumulative"))


def density_2d(df: DataFrame, x: str = "GPSSpeed_kn", y: str = "Main_Engine_Power_kW", keys=KEYS, grid: int = 60) -> DataFrame:
    """Counts (and log10 counts) on a grid x grid mesh over non-negative pairs."""
    rows = df.where((F.col(x) >= 0) & (F.col(y) >= 0)).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    edges = rows.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in "xy" for f, n in ((F.min, "lo"), (F.max, "hi"))])

    def cell(c):
        width = F.nullif((F.col(f"{c}_hi") - F.col(f"{c}_lo")) / grid, F.lit(0.0))
        return F.coalesce(F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / width).cast("int"), F.lit(grid - 1)), F.lit(0))

    return attach(rows, edges, keys).groupBy(*keys, cell("x").alias("x_bin"), cell("y").alias("y_bin")).agg(
        F.count(F.lit(1)).alias("count")).withColumn("log_count", F.log10("count"))


def unit_sanity_check(df: DataFrame, keys=KEYS) -> DataFrame:
    """Range against the expected unit per known signal: ok, WARNING, CRITICAL or NO DATA, with a note."""
    rules = cfg.unit_check_table(df.sparkSession)
    signals = [c[0] for c in cfg.UNIT_CHECKS if c[0] in df.columns]
    base = aggregate_signals(df, keys, signals, lambda s: {
        "n_valid": F.count(s), "observed_min": F.min(s).cast("double"), "observed_max": F.max(s).cast("double")})
    q = signal_quantiles(df, signals, (0.05, 0.5, 0.95), ("p5", "median", "p95"), keys)
    r = null_safe_join(base, q, [*keys, "signal"]).join(F.broadcast(rules), "signal")
    hint = F.col("hint")
    radians = (hint == "radian") & (F.abs("p95") < 2) & (F.abs("p5") < 2)
    slow = (hint == "ms") & (F.col("p95") < 13) & (F.col("median") > 0.5)
    metric_speed = slow & (F.col("observed_max") < 15) & (F.col("median") < 6)
    watts = (hint == "watt") & (F.col("p95") > 100000)
    millimetres = (hint == "mm") & (F.col("p95") > 100)
    beyond = (F.col("observed_min") < F.col("ok_lo")) | (F.col("p95") > F.col("ok_hi"))

    def choose(none, critical, warn_hint, ok, warn):
        return (F.when(F.col("n_valid") == 0, none).when(radians, critical).when(metric_speed, warn_hint).when(slow, ok)
                .when(watts | millimetres, critical).when(beyond, warn).otherwise(ok))

    status = choose(*[F.lit(x) for x in ("NO DATA", "CRITICAL", "WARNING", "ok", "WARNING")])
    note = choose(F.lit("No valid numeric values"), F.col("note_hint"), F.col("note_hint"), F.col("note_ok"), F.col("note_warn"))
    return r.select(*keys, F.col("signal").alias("column"), "label", "n_valid",
                    *[half_even(c, 4).alias(c) for c in ("observed_min", "p5", "median", "p95", "observed_max")],
                    status.alias("status"), note.alias("note"))


def duplicate_rows(df: DataFrame, keys=KEYS) -> DataFrame:
    """Rows beyond the first copy of each. Only rows whose hash repeats are compared in full, so the
    common case moves one number per row and not the row."""
    content = [c for c in df.columns if c not in keys]
    hashed = df.withColumn("_h", F.xxhash64(*[F.col(c) for c in df.columns]))
    repeated = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("_h")
    copies = hashed.join(repeated, "_h", "left_semi").groupBy(*keys, *content).agg(F.count(F.lit(1)).alias("_c"))
    return copies.groupBy(*keys).agg(F.sum(F.col("_c") - 1).alias("n_duplicate_rows"))


def basic_metrics(df: DataFrame, ignore=("rid",), keys=KEYS) -> DataFrame:
    """Rows, columns, duplicate rows and columns with gaps, as one row per key and metric."""
    data = df.drop(*ignore)
    columns = [c for c in data.columns if c not in keys]
    gaps = sum([F.max(F.col(c).isNull().cast("bigint")) for c in columns], F.lit(0))
    base = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(data.columns)).cast("bigint").alias("n_columns"),
                                   gaps.cast("bigint").alias("n_columns_with_missing"))
    out = null_safe_join(base, duplicate_rows(data, keys), keys).na.fill(0, ["n_duplicate_rows"])
    return out.unpivot(list(keys), ["n_rows", "n_columns", "n_duplicate_rows", "n_columns_with_missing"], "metric", "value")


def cleaning_report(df: DataFrame, features, keys=KEYS) -> DataFrame:
    """Totals and, over complete rows only, the sums of the constraint flags."""
    ok = all_of([F.col(f).isNotNull() for f in features])
    flags = ("flag_negative_power", "flag_extreme_trim", "flag_invalid_draft", "flag_any_constraint")
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_records"), count_where(ok).alias("valid_records"),
        count_where(~ok).alias("missing_records"), F.lit(len(features)).cast("bigint").alias("n_features"),
        *[(count_where(ok & F.col(f)) if f in df.columns else F.lit(0).cast("bigint")).alias(f) for f in flags])
    return out.unpivot(list(keys), [c for c in out.columns if c not in keys], "metric", "value")


def series_overview(df: DataFrame, signals, keys=KEYS, time="Date") -> DataFrame:
    """n, missing, median and the p1-p99 band per signal over dated rows."""
    dated = df.where(F.col(time).isNotNull())
    base = aggregate_signals(dated, keys, signals, lambda s: {"n": F.count(s), "n_missing": count_where(F.col(s).isNull())})
    return null_safe_join(base, signal_quantiles(dated, signals, (0.01, 0.5, 0.99), ("p01", "median", "p99"), keys),
                          [*keys, "signal"])
