"""Raw export -> canonical sensor schema: renames, parsing, units, scaling, sampling."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.errors import AnalysisException

from .. import config as cfg
from ..functions.columns import (blank_to_null, col, nan_to_null, null_safe_join, parse_timestamp, scaled,
                                 strict_timestamp, to_numeric)
from .ordered import Ordered, attach
from .quantiles import quantile, with_quantiles

TEXT_COLUMNS = ("source_file", "vessel_id")


def rename_columns(df: DataFrame, config: cfg.VesselConfig) -> DataFrame:
    return df.withColumnsRenamed({raw: std for raw, std in config.column_map.items() if raw in df.columns})


def vessel_id_of(path) -> Column:
    """Vessel id from a path column: the first configured hint contained in it, else 'default'."""
    low = F.lower(col(path))
    chain = F
    for v in cfg.VESSELS:
        chain = chain.when(low.contains(v.folder_hint), v.vessel_id)
    return chain.otherwise(cfg.DEFAULT.vessel_id)


def tag_vessel(df: DataFrame, path="source_path") -> DataFrame:
    return df.withColumn("vessel_id", vessel_id_of(path))


def trim_text(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    return df.withColumns({c: blank_to_null(F.col(f"`{c}`")) for c in text})


def parse_dates(df: DataFrame, config: cfg.VesselConfig) -> DataFrame:
    """Strict pattern when the config has one, unless it fails on more than half of the rows."""
    ts = config.timestamp_col
    if ts not in df.columns or df.schema[ts].dataType.typeName().startswith("timestamp"):
        return df
    if config.date_format:
        strict = strict_timestamp(ts, config.date_format)
        failed = df.agg(F.avg(strict.isNull().cast("int"))).first()[0] or 0.0
        if failed <= 0.5:
            return df.withColumn(ts, strict)
    return df.withColumn(ts, parse_timestamp(ts))


def numeric_signals(df: DataFrame, config: cfg.VesselConfig, extra=()) -> DataFrame:
    """Lenient cast of every text column that is not a timestamp or provenance column."""
    keep = {config.timestamp_col, *TEXT_COLUMNS, *extra}
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name not in keep]
    return df.withColumns({c: to_numeric(F.col(f"`{c}`")) for c in text})


def sentinel_to_null(df: DataFrame, sentinels: dict) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(float(v))) for c, v in sentinels.items() if c in df.columns})


def add_derived(df: DataFrame, derived: dict) -> DataFrame:
    """Derived columns that are not there yet; one whose inputs are missing is skipped with a warning."""
    for name, sql in derived.items():
        if name not in df.columns:
            try:
                df = df.withColumn(name, F.expr(sql))
                df.schema
            except AnalysisException as problem:
                warnings.warn(f"could not derive {name}: {problem.getCondition()}")
    return df


def normalize(df: DataFrame, config: cfg.VesselConfig, extra_text=()) -> DataFrame:
    """All of the above, in order; NaN is read as missing everywhere."""
    df = trim_text(rename_columns(df, config))
    df = numeric_signals(parse_dates(df, config), config, extra_text)
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    df = df.withColumns({c: nan_to_null(F.col(f"`{c}`")) for c in doubles})
    return add_derived(sentinel_to_null(df, config.sentinels), config.derived)


def null_bad_avg_draft(df: DataFrame) -> DataFrame:
    if not {"DRAFTAFT", "DRAFTFWD", "Avg_draft_m"} <= set(df.columns):
        return df
    return df.withColumn("Avg_draft_m", F.when(F.col("DRAFTAFT").isNotNull() & F.col("DRAFTFWD").isNotNull(),
                                               F.col("Avg_draft_m")))


def radians_to_degrees(df: DataFrame, keys=("vessel_id",), lat="GPS_LAT", lon="GPS_LON") -> DataFrame:
    """Positions whose median latitude is below 2 are taken to be radians and converted."""
    mid = quantile(df, keys, lat, 0.5, "_mid")
    radians = F.abs(F.col("_mid")) < 2
    return (attach(df, mid, keys)
            .withColumns({c: F.when(radians, F.degrees(c)).otherwise(F.col(c)) for c in (lat, lon)}).drop("_mid"))


def feature_projection(df: DataFrame, features, keep=("vessel_id", "rid", "Date")) -> DataFrame:
    absent = [f for f in features if f not in df.columns]
    if absent:
        warnings.warn(f"feature columns not in the data: {absent}")
    return df.select(*[k for k in keep if k in df.columns], *[f for f in features if f in df.columns])


def fit_minmax(df: DataFrame, features, keys=()) -> DataFrame:
    """One row per key with `<f>_lo` / `<f>_hi`; map-side aggregation, so only group rows move."""
    return df.groupBy(*keys).agg(*[g(f).alias(f"{f}_{s}") for f in features
                                   for g, s in ((F.min, "lo"), (F.max, "hi"))])


def minmax_scale(df: DataFrame, features, keys=(), fitted: DataFrame | None = None, suffix: str = "") -> DataFrame:
    """Scale with a fitted table (or fit on `df`). Constant columns give 0; inference never clips."""
    ranged = attach(df, fit_minmax(df, features, keys), keys) if fitted is None else null_safe_join(df, fitted, keys)
    out = ranged.withColumns(
        {f + suffix: scaled(F.col(f), F.col(f"{f}_lo"), F.col(f"{f}_hi")) for f in features})
    return out.drop(*[f"{f}_{s}" for f in features for s in ("lo", "hi")])


def inverse_minmax(centres: DataFrame, fitted: DataFrame, features, keys=()) -> DataFrame:
    out = attach(centres, fitted, keys).withColumns(
        {f: F.col(f) * F.coalesce(F.nullif(F.col(f"{f}_hi") - F.col(f"{f}_lo"), F.lit(0.0)), F.lit(1.0))
            + F.col(f"{f}_lo") for f in features})
    return out.drop(*[f"{f}_{s}" for f in features for s in ("lo", "hi")])


def thin_every_kth(df: DataFrame, keys, order, cap: int) -> DataFrame:
    """Rows 0, k, 2k, … of each key with k = rows // cap (all rows when there are at most `cap`)."""
    size = df.groupBy(*keys).agg(F.greatest(F.floor(F.count(F.lit(1)) / cap), F.lit(1)).alias("_k"))
    numbered = Ordered(df, keys, order).position("_i").result()
    return attach(numbered, size, keys).where(F.col("_i") % F.col("_k") == 0).drop("_i", "_k")


def sample_n(df: DataFrame, n: int, rid: str = "rid", seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, uniform and repeatable: the n smallest seeded hashes of the row id."""
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(rid).cast("string"), F.lit(str(seed)))))
    return hashed.orderBy("_h").limit(n).drop("_h")


def winsorize(df: DataFrame, keys, signals, lo: float, hi: float) -> DataFrame:
    """Clip each signal to its own quantiles."""
    edges = with_quantiles(df, keys, {s: s for s in signals}, [lo, hi], ["_qlo", "_qhi"])
    clipped = {s: F.when(F.col(s).isNotNull(), F.least(F.greatest(F.col(s), F.col(f"{s}__qlo")), F.col(f"{s}__qhi")))
               for s in signals}
    return (attach(df, edges, keys).withColumns(clipped)
            .drop(*[f"{s}__q{e}" for s in signals for e in ("lo", "hi")]))


def signal_profiles(signals: DataFrame) -> DataFrame:
    """Profile of each name in `signals.signal`: exact name first, then alias, then an empty profile."""
    table = cfg.signal_profile_table(signals.sparkSession)
    best = table.groupBy("signal").agg(F.min_by(F.struct("label", "unit", "phys_lo", "phys_hi",
                                                         "negative_is_anomaly", "expect"), "is_alias").alias("p"))
    return signals.join(F.broadcast(best), "signal", "left").select(
        signals["*"], F.coalesce("p.label", "signal").alias("label"), F.coalesce("p.unit", F.lit("")).alias("unit"),
        "p.phys_lo", "p.phys_hi", F.coalesce("p.negative_is_anomaly", F.lit(False)).alias("negative_is_anomaly"),
        F.coalesce("p.expect", F.lit("")).alias("expect"))


def describe_signals(signals: DataFrame) -> DataFrame:
    """`description` and `notes` per signal; names without a role get one from their prefix or profile."""
    roles = cfg.signal_role_table(signals.sparkSession)
    n = F.col("signal")
    sentence = F.concat("label", F.when(F.col("label").endswith("."), "").otherwise("."),
                        F.when(F.col("expect") != "", F.concat(F.lit(" "), "expect")).otherwise(""))
    generator = F.regexp_replace(F.regexp_replace(n, "GE", ""), "_Power_kW", "")

    def text(prefix):
        return F.concat(F.lit(prefix), n, F.lit("."))

    fallback = (F.when(n.startswith("AE "), text("Auxiliary emergency engine signal: "))
                .when(n.startswith("Blr ") | n.startswith("Cmp Blr "), text("Boiler fuel/flow signal: "))
                .when(n.startswith("GE") & n.contains("_Power_kW"),
                      F.concat(F.lit("Generator engine "), generator, F.lit(" electrical output in kW.")))
                .when(n.startswith("Fuel ") & n.rlike("Grav|LHV|Sulphur"),
                      text("Fuel quality property (density/LHV/sulphur content): "))
                .when(n.contains("Temp") | n.contains("Â°C"), text("Temperature measurement: "))
                .when(n.contains("Rudder"),
                      F.lit("Rudder angle in degrees; indicates steering activity and course-keeping effort."))
                .when(n.contains("Cool") & n.contains("SW"), text("Sea water cooling system temperature: "))
                .otherwise(sentence))
    return (signals.join(F.broadcast(roles), "signal", "left")
            .withColumns({"description": F.coalesce("description", fallback),
                          "notes": F.coalesce("port_notes", F.lit(""))}).drop("port_notes"))
