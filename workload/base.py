"""Sensor-shaped views of the given tables, shared by the queries and their SQL counterparts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

INTERVAL = 300       # expected seconds between readings of one vessel in the bound data
STEP = 3600.0        # longest step a rate of change may span in the bound data

VESSEL_SELECT = """
  event_id AS rid, ts AS Date, event_type AS vessel_id, 'events' AS source_file,
  value % 22e0 AS GPSSpeed_kn,
  CASE WHEN event_id % 97 < 5 THEN NULL ELSE (value-5e0)*40e0 END AS Main_Engine_Power_kW,
  CASE WHEN event_id % 89 < 3 THEN NULL ELSE value/3e0 + event_id%7 END AS Fuel_Consumption_t_per_day,
  CASE WHEN event_id % 97 < 4 THEN NULL ELSE 5e0+(floor(event_id/40)%7)*0.25e0 END AS DRAFTAFT,
  CASE WHEN event_id % 101 = 0 THEN -9999e0 ELSE 5e0+(floor(event_id/60)%5)*0.5e0 END AS DRAFTFWD,
  (event_id % 13) - 6.5e0 AS Trim_m,  (event_id % 11) - 0.5e0 AS Avg_draft_m,
  (value*7e0) % 360e0 - 180e0 AS RelWindAngle_deg,
  CASE WHEN event_id % 97 < 5 THEN NULL ELSE value % 35e0 END AS RelWindSpeed_kn,
  0.9e0 + (event_id % 50)*0.004e0 AS GPS_LAT, 0.1e0 + (event_id % 40)*0.005e0 AS GPS_LON
"""
SIGNALS = ["GPSSpeed_kn", "Main_Engine_Power_kW", "Fuel_Consumption_t_per_day", "DRAFTAFT", "DRAFTFWD", "Trim_m",
           "Avg_draft_m", "RelWindAngle_deg", "RelWindSpeed_kn", "GPS_LAT", "GPS_LON"]
GAPPY = ["Main_Engine_Power_kW", "Fuel_Consumption_t_per_day", "DRAFTAFT", "RelWindSpeed_kn"]
FEATURES = ["GPSSpeed_kn", "Main_Engine_Power_kW", "Fuel_Consumption_t_per_day", "Avg_draft_m", "Trim_m",
            "RelWindSpeed_kn"]

V = f"WITH v AS (SELECT {VESSEL_SELECT} FROM events)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vessel(spark: SparkSession, sf: str) -> DataFrame:
    lines = [p.strip() for p in _split(VESSEL_SELECT)]
    return table(spark, sf, "events").selectExpr(*lines)


def _split(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, cur = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def with_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    v = vessel(spark, sf)
    return v.unionByName(v.where("rid % 50 = 0").withColumn("rid", F.col("rid") + 1_000_000_000_000))


VD = f"""WITH v0 AS (SELECT {VESSEL_SELECT} FROM events),
v AS (SELECT * FROM v0 UNION ALL SELECT rid + 1000000000000, * EXCLUDE (rid) FROM v0 WHERE rid % 50 = 0)"""


def rounded(df: DataFrame, digits: int = 6, **special) -> DataFrame:
    """Round double outputs so both engines print the same digits."""
    cols = {f.name: F.bround(F.col(f.name), special.get(f.name, digits)) for f in df.schema.fields
            if f.dataType.typeName() == "double"}
    return df.withColumns(cols)


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the shared folder in spark.checkpoint.dir; a temporary one only in a session on this machine alone."""
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base}/keelson-{uuid.uuid4().hex}" if base else os.path.join(tempfile.mkdtemp(prefix="keelson-"), "out")


def unpivot_sql(signals, source="v", keys="vessel_id") -> str:
    """(keys, rid, Date, signal, value) over non-null cells."""
    return " UNION ALL ".join(
        f"SELECT {keys}, rid, Date, '{s}' AS signal, CAST({s} AS DOUBLE) AS value FROM {source} WHERE {s} IS NOT NULL"
        for s in signals)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Flagged and scored vessel rows: is_anomaly = score above the vessel's p95, or a constraint violation."""
    from keelson.operators import ensemble, flags
    lines = [p.strip() for p in _split(VESSEL_SELECT)]
    v = flags.constraint_flags(table(spark, sf, "events").selectExpr(*lines, "abs(value - 50e0) AS anomaly_score"))
    keys = ("vessel_id",)
    hot = ensemble.apply_thresholds(v, ensemble.threshold_by_group(v, "anomaly_score", 95, keys), "anomaly_score", "hot", keys)
    return (hot.withColumn("is_anomaly", F.col("hot") | F.col("flag_any_constraint"))
            .withColumn("cluster_name", F.expr("CASE WHEN GPSSpeed_kn < 3 THEN 'SlowSpeed' WHEN GPSSpeed_kn < 10 THEN 'MediumSpeed' ELSE 'HighSpeed' END")))


FLAG_SQL = """coalesce(Main_Engine_Power_kW < 0, false) AS flag_negative_power, coalesce(abs(Trim_m) > 5, false) AS flag_extreme_trim,
  coalesce(Avg_draft_m <= 0, false) AS flag_invalid_draft,
  coalesce(Main_Engine_Power_kW < 0, false) OR coalesce(abs(Trim_m) > 5, false) OR coalesce(Avg_draft_m <= 0, false) AS flag_any_constraint"""
VS = f"""WITH v AS MATERIALIZED (SELECT {VESSEL_SELECT}, abs(value - 50e0) AS anomaly_score FROM events),
thr AS (SELECT vessel_id, quantile_cont(anomaly_score, 0.95) AS thr FROM v GROUP BY 1),
f AS (SELECT v.*, {FLAG_SQL}, anomaly_score > thr AS hot FROM v JOIN thr USING (vessel_id)),
a AS MATERIALIZED (SELECT *, hot OR flag_any_constraint AS is_anomaly,
  CASE WHEN GPSSpeed_kn < 3 THEN 'SlowSpeed' WHEN GPSSpeed_kn < 10 THEN 'MediumSpeed' ELSE 'HighSpeed' END AS cluster_name FROM f)"""
