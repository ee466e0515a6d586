"""Source, normalisation and sampling queries. Raw exports are written from the given tables first, then read back."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from keelson import config as cfg
from keelson.functions import columns as X
from keelson.operators import flags as L
from keelson.operators import normalize as N
from keelson.plans import jobs
from keelson.sources import excel, files

from .base import FEATURES, SIGNALS, V, rounded, scratch, table, vessel
from .profiles import PROFILE_ROWS, UN, _values

STENA = cfg.STENALINE
BACK = {std: raw for raw, std in STENA.column_map.items()}
ISO, DAY_FIRST = "yyyy-MM-dd HH:mm:ss.SSSSSS", "dd/MM/yyyy HH:mm:ss"


def raw_export(s, d):
    """The vessel rows under raw column names, all text: two date styles, blanks for missing, positions in radians."""
    v = vessel(s, d)
    iso = F.col("rid") % 2 == 0
    text = {"Main_Engine_Power_kW": F.coalesce(F.col("Main_Engine_Power_kW").cast("string"), F.lit("  "))}
    out = v.select(
        F.when(iso, F.date_format("Date", ISO)).otherwise(F.date_format("Date", DAY_FIRST)).alias("sensor_time"),
        F.col("GPSSpeed_kn").alias("SOG"), F.col("GPS_LAT").alias("LAT"), F.col("GPS_LON").alias("LONG"),
        text["Main_Engine_Power_kW"].alias("PropulsionPowerTotal"), F.col("Fuel_Consumption_t_per_day").alias("FuelMassFlowMETotal"),
        F.col("DRAFTAFT").alias("DraftAftDynamic"), F.col("DRAFTFWD").alias("DraftFwdDynamic"), F.col("RelWindSpeed_kn").alias("AWS"),
        F.col("RelWindAngle_deg").alias("AWA"), F.col("rid").cast("string").alias("raw_id"))
    return out.select(*[F.col(c).cast("string").alias(c) for c in out.columns])


def raw_folder(s, d):
    path = f"{scratch(s)}/stenaline"
    _in_files(raw_export(s, d)).write.option("header", True).csv(path)
    return path


def _in_files(raw):
    """The rows in ascending order over the files, so that file order, then row order, is the order of raw_id."""
    key = F.col("raw_id").cast("bigint")
    return raw.repartitionByRange(key).sortWithinPartitions(key)


TS = "CASE WHEN rid % 2 = 0 THEN Date ELSE date_trunc('second', Date) END"
RAWED = f"""{V}, r AS (SELECT rid AS raw_id, {TS} AS Date, GPSSpeed_kn, GPS_LAT, GPS_LON, Main_Engine_Power_kW,
 Fuel_Consumption_t_per_day AS Fuel_Consumption_rate, DRAFTAFT, DRAFTFWD, RelWindSpeed_kn, RelWindAngle_deg,
 (DRAFTAFT + DRAFTFWD)/2 AS Avg_draft_m, DRAFTAFT - DRAFTFWD AS Trim_m FROM v)"""
LOADED = ["Date", "GPSSpeed_kn", "GPS_LAT", "GPS_LON", "Main_Engine_Power_kW", "Fuel_Consumption_rate", "DRAFTAFT", "DRAFTFWD",
          "RelWindSpeed_kn", "RelWindAngle_deg", "Avg_draft_m", "Trim_m"]
ORDERED = "row_number() OVER (ORDER BY {}) - 1 AS rid"
LOADED_SQL = ", ".join(c if c == "Date" else f"round_even({c}, 6) AS {c}" for c in LOADED)


def _load_raw(s, d):
    df = files.load_raw(s, raw_folder(s, d))
    return rounded(df.select("rid", F.col("raw_id").cast("bigint").alias("raw_id"), "vessel_id", *LOADED))


def _mixed_layouts(s, d):
    """Two layouts side by side: one without wind, one with an extra column."""
    base = f"{scratch(s)}/stenaline"
    raw = _in_files(raw_export(s, d))
    raw.where("raw_id % 3 <> 0").drop("AWS", "AWA").write.option("header", True).csv(f"{base}/a")
    raw.where("raw_id % 3 = 0").withColumn("Extra", F.lit("7.5")).write.option("header", True).csv(f"{base}/b")
    df = files.load_raw(s, base)
    return rounded(df.select("rid", F.col("raw_id").cast("bigint").alias("raw_id"), "GPSSpeed_kn", "RelWindSpeed_kn",
                             F.col("Extra").cast("double").alias("Extra")))


def _discover(s, d):
    path = scratch(s)
    vessel(s, d).select("vessel_id", "rid").repartition("vessel_id").write.partitionBy("vessel_id").option("header", True).csv(path)
    found = cfg.local_table(s, [(f,) for f in files.discover_files(s, path)], "path string")
    return found.select(F.regexp_extract("path", "vessel_id=([^/]+)/", 1).alias("vessel_id"),
                        F.regexp_extract("path", r"\.(\w+)$", 1).alias("extension")).distinct()


def _glob(s, d):
    return rounded(files.scan_columns_glob(s, raw_folder(s, d), "part-*.csv", ["LAT", "LONG"]).select(
        X.to_numeric("LAT").alias("LAT"), X.to_numeric("LONG").alias("LONG")).groupBy("LAT", "LONG").agg(F.count(F.lit(1)).alias("n")))


COLS = ["sensor_time", "SOG", "PropulsionPowerTotal", "raw_id"]


def _workbook(pdf: pd.DataFrame) -> bytes:
    """A minimal one-sheet workbook with inline text, numbers and one date style."""
    def cell(ref, v):
        if isinstance(v, pd.Timestamp):
            return f'<c r="{ref}" s="1"><v>{(v - pd.Timestamp("1899-12-30")).total_seconds() / 86400:.12f}</v></c>'
        if isinstance(v, str):
            return f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return "" if v is None or pd.isna(v) else f'<c r="{ref}"><v>{v!r}</v></c>'
    rows = [list(pdf.columns), *pdf.itertuples(index=False, name=None)]
    body = "".join(f'<row r="{i + 1}">{"".join(cell(f"{chr(65 + j)}{i + 1}", v) for j, v in enumerate(r))}</row>' for i, r in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def _excel(s, d):
    """Workbooks of at most 2,000 rows each, written and parsed on the executors."""
    v = vessel(s, d).select(F.floor(F.col("rid") / 2000).alias("book"), F.date_trunc("second", "Date").alias("t"), "GPSSpeed_kn", "Main_Engine_Power_kW",
                            F.concat(F.lit("r"), F.col("rid").cast("string")).alias("tag"), "rid")

    def pack(pdf):
        pdf = pdf.sort_values("rid")
        sheet = pd.DataFrame({"Time stamp": pdf["t"], "SPEED OVER GROUND [kn]": pdf["GPSSpeed_kn"].astype(float),
                              "SHAFT POWER[kW]": pdf["Main_Engine_Power_kW"].astype(object), "tag": pdf["tag"]})
        return pd.DataFrame({"path": [f"grimaldi/{int(pdf['book'].iloc[0])}.xlsx"], "content": [_workbook(sheet)]})

    books = v.groupBy("book").applyInPandas(pack, "path string, content binary")
    header = ["Time stamp", "SPEED OVER GROUND [kn]", "SHAFT POWER[kW]", "tag"]
    df = N.normalize(excel.parse_workbooks(books, header), cfg.GRIMALDI, extra_text=("tag", "_path"))
    return rounded(df.select("tag", F.date_trunc("second", F.col("Date") + F.expr("INTERVAL 500 MILLISECONDS")).alias("Date"), "GPSSpeed_kn",
                             "Main_Engine_Power_kW", "_row"))


def _signals(s, d):
    """Signal names found in the data, with their reading counts."""
    return L.aggregate_signals(vessel(s, d), ("vessel_id",), SIGNALS, lambda c: {"n": F.count(c)})


def _units(s, d):
    raw = cfg.local_table(s, [(std, r) for r, std in cfg.GRIMALDI.column_map.items()], "signal string, raw_column_name string")
    return _signals(s, d).join(F.broadcast(raw), "signal").select("vessel_id", "signal", "raw_column_name", "n", X.unit_in_name("raw_column_name").alias("unit"))


GRIM = [(std, r) for r, std in cfg.GRIMALDI.column_map.items() if std in SIGNALS]
ROLES = {r[0]: (r[1], r[2]) for r in cfg.SIGNAL_ROLES}
PROF = {n: p for p in cfg.SIGNAL_PROFILES for n in (*p[6], p[0])}


def _strict(s, d):
    """A pattern that fits only half of the rows falls back to detection; one that fits all is kept."""
    raw = raw_export(s, d).select("raw_id", "sensor_time")
    odd = cfg.VesselConfig("x", "x", timestamp_col="sensor_time", date_format="yyyy/MM/dd")
    even = cfg.VesselConfig("y", "y", timestamp_col="sensor_time", date_format=ISO)
    a = N.parse_dates(raw, odd).select("raw_id", F.col("sensor_time").alias("fallback"))
    b = N.parse_dates(raw, even).select("raw_id", F.col("sensor_time").alias("strict"))
    return a.join(b, "raw_id").select(F.col("raw_id").cast("bigint").alias("raw_id"), "fallback", "strict")


QUERIES = {
    "discover_files": (_discover, "SELECT DISTINCT event_type AS vessel_id, 'csv' AS extension FROM events"),
    "load_raw": (_load_raw, f"{RAWED} SELECT {ORDERED.format('raw_id')}, raw_id, 'stenaline' AS vessel_id, {LOADED_SQL} FROM r"),
    "union_all_files": (
        _mixed_layouts,
        f"""{RAWED} SELECT {ORDERED.format('raw_id % 3 = 0, raw_id')}, raw_id, round_even(GPSSpeed_kn, 6) AS GPSSpeed_kn, CASE WHEN raw_id % 3 = 0 THEN round_even(RelWindSpeed_kn, 6) END AS RelWindSpeed_kn,
        CASE WHEN raw_id % 3 = 0 THEN 7.5e0 END AS Extra FROM r"""),
    "scan_csv": (
        lambda s, d: files.scan_csv(s, raw_folder(s, d), raw_export(s, d).columns).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("raw_id").alias("ids"), F.count(X.blank_to_null("PropulsionPowerTotal")).alias("powered")),
        f"{V} SELECT count(*) AS n, count(DISTINCT rid) AS ids, count(Main_Engine_Power_kW) AS powered FROM v"),
    "scan_columns_glob": (
        _glob, f"{V} SELECT round_even(GPS_LAT, 6) AS LAT, round_even(GPS_LON, 6) AS LONG, count(*) AS n FROM v GROUP BY 1, 2"),
    "scan_excel": (
        _excel, f"""{V} SELECT 'r' || rid AS tag, date_trunc('second', Date) AS Date, round_even(GPSSpeed_kn, 6) AS GPSSpeed_kn,
        round_even(Main_Engine_Power_kW, 6) AS Main_Engine_Power_kW, rid % 2000 AS _row FROM v"""),
    "rename_columns": (
        lambda s, d: N.rename_columns(raw_export(s, d), STENA).select("raw_id", "GPSSpeed_kn", "DRAFTAFT").select(
            "raw_id", F.bround(X.to_numeric("GPSSpeed_kn"), 6).alias("GPSSpeed_kn"), X.to_numeric("DRAFTAFT").alias("DRAFTAFT")),
        f"{V} SELECT CAST(rid AS VARCHAR) AS raw_id, round_even(GPSSpeed_kn, 6) AS GPSSpeed_kn, DRAFTAFT FROM v"),
    "tag_vessel": (
        lambda s, d: N.tag_vessel(table(s, d, "pages").select("page_id", F.concat(F.lit("/data/"), F.element_at(F.array(
            F.lit("StenaLine"), F.lit("x_STENATEKNIK"), F.lit("Grimaldi/a"), F.lit("other")), (F.col("page_id") % 4 + 1).cast("int"))).alias("source_path"))),
        """SELECT page_id, '/data/' || ['StenaLine', 'x_STENATEKNIK', 'Grimaldi/a', 'other'][page_id % 4 + 1] AS source_path,
        ['stenaline', 'stenateknik', 'grimaldi', 'default'][page_id % 4 + 1] AS vessel_id FROM pages"""),
    "blank_to_null": (
        lambda s, d: N.trim_text(raw_export(s, d)).select("raw_id", F.col("PropulsionPowerTotal").isNull().alias("missing")),
        f"{V} SELECT CAST(rid AS VARCHAR) AS raw_id, Main_Engine_Power_kW IS NULL AS missing FROM v"),
    "parse_timestamp_auto": (
        lambda s, d: raw_export(s, d).select(F.col("raw_id").cast("bigint").alias("raw_id"), X.parse_timestamp("sensor_time").alias("Date"),
                                             X.parse_timestamp(F.concat(F.lit("no "), "sensor_time")).alias("bad")),
        f"{V} SELECT rid AS raw_id, {TS} AS Date, CAST(NULL AS TIMESTAMP) AS bad FROM v"),
    "parse_timestamp_with_fallback": (
        _strict, f"{V} SELECT rid AS raw_id, {TS} AS fallback, CASE WHEN rid % 2 = 0 THEN Date END AS strict FROM v"),
    "sentinel_to_null": (
        lambda s, d: N.sentinel_to_null(vessel(s, d), cfg.DEFAULT.sentinels).select("rid", "DRAFTFWD", "DRAFTAFT"),
        f"{V} SELECT rid, nullif(DRAFTFWD, -9999) AS DRAFTFWD, DRAFTAFT FROM v"),
    "derive_draft_trim": (
        lambda s, d: N.add_derived(vessel(s, d).drop("Avg_draft_m", "Trim_m"), STENA.derived).select("rid", "Avg_draft_m", "Trim_m"),
        f"{V} SELECT rid, (DRAFTAFT + DRAFTFWD)/2 AS Avg_draft_m, DRAFTAFT - DRAFTFWD AS Trim_m FROM v"),
    "to_numeric": (
        lambda s, d: table(s, d, "events").select("event_id", X.to_numeric(F.regexp_extract("props", r"(\d+)", 1)).alias("k"), X.to_numeric("props").alias("bad"),
                                                  X.to_numeric("event_type").alias("word")),
        r"SELECT event_id, TRY_CAST(regexp_extract(props, '(\d+)', 1) AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS bad, TRY_CAST(event_type AS DOUBLE) AS word FROM events"),
    "null_bad_avg_draft": (
        lambda s, d: N.null_bad_avg_draft(vessel(s, d)).select("rid", "Avg_draft_m"),
        f"{V} SELECT rid, CASE WHEN DRAFTAFT IS NOT NULL AND DRAFTFWD IS NOT NULL THEN Avg_draft_m END AS Avg_draft_m FROM v"),
    "radians_to_degrees": (
        lambda s, d: rounded(N.radians_to_degrees(_half_degrees(s, d)).select("rid", "vessel_id", "GPS_LAT", "GPS_LON")),
        f"""{V}, h AS (SELECT * REPLACE (CASE WHEN vessel_id < 'm' THEN degrees(GPS_LAT) ELSE GPS_LAT END AS GPS_LAT,
        CASE WHEN vessel_id < 'm' THEN degrees(GPS_LON) ELSE GPS_LON END AS GPS_LON) FROM v), m AS (SELECT vessel_id, abs(quantile_cont(GPS_LAT, .5)) < 2 AS r FROM h GROUP BY 1)
        SELECT rid, vessel_id, round_even(CASE WHEN r THEN degrees(GPS_LAT) ELSE GPS_LAT END, 6) AS GPS_LAT,
        round_even(CASE WHEN r THEN degrees(GPS_LON) ELSE GPS_LON END, 6) AS GPS_LON FROM h JOIN m USING (vessel_id)"""),
    "feature_projection": (
        lambda s, d: rounded(N.feature_projection(vessel(s, d), cfg.DEFAULT.feature_cols)),
        f"{V} SELECT vessel_id, rid, Date, {', '.join(f'round_even({c}, 6) AS {c}' for c in cfg.DEFAULT.feature_cols if c in SIGNALS)} FROM v"),
    "feature_group_of": (
        lambda s, d: _signals(s, d).join(F.broadcast(cfg.feature_group_table(s, SIGNALS)), "signal"),
        f"""{UN}, g AS (SELECT * FROM (VALUES {_values([(r[0], r[1]) for r in PROFILE_ROWS])}) t(signal, feature_group))
        SELECT vessel_id, signal, count(*) AS n, any_value(feature_group) AS feature_group FROM l JOIN g USING (signal) GROUP BY 1, 2"""),
    "signal_profile_lookup": (
        lambda s, d: N.signal_profiles(_signals(s, d)).drop("expect"),
        f"""{UN}, g AS (SELECT * FROM (VALUES {_values([(c, PROF[c][1] if c in PROF else c, PROF[c][2] if c in PROF else '', PROF[c][3] if c in PROF else None,
            PROF[c][4] if c in PROF else None, PROF[c][5] if c in PROF else False) for c in SIGNALS])}) t(signal, label, unit, phys_lo, phys_hi, negative_is_anomaly))
        SELECT vessel_id, signal, count(*) AS n, any_value(label) AS label, any_value(unit) AS unit, any_value(phys_lo) AS phys_lo, any_value(phys_hi) AS phys_hi,
        any_value(negative_is_anomaly) AS negative_is_anomaly FROM l JOIN g USING (signal) GROUP BY 1, 2"""),
    "unit_from_column_name": (
        _units, f"""{UN}, g AS (SELECT * FROM (VALUES {_values(GRIM)}) t(signal, raw_column_name))
        SELECT vessel_id, signal, any_value(raw_column_name) AS raw_column_name, count(*) AS n,
        any_value(trim(regexp_extract(raw_column_name, '\\[([^\\]]+)\\]', 1))) AS unit FROM l JOIN g USING (signal) GROUP BY 1, 2"""),
    "describe_signal": (
        lambda s, d: N.describe_signals(N.signal_profiles(_signals(s, d))).select("vessel_id", "signal", "n", "description", "notes"),
        f"""{UN}, g AS (SELECT * FROM (VALUES {_values([(c, *ROLES[c]) for c in SIGNALS])}) t(signal, description, notes))
        SELECT vessel_id, signal, count(*) AS n, any_value(description) AS description, any_value(notes) AS notes FROM l JOIN g USING (signal) GROUP BY 1, 2"""),
    "wrap_angle": (
        lambda s, d: rounded(vessel(s, d).select("rid", X.wrap_angle("RelWindAngle_deg").alias("angle"))),
        f"{V} SELECT rid, round_even((RelWindAngle_deg % 360 + 360) % 360, 6) AS angle FROM v"),
    "thin_every_kth": (
        lambda s, d: N.thin_every_kth(vessel(s, d), ["vessel_id"], ["Date", "rid"], 150).select("vessel_id", "rid"),
        f"""{V}, r AS (SELECT vessel_id, rid, row_number() OVER (PARTITION BY vessel_id ORDER BY Date, rid) - 1 AS i, count(*) OVER (PARTITION BY vessel_id) AS n FROM v)
        SELECT vessel_id, rid FROM r WHERE i % greatest(n // 150, 1) = 0"""),
    "sample_n": (
        lambda s, d: N.sample_n(vessel(s, d), 500).select("rid", "vessel_id"), f"{V} SELECT rid, vessel_id FROM v ORDER BY md5(rid || ':42') LIMIT 500"),
    "winsorize": (
        lambda s, d: rounded(N.winsorize(vessel(s, d), ["vessel_id"], ["Main_Engine_Power_kW", "GPSSpeed_kn"], 0.01, 0.99).select("rid", "Main_Engine_Power_kW", "GPSSpeed_kn")),
        f"""{V}, q AS (SELECT vessel_id, {', '.join(f'quantile_cont({c}, .01) AS {c}_a, quantile_cont({c}, .99) AS {c}_b' for c in ('Main_Engine_Power_kW', 'GPSSpeed_kn'))} FROM v GROUP BY 1)
        SELECT rid, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN round_even(least(greatest({c}, {c}_a), {c}_b), 6) END AS {c}' for c in ('Main_Engine_Power_kW', 'GPSSpeed_kn'))} FROM v JOIN q USING (vessel_id)"""),
    "period_keys": (
        lambda s, d: vessel(s, d).select("rid", X.day_key("Date").alias("obs_day"), X.month_key("Date").alias("month"), X.iso_week_key("Date").alias("iso_week"),
                                         X.week_span_key("Date").alias("week_span")),
        f"""{V} SELECT rid, strftime(Date, '%Y-%m-%d') AS obs_day, strftime(Date, '%Y-%m') AS month, strftime(Date, '%G-W%V') AS iso_week,
        strftime(date_trunc('week', Date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', Date) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_span FROM v"""),
    "sort_by_time": (
        lambda s, d: jobs.sort_by_time(vessel(s, d)).select("rid", "Date"), f"{V} SELECT rid, Date FROM v ORDER BY Date, rid"),
    "load_and_clean": (
        lambda s, d: jobs.load_and_clean(s, raw_folder(s, d)).select(
            "rid", F.col("raw_id").cast("bigint").alias("raw_id"), "flag_negative_power", "flag_extreme_trim", "flag_invalid_draft", "flag_any_constraint", "is_moving"),
        f"""{RAWED} SELECT {ORDERED.format('raw_id')}, raw_id, coalesce(Main_Engine_Power_kW < 0, false) AS flag_negative_power, coalesce(abs(Trim_m) > 5, false) AS flag_extreme_trim,
        coalesce(Avg_draft_m <= 0, false) AS flag_invalid_draft, coalesce(Main_Engine_Power_kW < 0, false) OR coalesce(abs(Trim_m) > 5, false)
        OR coalesce(Avg_draft_m <= 0, false) AS flag_any_constraint, coalesce(GPSSpeed_kn > 0.5, false) AS is_moving FROM r"""),
}


def _half_degrees(s, d):
    return vessel(s, d).withColumns({c: F.when(F.col("vessel_id") < "m", F.degrees(c)).otherwise(F.col(c)) for c in ("GPS_LAT", "GPS_LON")})
