"""Result-store, stage-table, streaming and whole-job queries."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from keelson import config as cfg
from keelson.operators import classify as C
from keelson.operators import flags as L
from keelson.operators import profile as P
from keelson.operators.svd import ClusteredSVD
from keelson.plans import jobs
from keelson.sources import files, store as st
from keelson.streaming import live

from .base import FEATURES, FLAG_SQL, INTERVAL, V, VS, VESSEL_SELECT, _split, rounded, scored, scratch, table, vessel
from .detect import ASSIGN, CENTRES, CF, _names
from .profiles import UN
from .rules import CL, _checks
from .sources import LOADED, RAWED, raw_folder


def filled(s, d, reviews=False):
    """A store holding the classified anomalies and the incomplete rows of the bound data."""
    store = st.ResultStore(s, scratch(s)).create()
    rows = C.classify_anomalies(scored(s, d))
    store.append_anomalies(rows.where("is_anomaly"), 50.0, "bound_v1")
    if reviews:
        ids = store.read("anomalies").where("anomaly_type = 'extreme_trim'").select("id")
        store.mark_reviewed(ids, "seen")
        store.mark_reviewed(ids)
    return store


def missing_store(s, d):
    store = st.ResultStore(s, scratch(s)).create()
    store.append_missing_records(L.split_complete_cases(vessel(s, d), FEATURES)[1], FEATURES)
    return store


def runs_store(s, d):
    """One run per vessel, counted from the data."""
    store = st.ResultStore(s, scratch(s)).create()
    counts = scored(s, d).groupBy("vessel_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_anomaly").cast("bigint")).alias("a"))
    for r in counts.orderBy("vessel_id").collect():
        store.append_detection_run("v1", r["vessel_id"], r["n"], r["a"], 0.5, 3, 95.0)
    return store


T3 = """array_to_string(list_filter([CASE WHEN Main_Engine_Power_kW < 0 THEN 'negative_power' END, CASE WHEN abs(Trim_m) > 5 THEN 'extreme_trim' END,
 CASE WHEN Avg_draft_m <= 0 THEN 'invalid_draft' END], lambda x: x IS NOT NULL), ',')"""
AN = f"{VS}, an AS (SELECT *, coalesce(nullif({T3}, ''), 'multivariate_outlier') AS anomaly_type FROM a WHERE is_anomaly)"
MR = f"""{V}, mr AS (SELECT *, {' || '.join(f"CASE WHEN {c} IS NULL THEN '{c},' ELSE '' END" for c in FEATURES)} AS mc FROM v
 WHERE {' OR '.join(f'{c} IS NULL' for c in FEATURES)})"""
STORED = ["data_timestamp", "anomaly_score", "anomaly_type", "GPSSpeed_kn", "Main_Engine_Power_kW", "Trim_m", "reviewed", "notes"]
STORED_SQL = """Date AS data_timestamp, round_even(anomaly_score, 6) AS anomaly_score, anomaly_type, round_even(GPSSpeed_kn, 6) AS GPSSpeed_kn,
 round_even(Main_Engine_Power_kW, 6) AS Main_Engine_Power_kW, Trim_m"""
NEW = f"{STORED_SQL}, 0 AS reviewed, CAST(NULL AS VARCHAR) AS notes"


def _reopened(s, d):
    """Stage tables: written, found again, and the classified-or-annotated fallback on the annotated one."""
    root = scratch(s)
    scored(s, d).write.parquet(f"{root}/annotated")
    again = st.stage_or(s, f"{root}/annotated", lambda: scored(s, d))
    back = st.classified_or_annotated(s, f"{root}/classified", f"{root}/annotated")
    return back.join(again.select("rid", F.col("vessel_id").alias("stage_vessel")), "rid").select("rid", "stage_vessel", "is_anomaly", "primary_type")


def _exported(s, d):
    root = scratch(s)
    st.export_labelled(scored(s, d), root)
    a, f = (s.read.parquet(f"{root}/{n}").groupBy("vessel_id").agg(F.count(F.lit(1)).alias(n)) for n in ("all_anomalies", "full_dataset_with_labels"))
    return f.join(a, "vessel_id")


def _csv_back(s, d):
    path = scratch(s)
    st.write_csv(L.constraint_violation_report(vessel(s, d)), path)
    return s.read.option("header", True).schema("vessel_id string, check string, count bigint, pct double").csv(path)


def _json_back(s, d):
    from .detect import FIXED
    path = scratch(s)
    used = FIXED.assign(vessel(s, d)).where("cluster_id IS NOT NULL").select("cluster_id").distinct()
    st.write_names_json(FIXED.centre_table(s).join(used, "cluster_id", "left_semi"), path)
    return s.read.schema("cluster_id int, name string").json(path)


def _reports_back(s, d):
    path = scratch(s)
    P.summary_stats(vessel(s, d)).write.parquet(path)
    return s.read.parquet(path).select("vessel_id", "signal", "count", "mean")


def _stage_tables(s, d):
    """One Parquet table per stage, each read back by the next."""
    root = scratch(s)
    scored(s, d).write.parquet(f"{root}/annotated")
    C.classify_anomalies(s.read.parquet(f"{root}/annotated")).write.parquet(f"{root}/classified")
    return s.read.parquet(f"{root}/classified").groupBy("vessel_id", "primary_type").agg(F.count(F.lit(1)).alias("n"))


def _orderings(s, d):
    """Places of the types by count and by median score, from the two sorted reports."""
    rows = C.classify_anomalies(scored(s, d))
    both = C.type_breakdown(rows).join(C.score_by_type(rows), ["vessel_id", "primary_type"])
    place = lambda c: F.row_number().over(Window.partitionBy("vessel_id").orderBy(F.desc(c), "primary_type"))
    return both.select("vessel_id", "primary_type", place("count").alias("by_count"), place("median").alias("by_median"))


def _ddl(s, d):
    store = filled(s, d)
    store.clear_anomalies(confirm=True)
    left = store.read("anomalies").agg(F.count(F.lit(1)).alias("n"))
    return left.crossJoin(table(s, d, "events").agg(F.countDistinct("event_type").alias("vessels")))


def _report(s, d):
    store = filled(s, d)
    store.append_detection_run("v1", "events", 1, 1, 0.5, 3, 95.0)
    return st.run_report(scored(s, d), store).where("section <> 'runs' AND key NOT IN ('first_date', 'last_date')")


def _cleared(s, d):
    """Anomalies before and after clearing, the reviews left, and the first id that is given out afterwards."""
    store = filled(s, d, reviews=True)
    before = store.read("anomalies").count()
    store.clear_anomalies(confirm=True)
    store.append_anomalies(C.classify_anomalies(scored(s, d)).where("is_anomaly").limit(1), 50.0)
    after = store.read("anomalies").agg(F.min("id").alias("next_id"), (F.count(F.lit(1)) - 1).alias("after"))
    return after.select(F.lit(before).cast("bigint").alias("before"), "after", F.lit(store.read("reviews").count()).cast("bigint").alias("reviews"), "next_id")


def _stream(s, d, columns=()):
    """The events file as a stream, in the vessel projection."""
    raw = table(s, d, "events")
    source = s.readStream.schema(raw.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return source.selectExpr(*[p.strip() for p in _split(VESSEL_SELECT)], *columns)


def _drained(s, stream, schema=None):
    root = scratch(s)
    live.run_available(stream, f"{root}/out", f"{root}/progress")
    return s.read.parquet(f"{root}/out")


def _stream_score(s, d):
    features = ["GPSSpeed_kn", "Avg_draft_m", "Trim_m"]
    model = ClusteredSVD.fit(vessel(s, d), features, n_components=2)
    root = scratch(s)
    model.save(s, root)
    loaded = ClusteredSVD.load(s, root, 2)
    live_rows = _drained(s, live.stream_score(_stream(s, d), loaded)).select("rid", "flag_any_constraint", "score_svd", "is_svd_anomaly")
    batch = loaded.transform(L.constraint_flags(vessel(s, d))).select("rid", F.col("score_svd").alias("b"))
    same = (F.abs(F.col("score_svd") - F.col("b")) < 1e-12) | (F.col("score_svd").isNull() & F.col("b").isNull())
    return live_rows.join(batch, "rid").select("rid", "flag_any_constraint", same.alias("equals_batch"))


_RUNS: dict = {}


def _done(s, d, *stages):
    """The one run of all stages over the bound data, with the default parameters and every method; the queries on its stages
    share it, so each stage runs once in a session."""
    run, done = _RUNS.setdefault((s.sparkContext.applicationId, d), (jobs.RunConfig(raw_folder(s, d), scratch(s)), set()))
    for stage in stages:
        if stage not in done:
            jobs.run_all(s, replace(run, only_stage=stage))
            done.add(stage)
    return run


def _stage(name, *stages):
    return lambda s, d: s.read.parquet(_done(s, d, *stages).folder(name))


def _saved_anomalies(s, d):
    return rounded(st.ResultStore(s, _done(s, d, "03", "05", "06", "07").store_root()).anomaly_summary())


def _staged_run(s, d):
    """The report that the last of the seven stages writes."""
    run = _done(s, d, "01", "02", "03", "04", "05", "06", "07")
    return s.read.text(run.folder("report")).select(F.split("value", "\t").alias("p")).select(
        *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("section", "key", "value"))])


def _eda_run(s, d):
    """All reports of the exploratory run, row by row as JSON."""
    folder, fs = files.file_system(s, f"{_done(s, d, '01').folder('eda')}/stenaline")
    names = sorted(status.getPath().getName() for status in fs.listStatus(folder))
    reports = [s.read.parquet(f"{folder.toString()}/{n}").select(F.lit(n).alias("report"), F.to_json(F.struct("*")).alias("row"))
               for n in names if n != "normalised"]
    return reduce(DataFrame.unionByName, reports)


CLEANED = [c for c in cfg.STENALINE.feature_cols if c in LOADED]
CLEAN_SQL = f"""{RAWED}, f AS (SELECT *, {' AND '.join(f'{c} IS NOT NULL' for c in CLEANED)} AS ok, coalesce(Main_Engine_Power_kW < 0, false) AS flag_negative_power,
 coalesce(abs(Trim_m) > 5, false) AS flag_extreme_trim, coalesce(Avg_draft_m <= 0, false) AS flag_invalid_draft FROM r),
 w AS (SELECT 'stenaline' AS vessel_id, count(*) AS total_records, count(*) FILTER (ok) AS valid_records, count(*) FILTER (NOT ok) AS missing_records,
 CAST({len(CLEANED)} AS BIGINT) AS n_features, count(*) FILTER (ok AND flag_negative_power) AS flag_negative_power,
 count(*) FILTER (ok AND flag_extreme_trim) AS flag_extreme_trim, count(*) FILTER (ok AND flag_invalid_draft) AS flag_invalid_draft,
 count(*) FILTER (ok AND (flag_negative_power OR flag_extreme_trim OR flag_invalid_draft)) AS flag_any_constraint FROM f)
 UNPIVOT w ON COLUMNS(* EXCLUDE (vessel_id)) INTO NAME metric VALUE value"""


QUERIES = {
    "append_anomalies": (
        lambda s, d: rounded(filled(s, d).read("anomalies").select(*STORED)), f"{AN} SELECT {NEW} FROM an"),
    "append_missing_records": (
        lambda s, d: rounded(missing_store(s, d).read("missing_records").select("data_timestamp", "reason", "missing_columns", "source_file", "GPSSpeed_kn", "DRAFTFWD")),
        f"""{MR} SELECT Date AS data_timestamp, 'missing_feature_data' AS reason, rtrim(mc, ',') AS missing_columns, source_file, round_even(GPSSpeed_kn, 6) AS GPSSpeed_kn,
        DRAFTFWD FROM mr"""),
    "append_detection_run": (
        lambda s, d: runs_store(s, d).read("detection_runs").select("id", "model_version", "data_file", "total_records", "anomalies_detected", "threshold", "n_components", "threshold_percentile"),
        f"""{VS} SELECT row_number() OVER (ORDER BY vessel_id) AS id, 'v1' AS model_version, vessel_id AS data_file, count(*) AS total_records,
        count(*) FILTER (is_anomaly) AS anomalies_detected, 0.5e0 AS threshold, 3 AS n_components, 95e0 AS threshold_percentile FROM a GROUP BY vessel_id"""),
    "run_history": (
        lambda s, d: runs_store(s, d).run_history(3).select("data_file", "total_records"),
        f"{V} SELECT vessel_id AS data_file, count(*) AS total_records FROM v GROUP BY 1 ORDER BY 1 DESC LIMIT 3"),
    "result_table_ddl": (_ddl, "SELECT CAST(0 AS BIGINT) AS n, count(DISTINCT event_type) AS vessels FROM events"),
    "anomaly_summary": (
        lambda s, d: rounded(filled(s, d, True).anomaly_summary(), avg_score=9),
        f"""{AN} SELECT anomaly_type, count(*) AS count, round_even(avg(anomaly_score), 9) AS avg_score, round_even(min(anomaly_score), 6) AS min_score,
        round_even(max(anomaly_score), 6) AS max_score, min(Date) AS first_seen, max(Date) AS last_seen,
        CAST(sum((anomaly_type = 'extreme_trim')::INT) AS BIGINT) AS reviewed_count FROM an GROUP BY 1"""),
    "missing_records_summary": (
        lambda s, d: missing_store(s, d).missing_records_summary(),
        f"""{MR} SELECT 'missing_feature_data' AS reason, rtrim(mc, ',') AS missing_columns, count(*) AS count, min(Date) AS first_seen, max(Date) AS last_seen FROM mr GROUP BY 1, 2"""),
    "missing_records_list": (
        lambda s, d: missing_store(s, d).missing_records().select("data_timestamp", "missing_columns"),
        f"{MR} SELECT Date AS data_timestamp, rtrim(mc, ',') AS missing_columns FROM mr ORDER BY Date"),
    "top_anomalies": (
        lambda s, d: rounded(filled(s, d).top_anomalies(100).select(*STORED)), f"{AN} SELECT {NEW} FROM an ORDER BY an.anomaly_score DESC, Date LIMIT 100"),
    "unreviewed_queue": (
        lambda s, d: rounded(filled(s, d, True).unreviewed(50).select(*STORED)),
        f"{AN} SELECT {NEW} FROM an WHERE anomaly_type <> 'extreme_trim' ORDER BY an.anomaly_score DESC, Date LIMIT 50"),
    "mark_reviewed": (
        lambda s, d: rounded(filled(s, d, True).anomalies().select(*STORED)),
        f"""{AN} SELECT {STORED_SQL}, CAST(anomaly_type = 'extreme_trim' AS INT) AS reviewed, CASE WHEN anomaly_type = 'extreme_trim' THEN 'seen' END AS notes FROM an"""),
    "clear_anomalies": (
        _cleared, f"{AN} SELECT count(*) AS before, CAST(0 AS BIGINT) AS after, CAST(0 AS BIGINT) AS reviews, count(*) + 1 AS next_id FROM an"),
    "cluster_report_counts": (
        lambda s, d: rounded(filled(s, d).cluster_counts(), 9),
        f"{AN} SELECT cluster_name, count(*) AS n, round_even(avg(anomaly_score), 9) AS avg_score FROM an GROUP BY 1"),
    "documented_exports": (
        lambda s, d: rounded(filled(s, d).of_type("negative_power").select("data_timestamp", "anomaly_type", "anomaly_score")),
        f"{AN} SELECT Date AS data_timestamp, anomaly_type, round_even(anomaly_score, 6) AS anomaly_score FROM an WHERE Main_Engine_Power_kW < 0"),
    "stage_input_fallback": (
        _reopened, f"""{VS} SELECT rid, vessel_id AS stage_vessel, is_anomaly, CASE WHEN is_anomaly THEN 'multivariate_outlier' ELSE 'normal' END AS primary_type FROM a"""),
    "full_labelled_export": (
        _exported, f"{VS} SELECT vessel_id, count(*) AS full_dataset_with_labels, count(*) FILTER (is_anomaly) AS all_anomalies FROM a GROUP BY 1"),
    "csv_report_sinks": (_csv_back, f"{V} {_checks()}"),
    "json_sink": (
        _json_back, f"""{ASSIGN}, c AS (SELECT * FROM (VALUES {', '.join(f"({k}, {', '.join(f'{x}::DOUBLE' for x in c)})" for k, c in enumerate(CENTRES))}) t(cluster_id, {', '.join(CF)}))
        SELECT cluster_id, {_names(3, 'AND Main_Engine_Power_kW < 500')} AS name FROM c WHERE cluster_id IN (SELECT cluster_id FROM asg)"""),
    "reload_cached_reports": (
        _reports_back, f"""{UN} SELECT vessel_id, signal, count(*) AS count, round_even(avg(value), 4) AS mean FROM l WHERE signal <> 'RelWindAngle_deg' GROUP BY 1, 2"""),
    "stage_tables": (
        _stage_tables, f"{CL} SELECT vessel_id, primary_type, count(*) AS n FROM c GROUP BY 1, 2"),
    "report_orderings": (
        _orderings, f"""{CL}, t AS (SELECT vessel_id, primary_type, count(*) AS n, quantile_cont(anomaly_score, .5) AS m FROM c WHERE is_anomaly GROUP BY 1, 2)
        SELECT vessel_id, primary_type, row_number() OVER (PARTITION BY vessel_id ORDER BY n DESC, primary_type) AS by_count,
        row_number() OVER (PARTITION BY vessel_id ORDER BY m DESC, primary_type) AS by_median FROM t"""),
    "run_report": (
        _report, f"""{AN}, n AS (SELECT count(*) AS n, count(*) FILTER (is_anomaly) AS h FROM a)
        SELECT 'totals' AS section, 'total_records' AS key, CAST(n AS VARCHAR) AS value FROM n UNION ALL SELECT 'totals', 'total_anomalies', CAST(h AS VARCHAR) FROM n
        UNION ALL SELECT 'totals', 'anomaly_rate_pct', CAST(round_even(h/n*100, 2) AS VARCHAR) FROM n
        UNION ALL SELECT 'types', anomaly_type, CAST(count(*) AS VARCHAR) FROM an GROUP BY 2
        UNION ALL SELECT 'clusters', cluster_name, CAST(count(*) AS VARCHAR) FROM an GROUP BY 2"""),
    "cleaning_report": (
        lambda s, d: P.cleaning_report(L.constraint_flags(vessel(s, d)), FEATURES),
        f"""WITH f AS (SELECT *, {FLAG_SQL}, {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} AS ok FROM ({V} SELECT * FROM v)),
        w AS (SELECT vessel_id, count(*) AS total_records, count(*) FILTER (ok) AS valid_records, count(*) FILTER (NOT ok) AS missing_records,
        CAST({len(FEATURES)} AS BIGINT) AS n_features, {', '.join(f'count(*) FILTER (ok AND {c}) AS {c}' for c in ('flag_negative_power', 'flag_extreme_trim', 'flag_invalid_draft', 'flag_any_constraint'))}
        FROM f GROUP BY 1) UNPIVOT w ON COLUMNS(* EXCLUDE (vessel_id)) INTO NAME metric VALUE value"""),
    "stream_score": (_stream_score, f"{V} SELECT rid, flag_any_constraint, true AS equals_batch FROM (SELECT rid, {FLAG_SQL} FROM v)"),
    "stream_rolling_rate": (
        lambda s, d: rounded(_drained(s, live.stream_rolling_rate(_stream(s, d, ["value > 90e0 AS is_anomaly"])))),
        f"""WITH e AS (SELECT event_type AS vessel_id, ts, value > 90 AS hit FROM events), w AS (SELECT vessel_id, hit,
          unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 55 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts), INTERVAL 5 MINUTE)) AS window_start FROM e)
        SELECT vessel_id, window_start, window_start + INTERVAL 1 HOUR AS window_end, count(*) AS n, round_even(avg(hit::INT)*100, 6) AS rate_pct FROM w
        GROUP BY 1, 2 HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e)"""),
    "stream_gap_alert": (
        lambda s, d: _drained(s, live.stream_gap_alert(_stream(s, d), INTERVAL)),
        f"""WITH e AS (SELECT event_type AS vessel_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts)/1e6 <= {10 * INTERVAL} THEN 0 ELSE 1 END AS brk FROM events
          WINDOW w AS (PARTITION BY event_type ORDER BY ts)), r AS (SELECT *, sum(brk) OVER (PARTITION BY vessel_id ORDER BY ts) AS g FROM e),
        g AS (SELECT vessel_id, min(ts) AS a, max(ts) AS z, count(*) AS n FROM r GROUP BY vessel_id, g),
        h AS (SELECT *, lead(a) OVER (PARTITION BY vessel_id ORDER BY a) AS again, (SELECT max(ts) - INTERVAL 10 MINUTE FROM events) AS passed FROM g)
        SELECT vessel_id, a AS active_from, z AS gap_start, n AS n_records, 'silent' AS status, CAST(NULL AS TIMESTAMP) AS gap_end FROM h
        WHERE z + INTERVAL {10 * INTERVAL} SECOND + INTERVAL 1 MICROSECOND <= passed
        UNION ALL SELECT vessel_id, NULL, z, NULL, 'resumed', again FROM h WHERE again <= passed"""),
    "stage_clean": (_stage("cleaning_report", "03"), CLEAN_SQL),
    "stage_cluster": (_stage("cluster_summary", "03", "04"), None),
    "stage_detect": (_stage("detection_summary", "03", "05"), None),
    "stage_classify": (_stage("type_breakdown", "03", "05", "06"), None),
    "stage_save": (_saved_anomalies, None),
    "eda_run": (_eda_run, None),
    "staged_run": (_staged_run, None),
}
