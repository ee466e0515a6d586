"""Flag, metadata-rule and classification queries."""

from pyspark.sql import functions as F

from keelson import config as cfg
from keelson.operators import classify as C
from keelson.operators import flags as L
from keelson.operators import metadata as D
from keelson.operators import profile as P
from keelson.operators import windows as W

from .base import FEATURES, FLAG_SQL, SIGNALS, STEP, V, VS, rounded, scored, scratch, unpivot_sql, vessel
from .profiles import UN, PROFILE_ROWS, _values, box_sql, q, re, roc_sql

MS = ["Main_Engine_Power_kW", "DRAFTAFT", "DRAFTFWD", "GPSSpeed_kn", "Avg_draft_m"]


def _fuelled(s, d):
    """Vessel rows with a fuel rate for the envelope check."""
    return vessel(s, d).withColumn("Fuel_Consumption_rate", F.col("GPSSpeed_kn") * 60)


def _limit_rows(cols):
    lim = cfg.physical_limits()
    return " UNION ALL ".join(
        f"SELECT vessel_id, '{c}' AS signal, count(*) FILTER ({f'{c} < {lim[c][0]}' if c in lim else 'false'}) AS n_below, "
        f"count(*) FILTER ({f'{c} > {lim[c][1]}' if c in lim else 'false'}) AS n_above FROM v GROUP BY 1" for c in cols)


def _checks():
    parts = []
    for label, (sql, _) in cfg.CONSTRAINT_CHECKS.items():
        parts.append(f"""SELECT vessel_id, '{label}' AS "check", count(*) FILTER ({sql}) AS count,
        round_even(count(*) FILTER ({sql}) / count(*) * 100, 4) AS pct FROM v GROUP BY 1""")
    return " UNION ALL ".join(parts)


TYPES = """list_filter([CASE WHEN Main_Engine_Power_kW < 0 THEN 'negative_power' END, CASE WHEN abs(Trim_m) > 5 THEN 'extreme_trim' END,
 CASE WHEN Avg_draft_m <= 0 THEN 'invalid_draft' END, CASE WHEN GPSSpeed_kn > 8 AND Main_Engine_Power_kW < 200 THEN 'high_speed_low_power' END,
 CASE WHEN GPSSpeed_kn < 1 AND Main_Engine_Power_kW > 500 THEN 'low_speed_high_power' END,
 CASE WHEN Main_Engine_Power_kW > 0 AND Fuel_Consumption_t_per_day > 0 AND (Main_Engine_Power_kW/Fuel_Consumption_t_per_day > 200
   OR Main_Engine_Power_kW/Fuel_Consumption_t_per_day < 5) THEN 'fuel_efficiency_outlier' END], lambda x: x IS NOT NULL)"""
CL = f"""{VS}, ty AS (SELECT *, {TYPES} AS tl FROM a),
c AS MATERIALIZED (SELECT *, CASE WHEN NOT is_anomaly THEN 'normal' WHEN len(tl) = 0 THEN 'multivariate_outlier' ELSE array_to_string(tl, ',') END AS anomaly_type,
  CASE WHEN NOT is_anomaly THEN 'normal' WHEN len(tl) = 0 THEN 'multivariate_outlier' ELSE tl[1] END AS primary_type FROM ty)"""
STEPS = f"""{UN}, {roc_sql('rid')},
  ch AS (SELECT *, CASE WHEN round_even(value, 4) = round_even(pv, 4) THEN 0 ELSE 1 END AS chg FROM rc),
  ru AS (SELECT *, sum(chg) OVER (PARTITION BY vessel_id, signal ORDER BY rid) AS run FROM ch)"""
ROC = """, rq AS (SELECT vessel_id, signal, quantile_cont(abs(roc), 0.5) AS p50, quantile_cont(abs(roc), 0.99) AS p99 FROM rc GROUP BY 1, 2)"""
FROZEN = """, fz0 AS (SELECT vessel_id, signal, run, count(*) AS n, date_diff('microsecond', arg_min(Date, pos), arg_max(Date, pos))/1e6 AS dur
   FROM ru GROUP BY 1, 2, 3),
 fz AS (SELECT vessel_id, signal, CAST(coalesce(sum(n) FILTER (dur >= 1200), 0) AS BIGINT) AS n_frozen FROM fz0 GROUP BY 1, 2)"""
SPIKES = """, sp AS (SELECT vessel_id, signal, count(*) FILTER (dv = 0) AS n_dup, count(*) FILTER (p99 > 0 AND abs(roc) > 3*p99) AS n_spikes
   FROM rc LEFT JOIN rq USING (vessel_id, signal) GROUP BY 1, 2)"""
DYN = """, rg AS (SELECT vessel_id, signal, max(value) - min(value) AS rng FROM l GROUP BY 1, 2),
 dy AS (SELECT vessel_id, signal, coalesce(p50, 0) AS roc_p50, CASE WHEN coalesce(p50, 0)/(rng + 1e-12) < 1e-4 THEN 'stable' ELSE 'dynamic' END AS dynamics
   FROM rg LEFT JOIN rq USING (vessel_id, signal))"""
NORMAL = f""", mv AS (SELECT l.*, GPSSpeed_kn > 0.5 AS moving FROM l JOIN v USING (vessel_id, rid)),
 nr AS (SELECT vessel_id, signal, count(*) FILTER (moving) AS nm, CASE WHEN signal <> 'GPSSpeed_kn' AND count(*) FILTER (moving) > 100
   THEN quantile_cont(value, 0.1) FILTER (moving) ELSE quantile_cont(value, 0.1) END AS lo,
   CASE WHEN signal <> 'GPSSpeed_kn' AND count(*) FILTER (moving) > 100 THEN quantile_cont(value, 0.9) FILTER (moving)
   ELSE quantile_cont(value, 0.9) END AS hi FROM mv GROUP BY 1, 2)"""
BIMODAL = """, md AS (SELECT vessel_id, signal, quantile_cont(value, 0.5) AS m FROM l GROUP BY 1, 2),
 bm AS (SELECT vessel_id, signal, count(*) >= 100 AND any_value(m) >= 0.5 AND count(*) FILTER (value < m*0.05)/count(*) > 0.10
   AND count(*) FILTER (value > m*0.5)/count(*) > 0.20 AS bimodal FROM l JOIN md USING (vessel_id, signal) GROUP BY 1, 2)"""
SEASON = """, mo AS (SELECT vessel_id, signal, strftime(Date, '%Y-%m') AS m, avg(value) AS a, sum(value) AS s, count(*) AS n FROM l GROUP BY 1, 2, 3),
 sn AS (SELECT vessel_id, signal, coalesce(sum(n) >= 500 AND count(*) >= 2 AND (max(a) - min(a))/nullif(abs(sum(s)/sum(n)), 0) > 0.20, false) AS seasonal
   FROM mo GROUP BY 1, 2)"""
NEG = {p[0]: p[5] for p in cfg.SIGNAL_PROFILES} | {"Fuel_Consumption_t_per_day": True}
ROLE = {r[0]: (r[1], r[2]) for r in cfg.SIGNAL_ROLES}
META_ROWS = [(s, g, label, unit, lo, hi, bool(NEG.get(s, False)), ROLE[s][0], ROLE[s][1], s in cfg.ZERO_MEANS_IDLE)
             for s, g, label, unit, lo, hi in PROFILE_ROWS]
META = f"""{STEPS}{ROC}{FROZEN}{SPIKES}{DYN}{NORMAL}{BIMODAL}{SEASON},
 pm AS (SELECT * FROM (VALUES {_values(META_ROWS)}) t(signal, feature_group, label, unit, lo, hi, neg, descr, notes, idle)),
 tot AS (SELECT vessel_id, count(*) AS nt FROM v GROUP BY 1),
 gp AS (SELECT vessel_id, max(d) AS g FROM (SELECT vessel_id, date_diff('microsecond', lag(Date) OVER (PARTITION BY vessel_id ORDER BY rid), Date)/1e6 AS d FROM v) GROUP BY 1),
 b AS (SELECT vessel_id, signal, count(*) AS nv, min(value) AS mn, max(value) AS mx,
   count(*) FILTER (value < lo) + count(*) FILTER (value > hi) AS nviol FROM l JOIN pm USING (signal) GROUP BY 1, 2),
 m AS (SELECT vessel_id, signal AS variable_name, feature_group, signal AS raw_column_name, unit, descr AS column_description,
   CASE WHEN lo IS NOT NULL THEN CAST(lo AS VARCHAR) || ' – ' || CAST(hi AS VARCHAR) ELSE '' END AS physical_limits,
   'Q10=' || CAST(round_even(nr.lo_, 4) AS VARCHAR) || ',  Q90=' || CAST(round_even(nr.hi_, 4) AS VARCHAR) AS normal_operating_range,
   dynamics AS stable_or_highly_dynamic, round_even(mn, 4) AS observed_min, round_even(mx, 4) AS observed_max,
   round_even((nt - nv)/nt*100, 3) AS pct_missing, nt - nv AS n_missing, n_dup AS n_consecutive_duplicates, n_spikes, n_frozen AS n_frozen_periods,
   (unit = 'm' AND mx > 100) OR (unit = 'kn' AND mx > 80) AS suspicious_unit_flag, seasonal AS seasonal_effects,
   coalesce(nullif(concat_ws('; ', CASE WHEN neg THEN 'remove_negative' END, CASE WHEN hi IS NOT NULL THEN 'remove_gt_' || CAST(hi AS VARCHAR) END,
     CASE WHEN lo IS NOT NULL AND lo <> 0 THEN 'remove_lt_' || CAST(lo AS VARCHAR) END), ''), 'none') AS hard_filter,
   coalesce(nullif(concat_ws('; ', CASE WHEN nviol > 0 THEN nviol || '_phys_violations' END, CASE WHEN n_spikes > 0 THEN n_spikes || '_rate_spikes' END,
     CASE WHEN n_frozen > 0 THEN 'frozen_periods_detected' END), ''), 'none') AS soft_warning,
   dynamics = 'stable' AND (nt - nv)/nt < 0.05 AND CASE WHEN nt > nv THEN g ELSE 0 END <= 600 AS interpolation_allowed,
   n_frozen > 0 AS remove_repeated_values, idle AS treat_low_values_as_idle, notes, bimodal
  FROM b JOIN pm USING (signal) JOIN tot USING (vessel_id) JOIN gp USING (vessel_id) JOIN sp USING (vessel_id, signal) JOIN fz USING (vessel_id, signal)
  JOIN dy USING (vessel_id, signal) JOIN (SELECT vessel_id, signal, lo AS lo_, hi AS hi_ FROM nr) nr USING (vessel_id, signal)
  JOIN bm USING (vessel_id, signal) JOIN sn USING (vessel_id, signal) WHERE nv >= 10)"""


def _steps(s, d):
    return W.signal_steps(vessel(s, d), SIGNALS, order=("rid",), max_step_s=STEP)


def _metadata(s, d):
    return D.variable_metadata(vessel(s, d), SIGNALS, max_step_s=STEP)


TIGHT = cfg.VesselConfig("bound", "bound", physical_limits={
    "GPSSpeed_kn": (0.0, 20.0), "Main_Engine_Power_kW": (0.0, 5000.0), "DRAFTAFT": (5.5, 6.25), "DRAFTFWD": (None, 6.5),
    "Trim_m": (-5.0, None)})


def _patched(s, d):
    df = vessel(s, d)
    return D.metadata_patch(D.variable_metadata(df, SIGNALS, max_step_s=STEP),
                            P.univariate_report(df, SIGNALS, max_step_s=STEP), TIGHT)


QN = list(zip(P.QNAMES, P.PROBS))
def patch_sql(config):
    """The metadata patch for a vessel's limits; raw names equal signal names, so units stay."""
    return f"""{META}, un AS (SELECT vessel_id, signal AS variable_name, {', '.join(f'{re(q(p), 4)} AS {n}' for n, p in QN)},
  count(*) FILTER (value < 0) AS n_negative FROM l GROUP BY 1, 2 HAVING count(*) >= 20),
 lm AS (SELECT * FROM (VALUES {_values([(k, a, b, k in cfg.STRICTLY_NON_NEGATIVE) for k, (a, b) in config.physical_limits.items()])}) t(variable_name, lo, hi, strict)),
 j AS (SELECT m.*, lm.lo AS vlo, lm.hi AS vhi, coalesce(strict, false) AS strict, un.* EXCLUDE (vessel_id, variable_name), nt AS n_total FROM m JOIN tot USING (vessel_id)
  LEFT JOIN un USING (vessel_id, variable_name) LEFT JOIN lm USING (variable_name)),
 e AS (SELECT *, n_total - n_missing AS nvv,
   CASE WHEN observed_min < vlo THEN CASE WHEN vlo = 0 THEN n_negative WHEN q01 >= vlo THEN floor((n_total-n_missing)*0.01) WHEN q05 >= vlo THEN floor((n_total-n_missing)*0.05)
    WHEN q10 >= vlo THEN floor((n_total-n_missing)*0.10) WHEN q25 >= vlo THEN floor((n_total-n_missing)*0.25) WHEN q50 >= vlo THEN floor((n_total-n_missing)*0.50) ELSE 0 END ELSE 0 END
   + CASE WHEN observed_max > vhi THEN CASE WHEN q99 > vhi THEN floor((n_total-n_missing)*0.01) WHEN q95 > vhi THEN floor((n_total-n_missing)*0.05)
    WHEN q90 > vhi THEN floor((n_total-n_missing)*0.10) WHEN q75 > vhi THEN floor((n_total-n_missing)*0.25) ELSE floor((n_total-n_missing)*0.01) END ELSE 0 END AS nviol FROM j),
 n AS (SELECT *, CASE WHEN vlo IS NOT NULL AND vhi IS NOT NULL THEN CAST(vlo AS VARCHAR) || ' – ' || CAST(vhi AS VARCHAR) WHEN vlo IS NOT NULL THEN '>= ' || CAST(vlo AS VARCHAR)
    WHEN vhi IS NOT NULL THEN '<= ' || CAST(vhi AS VARCHAR) ELSE physical_limits END AS np,
   coalesce(nullif(concat_ws('; ', CASE WHEN strict AND vlo = 0 THEN 'remove_negative' END, CASE WHEN vhi IS NOT NULL THEN 'remove_gt_' || CAST(vhi AS VARCHAR) END,
     CASE WHEN vlo IS NOT NULL AND vlo <> 0 THEN 'remove_lt_' || CAST(vlo AS VARCHAR) END), ''), 'none') AS nh,
   coalesce(nullif(concat_ws('; ', CASE WHEN nviol > 0 THEN CAST(nviol AS BIGINT) || '_phys_violations' END,
     nullif(array_to_string(list_filter(list_transform(string_split(soft_warning, ';'), lambda p: trim(p)), lambda p: p NOT IN ('none', '') AND NOT contains(p, '_phys_violations')), '; '), '')), ''), 'none') AS nsw FROM e)
 SELECT vessel_id, variable_name, unit, np AS physical_limits, nh AS hard_filter, nsw AS soft_warning,
  (np <> physical_limits)::INT + (nh <> hard_filter)::INT + (nsw <> soft_warning)::INT AS n_changed FROM n"""


PATCH = patch_sql(TIGHT)
QUERIES = {
    "constraint_flags": (
        lambda s, d: L.constraint_flags(vessel(s, d)).select("rid", "vessel_id", "flag_negative_power", "flag_extreme_trim", "flag_invalid_draft", "flag_any_constraint"),
        f"{V} SELECT rid, vessel_id, {FLAG_SQL} FROM v"),
    "is_moving": (lambda s, d: L.is_moving(vessel(s, d)).select("rid", "is_moving"), f"{V} SELECT rid, coalesce(GPSSpeed_kn > 0.5, false) AS is_moving FROM v"),
    "split_complete_cases": (
        lambda s, d: _split_counts(s, d),
        f"""{V} SELECT vessel_id, CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} THEN 'complete' ELSE 'incomplete' END AS part,
        count(*) AS n, CAST(sum(rid) AS BIGINT) AS rid_sum FROM v GROUP BY 1, 2"""),
    "constraint_violation_report": (lambda s, d: L.constraint_violation_report(vessel(s, d)), f"{V} {_checks()}"),
    "missing_reason": (
        lambda s, d: L.missing_reason(_undated(s, d), FEATURES).select("rid", "reason", "missing_columns"),
        f"""WITH v AS (SELECT * REPLACE (CASE WHEN rid % 83 = 0 THEN NULL ELSE Date END AS Date) FROM ({V} SELECT * FROM v)),
        m AS (SELECT rid, Date, concat_ws(',', {', '.join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in FEATURES)}) AS n FROM v)
        SELECT rid, CASE WHEN n <> '' THEN 'missing_feature_data' WHEN Date IS NULL THEN 'missing_timestamp' ELSE 'invalid_record' END AS reason,
        nullif(n, '') AS missing_columns FROM m"""),
    "physical_limit_flags": (lambda s, d: L.physical_limit_flags(vessel(s, d), SIGNALS), f"{V} {_limit_rows(SIGNALS)}"),
    "fuel_power_envelope": (
        lambda s, d: L.fuel_power_envelope(_fuelled(s, d), cfg.STENALINE).select("rid", "outside_envelope"),
        f"""{V} SELECT rid, coalesce(Main_Engine_Power_kW < GPSSpeed_kn*60*4.3e0 - 4500 OR Main_Engine_Power_kW > GPSSpeed_kn*60*4.3e0 + 4000, false)
        AS outside_envelope FROM v"""),
    "select_anomalies": (lambda s, d: rounded(L.select_anomalies(scored(s, d)).select("rid", "vessel_id", "anomaly_score")),
                         f"{VS} SELECT rid, vessel_id, round_even(anomaly_score, 6) AS anomaly_score FROM a WHERE is_anomaly"),
    "power_speed_flags": (
        lambda s, d: rounded(L.power_speed_flags(vessel(s, d))),
        f"""{V} SELECT vessel_id, count(*) AS n_valid, count(*) FILTER (Main_Engine_Power_kW < 0) AS n_negative_power,
        count(*) FILTER (GPSSpeed_kn = 0 AND Main_Engine_Power_kW > 0) AS n_power_at_rest, round_even(max(Main_Engine_Power_kW), 6) AS max_power,
        round_even(max(GPSSpeed_kn), 6) AS max_speed FROM v WHERE Main_Engine_Power_kW IS NOT NULL AND GPSSpeed_kn IS NOT NULL GROUP BY 1"""),
    "high_power_low_speed": (
        lambda s, d: L.high_power_low_speed(vessel(s, d)),
        f"""{V}, r AS (SELECT * FROM v WHERE Main_Engine_Power_kW >= 0 AND GPSSpeed_kn >= 0), e AS (SELECT vessel_id,
        quantile_cont(Main_Engine_Power_kW, .75) AS p, quantile_cont(GPSSpeed_kn, .25) AS s FROM r GROUP BY 1)
        SELECT vessel_id, count(*) AS n_valid, count(*) FILTER (Main_Engine_Power_kW > p AND GPSSpeed_kn < s) AS n_high_power_low_speed
        FROM r JOIN e USING (vessel_id) GROUP BY 1"""),
    "spatial_valid_rows": (
        lambda s, d: rounded(L.spatial_valid_rows(vessel(s, d), "DRAFTAFT", "RelWindSpeed_kn").select("rid", "DRAFTAFT", "RelWindSpeed_kn")),
        f"{V} SELECT rid, DRAFTAFT, round_even(RelWindSpeed_kn, 6) AS RelWindSpeed_kn FROM v WHERE DRAFTAFT IS NOT NULL AND RelWindSpeed_kn IS NOT NULL"),
    "underway_filter": (
        lambda s, d: rounded(L.underway_range(vessel(s, d), SIGNALS), 4),
        f"{UN}{NORMAL} SELECT vessel_id, signal, nm AS n_moving, round_even(lo, 4) AS normal_lo, round_even(hi, 4) AS normal_hi FROM nr"),
    "normal_operating_range": (
        lambda s, d: rounded(L.underway_range(vessel(s, d), MS, at_least=1900), 4),
        f"""{UN}{NORMAL.replace('> 100', '> 1900')} SELECT vessel_id, signal, nm AS n_moving, round_even(lo, 4) AS normal_lo, round_even(hi, 4) AS normal_hi
        FROM nr WHERE signal IN ({', '.join(repr(x) for x in MS)})"""),
    "signal_dynamics": (
        lambda s, d: rounded(D.signal_dynamics(vessel(s, d), SIGNALS, max_step_s=STEP), 8),
        f"{STEPS}{ROC}{DYN} SELECT vessel_id, signal, round_even(roc_p50, 8) AS roc_p50, dynamics FROM dy"),
    "consecutive_duplicates": (
        lambda s, d: D.consecutive_duplicates(_steps(s, d)),
        f"{STEPS} SELECT vessel_id, signal, count(*) FILTER (dv = 0) AS n_consecutive_duplicates FROM rc GROUP BY 1, 2"),
    "frozen_points": (lambda s, d: D.frozen_points(_steps(s, d)), f"{STEPS}{FROZEN} SELECT * FROM fz"),
    "spike_count": (lambda s, d: D.spike_count(_steps(s, d)), f"{STEPS}{ROC}{SPIKES} SELECT vessel_id, signal, n_spikes FROM sp"),
    "bimodal_flag": (lambda s, d: D.bimodal_flag(vessel(s, d), SIGNALS), f"{UN}{BIMODAL} SELECT * FROM bm"),
    "seasonal_flag": (
        lambda s, d: D.seasonal_flag(_seasonal(s, d), MS),
        f"""WITH v AS MATERIALIZED (SELECT * REPLACE (Date + INTERVAL 15 DAY AS Date, CASE WHEN rid > 5000 THEN DRAFTAFT*2 ELSE DRAFTAFT END AS DRAFTAFT)
        FROM ({V} SELECT * FROM v)), l AS ({unpivot_sql(MS)}){SEASON} SELECT * FROM sn"""),
    "suspicious_unit_flag": (
        lambda s, d: _metadata_part(s, d, "suspicious_unit_flag", "observed_max", "unit"),
        f"{META} SELECT vessel_id, variable_name, suspicious_unit_flag, observed_max, unit FROM m"),
    "hard_filter_rule": (lambda s, d: _metadata_part(s, d, "hard_filter", "physical_limits"),
                         f"{META} SELECT vessel_id, variable_name, hard_filter, physical_limits FROM m"),
    "soft_warning_rule": (lambda s, d: _metadata_part(s, d, "soft_warning"), f"{META} SELECT vessel_id, variable_name, soft_warning FROM m"),
    "interpolation_allowed": (
        lambda s, d: _metadata_part(s, d, "interpolation_allowed", "pct_missing"),
        f"{META} SELECT vessel_id, variable_name, interpolation_allowed, pct_missing FROM m"),
    "remove_repeated": (
        lambda s, d: _metadata_part(s, d, "remove_repeated_values", "treat_low_values_as_idle"),
        f"{META} SELECT vessel_id, variable_name, remove_repeated_values, treat_low_values_as_idle FROM m"),
    "variable_metadata": (_metadata, f"{META} SELECT * FROM m"),
    "metadata_patch": (
        lambda s, d: _patched(s, d).select("vessel_id", "variable_name", "unit", "physical_limits", "hard_filter", "soft_warning", "n_changed"), PATCH),
    "estimate_violations": (
        lambda s, d: _patched(s, d).select("vessel_id", "variable_name", F.regexp_extract("soft_warning", r"(\d+)_phys", 1).alias("estimate")),
        f"SELECT vessel_id, variable_name, regexp_extract(soft_warning, '(\\d+)_phys', 1) AS estimate FROM ({PATCH})"),
    "metadata_patch_join": (
        lambda s, d: _patched(s, d).where("soft_warning <> 'none'").select("vessel_id", "variable_name", "soft_warning"),
        f"SELECT vessel_id, variable_name, soft_warning FROM ({PATCH}) WHERE soft_warning <> 'none'"),
    "metadata_refresh_modes": (
        lambda s, d: _refreshed(s, d),
        f"SELECT vessel_id, variable_name, physical_limits, hard_filter, soft_warning FROM ({patch_sql(cfg.STENALINE)})"),
    "apply_quality_rules": (
        lambda s, d: _quality(s, d),
        f"""{V} SELECT rid, CASE WHEN Main_Engine_Power_kW BETWEEN 0 AND 45000 THEN round_even(Main_Engine_Power_kW, 6) END AS Main_Engine_Power_kW,
        CASE WHEN DRAFTFWD BETWEEN 3 AND 10 THEN DRAFTFWD END AS DRAFTFWD FROM v"""),
    "classify_rules": (
        lambda s, d: C.classify_rules(vessel(s, d)).select("rid", F.concat_ws(",", "types").alias("types")),
        f"{V}, t AS (SELECT rid, {TYPES} AS tl FROM v) SELECT rid, CASE WHEN len(tl) = 0 THEN 'multivariate_outlier' ELSE array_to_string(tl, ',') END AS types FROM t"),
    "classify_anomalies": (
        lambda s, d: C.classify_anomalies(scored(s, d)).select("rid", "anomaly_type", "primary_type"),
        f"{CL} SELECT rid, anomaly_type, primary_type FROM c"),
    "db_type": (
        lambda s, d: _db_type(s, d),
        f"""{V}, t AS (SELECT rid, list_filter([CASE WHEN Main_Engine_Power_kW < 0 THEN 'negative_power' END, CASE WHEN abs(Trim_m) > 5 THEN 'extreme_trim' END,
        CASE WHEN Avg_draft_m <= 0 THEN 'invalid_draft' END], lambda x: x IS NOT NULL) AS tl FROM v)
        SELECT rid, CASE WHEN len(tl) = 0 THEN 'multivariate_outlier' ELSE array_to_string(tl, ',') END AS anomaly_type FROM t"""),
    "type_breakdown": (
        lambda s, d: rounded(C.type_breakdown(C.classify_anomalies(scored(s, d))), avg_score=9),
        f"""{CL} SELECT vessel_id, primary_type, count(*) AS count, round_even(avg(anomaly_score), 9) AS avg_score, round_even(max(anomaly_score), 6) AS max_score,
        round_even(count(*) / any_value(t) * 100, 2) AS pct FROM c JOIN (SELECT vessel_id, count(*) AS t FROM c WHERE is_anomaly GROUP BY 1) USING (vessel_id)
        WHERE is_anomaly GROUP BY 1, 2"""),
    "score_by_type": (
        lambda s, d: rounded(C.score_by_type(C.classify_anomalies(scored(s, d)))),
        f"{CL}, ca AS (SELECT * FROM c WHERE is_anomaly), {box_sql('ca', 'vessel_id, primary_type', 'anomaly_score')} SELECT * FROM bb"),
    "daily_type_pivot": (
        lambda s, d: C.daily_type_pivot(C.classify_anomalies(scored(s, d))),
        f"""{CL} SELECT vessel_id, strftime(Date, '%Y-%m-%d') AS obs_day, {', '.join(f"count(*) FILTER (primary_type = '{t}') AS {t}" for t in C.TYPES)}
        FROM c WHERE is_anomaly GROUP BY 1, 2"""),
    "anomaly_runs": (
        lambda s, d: W.anomaly_runs(scored(s, d)).drop("run_id"),
        f"""{VS}, r AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY vessel_id, is_anomaly ORDER BY Date, rid) AS g FROM a
        WINDOW w AS (PARTITION BY vessel_id ORDER BY Date, rid)) SELECT vessel_id, count(*) AS run_length, min(Date) AS run_start, max(Date) AS run_end
        FROM r WHERE is_anomaly GROUP BY vessel_id, g"""),
    "anomaly_run_histogram": (
        lambda s, d: W.run_length_histogram(W.anomaly_runs(scored(s, d)), longest=50),
        f"""{VS}, r AS (SELECT *, row_number() OVER w - row_number() OVER (PARTITION BY vessel_id, is_anomaly ORDER BY Date, rid) AS g FROM a
        WINDOW w AS (PARTITION BY vessel_id ORDER BY Date, rid)), n AS (SELECT vessel_id, count(*) AS run_length FROM r WHERE is_anomaly GROUP BY vessel_id, g)
        SELECT vessel_id, run_length, count(*) AS n_runs FROM n WHERE run_length <= 50 GROUP BY 1, 2"""),
    "rolling_rate_1h": (
        lambda s, d: rounded(W.rolling_rate(scored(s, d)).select("rid", "rolling_rate_pct")),
        f"""{VS} SELECT rid, round_even(avg(is_anomaly::INT) OVER (PARTITION BY vessel_id ORDER BY Date RANGE BETWEEN
        INTERVAL '59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW) * 100, 6) AS rolling_rate_pct FROM a"""),
}


def _split_counts(s, d):
    good, bad = L.split_complete_cases(vessel(s, d), FEATURES)
    both = good.withColumn("part", F.lit("complete")).unionByName(bad.withColumn("part", F.lit("incomplete")))
    return both.groupBy("vessel_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("rid").alias("rid_sum"))


def _undated(s, d):
    return vessel(s, d).withColumn("Date", F.when(F.col("rid") % 83 != 0, F.col("Date")))


def _seasonal(s, d):
    return vessel(s, d).withColumns({"Date": F.col("Date") + F.expr("INTERVAL 15 DAYS"),
                                     "DRAFTAFT": F.when(F.col("rid") > 5000, F.col("DRAFTAFT") * 2).otherwise(F.col("DRAFTAFT"))})


def _metadata_part(s, d, *cols):
    return _metadata(s, d).select("vessel_id", "variable_name", *cols)


def _refreshed(s, d):
    """Cached reports of one vessel on disk, patched by the refresh job (no raw path, so patch mode)."""
    root, df = scratch(s), vessel(s, d)
    folder = f"{root}/{cfg.STENALINE.vessel_id}"
    D.variable_metadata(df, SIGNALS, max_step_s=STEP).write.parquet(f"{folder}/metadata")
    P.univariate_report(df, SIGNALS, max_step_s=STEP).write.parquet(f"{folder}/univariate_report")
    done = D.refresh_metadata(s, root)
    return s.read.parquet(done[cfg.STENALINE.vessel_id]).select("vessel_id", "variable_name", "physical_limits", "hard_filter", "soft_warning")


def _quality(s, d):
    cols = ["Main_Engine_Power_kW", "DRAFTFWD"]
    df = vessel(s, d)
    return rounded(D.apply_quality_rules(df, D.variable_metadata(df, cols + ["GPSSpeed_kn"], max_step_s=STEP), cols).select("rid", *cols))


def _db_type(s, d):
    v = vessel(s, d)
    return v.select("rid", C.db_type(v.columns).alias("anomaly_type"))
