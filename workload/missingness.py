"""Missingness audit queries."""

from keelson.operators import flags as L
from keelson.operators import missing as M

from .base import GAPPY, SIGNALS, V, rounded, vessel

WITH_TEXT = ["source_file", *SIGNALS]
PRESENT = ["RelWindAngle_deg", "RelWindSpeed_kn", "DRAFTAFT", "DRAFTFWD", "Avg_draft_m", "Fuel_Consumption_t_per_day",
           "Main_Engine_Power_kW", "GPSSpeed_kn"]      # the priority sensors the bound data has, in order


def _report(cols):
    return " UNION ALL ".join(
        f"SELECT vessel_id, '{c}' AS signal, count(*) FILTER ({c} IS NULL) AS missing_count, "
        f"round_even(count(*) FILTER ({c} IS NULL) / count(*) * 100, 3) AS missing_pct FROM v GROUP BY 1" for c in cols)


def _period(expr):
    cols = ", ".join(f"round_even(count(*) FILTER ({c} IS NULL) / count(*) * 100, 2) AS {c}" for c in GAPPY)
    return f"{V} SELECT vessel_id, {expr} AS period, {cols} FROM v GROUP BY 1, 2"


BLOCKS = ", p AS (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY rid) - 1 AS pos FROM v), b AS (" + " UNION ALL ".join(
    f"""SELECT vessel_id, '{c}' AS "column", min(pos) AS row_start, max(pos) AS row_end, count(*) AS n_rows,
    arg_min(Date, pos) AS start_ts, arg_max(Date, pos) AS end_ts
    FROM (SELECT vessel_id, Date, pos, pos - row_number() OVER (PARTITION BY vessel_id ORDER BY pos) AS grp FROM p WHERE {c} IS NULL)
    GROUP BY vessel_id, grp HAVING count(*) >= 2""" for c in GAPPY) + """),
bk AS (SELECT vessel_id, "column", CASE WHEN n_rows <= 3 THEN 'isolated' WHEN n_rows <= 200 THEN 'short_outage' ELSE 'long_outage' END
 AS gap_type, row_start, row_end, n_rows, round_even(date_diff('microsecond', start_ts, end_ts)/1e6/60, 2) AS duration_min,
 start_ts, end_ts FROM b)"""
NULLS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in PRESENT)
SIM = f", sim AS (SELECT vessel_id, Date AS \"timestamp\", {NULLS} AS n_sensors_missing, {', '.join(PRESENT)} FROM v WHERE {NULLS} >= 3)"

QUERIES = {
    "missing_report": (
        lambda s, d: M.missing_report(vessel(s, d), WITH_TEXT), f"{V} {_report(WITH_TEXT)}"),
    "missingness_overall": (
        lambda s, d: M.missing_report(vessel(s, d).withColumn("vessel_id", _fleet()), WITH_TEXT),
        f"WITH v AS (SELECT * REPLACE ('fleet' AS vessel_id) FROM ({V} SELECT * FROM v)) {_report(WITH_TEXT)}"),
    "ordered_distinct_union": (
        lambda s, d: M.columns_of_interest(M.missing_report(vessel(s, d), WITH_TEXT), at_most=24),
        f"""{V}, r AS ({_report(WITH_TEXT)}), o AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(PRESENT))}) t(signal, place))
        SELECT vessel_id, row_number() OVER (PARTITION BY vessel_id ORDER BY place ASC NULLS LAST, missing_pct DESC, signal) AS position,
        signal, missing_count, missing_pct FROM r LEFT JOIN o USING (signal) WHERE place IS NOT NULL OR missing_count > 0"""),
    "missingness_by_period": (
        lambda s, d: M.missingness_by_period(vessel(s, d), GAPPY, "day"), _period("strftime(Date, '%Y-%m-%d')")),
    "missingness_by_week": (
        lambda s, d: M.missingness_by_period(vessel(s, d), GAPPY, "week"),
        _period("strftime(date_trunc('week', Date), '%Y-%m-%d') || '/' || strftime(date_trunc('week', Date) + INTERVAL 6 DAY, '%Y-%m-%d')")),
    "missingness_by_month": (
        lambda s, d: M.missingness_by_period(vessel(s, d), GAPPY, "month"), _period("strftime(Date, '%Y-%m')")),
    "comissing_jaccard": (
        lambda s, d: rounded(M.comissing_jaccard(vessel(s, d), GAPPY)),
        f"{V} " + " UNION ALL ".join(
            f"""SELECT vessel_id, '{a}' AS signal_a, '{b}' AS signal_b, round_even(coalesce(count(*) FILTER ({a} IS NULL AND {b} IS NULL)
            / nullif(count(*) FILTER ({a} IS NULL OR {b} IS NULL), 0), 0), 6) AS jaccard FROM v GROUP BY 1"""
            for a in GAPPY for b in GAPPY)),
    "simultaneous_failure": (lambda s, d: rounded(L.simultaneous_failure(vessel(s, d))), f"""{V}{SIM} SELECT vessel_id, "timestamp",
        n_sensors_missing, {', '.join(f'round_even({c}, 6) AS {c}' for c in PRESENT)} FROM sim"""),
    "outage_blocks": (lambda s, d: M.outage_blocks(vessel(s, d), GAPPY), f"{V}{BLOCKS} SELECT * FROM bk"),
    "outage_block_summary": (
        lambda s, d: M.outage_block_summary(M.outage_blocks(vessel(s, d), GAPPY)),
        f'{V}{BLOCKS} SELECT vessel_id, "column", gap_type, count(*) AS n_events, CAST(sum(n_rows) AS BIGINT) AS total_rows FROM bk GROUP BY 1, 2, 3'),
    "missing_audit_summary": (
        lambda s, d: M.missing_audit_summary(vessel(s, d), GAPPY),
        f"""{V}{BLOCKS}{SIM}, r AS ({_report(GAPPY)}),
        o AS (SELECT vessel_id, count(*) FILTER (missing_count > 0) AS n_cols_with_missing,
          arg_max(signal, (missing_count, missing_pct, signal)) AS most_missing_col,
          arg_max(missing_pct, (missing_count, missing_pct, signal)) AS most_missing_pct FROM r GROUP BY 1),
        k AS (SELECT vessel_id, count(*) AS n_block_outages_total, count(*) FILTER (gap_type = 'isolated') AS n_isolated_gaps,
          count(*) FILTER (gap_type = 'short_outage') AS n_short_outages, count(*) FILTER (gap_type = 'long_outage') AS n_long_outages
          FROM bk GROUP BY 1),
        t AS (SELECT vessel_id, count(*) AS n_simultaneous_failure_rows FROM sim GROUP BY 1)
        SELECT vessel_id, n_cols_with_missing, most_missing_col, most_missing_pct,
        coalesce(n_block_outages_total, 0) AS n_block_outages_total, coalesce(n_isolated_gaps, 0) AS n_isolated_gaps,
        coalesce(n_short_outages, 0) AS n_short_outages, coalesce(n_long_outages, 0) AS n_long_outages,
        coalesce(n_simultaneous_failure_rows, 0) AS n_simultaneous_failure_rows
        FROM o LEFT JOIN k USING (vessel_id) LEFT JOIN t USING (vessel_id)"""),
}


def _fleet():
    from pyspark.sql import functions as F
    return F.lit("fleet")
