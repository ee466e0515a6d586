"""Time-axis audit queries."""

from keelson.operators import audit as A
from keelson.operators import windows as W
from keelson.operators.ordered import Ordered

from .base import INTERVAL as E
from .base import SIGNALS, STEP, V, VD, rounded, unpivot_sql, vessel, with_duplicates

STEPS = """, u AS (SELECT vessel_id, Date, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT *, lead(Date) OVER w AS next_ts,
  date_diff('microsecond', Date, lead(Date) OVER w)/1e6 AS step_s FROM u WINDOW w AS (PARTITION BY vessel_id ORDER BY Date))"""
MISSED = f"CAST(coalesce(greatest(0, round_even(step_s/{E}, 0) - 1), 0) AS BIGINT)"
IRREGULAR = f"(step_s >= 2 AND step_s < {10 * E} AND least(step_s % {E}, {E} - step_s % {E}) > 15)"
DAILY = f""", d AS (SELECT vessel_id, strftime(Date, '%Y-%m-%d') AS date, count(*) AS n_records,
  CAST(sum({MISSED}) AS BIGINT) AS missed_beats FROM s GROUP BY ALL),
dc AS (SELECT *, n_records + missed_beats AS n_expected,
  round_even(n_records / greatest(n_records + missed_beats, 1) * 100, 2) AS pct_coverage FROM d)"""
GAPS = f""", g AS (SELECT vessel_id, Date AS gap_start, next_ts AS gap_end, round_even(step_s/60, 2) AS duration_min,
  round_even(step_s/3600, 3) AS duration_h, {MISSED} AS missed_beats, strftime(Date, '%Y-%m') AS month,
  strftime(Date, '%Y-%m-%d') AS day FROM s WHERE step_s > {10 * E})"""
FIVE = ["GPSSpeed_kn", "GPS_LAT", "GPS_LON", "Main_Engine_Power_kW", "DRAFTAFT"]


def _around(signals):
    cols = ", ".join(f"first({s}) OVER {f} AS {s}_{f}_first, min({s}) OVER {f} AS {s}_{f}_lo, max({s}) OVER {f} AS {s}_{f}_hi"
                     for s in signals for f in ("pre", "post"))
    return f"""SELECT vessel_id, rid, date_diff('microsecond', lag(Date) OVER o, Date)/1e6 AS gap_s,
      count(*) OVER pre AS n_pre, count(*) OVER post AS n_post, {cols} FROM v
      WINDOW o AS (PARTITION BY vessel_id ORDER BY Date, rid),
        pre AS (PARTITION BY vessel_id ORDER BY Date, rid ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING),
        post AS (PARTITION BY vessel_id ORDER BY Date, rid ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)"""


STUCK = " OR ".join(f"coalesce({s}_pre_lo = {s}_pre_hi AND {s}_post_lo = {s}_post_hi AND {s}_pre_first = {s}_post_first, false)"
                    for s in ["Main_Engine_Power_kW", "DRAFTAFT", "DRAFTFWD", "GPS_LAT", "Trim_m"])
STUCKABLE = ["Main_Engine_Power_kW", "DRAFTAFT", "DRAFTFWD", "GPS_LAT", "Trim_m"]


def _neighbourhood(s, d):
    from pyspark.sql import functions as F
    out = A.gap_neighbourhood(vessel(s, d), ["DRAFTAFT", "DRAFTFWD"], E)
    return rounded(out.select("vessel_id", "rid", "gap_s", "n_pre", "n_post", *[
        F.col(f"{c}_{side}.{k}").alias(f"{c}_{side}_{k}") for c in ("DRAFTAFT", "DRAFTFWD")
        for side in ("pre", "post") for k in ("lo", "hi")]))


QUERIES = {
    "temporal_coverage": (
        lambda s, d: rounded(A.temporal_coverage(vessel(s, d))),
        f"""{V}, g AS (SELECT vessel_id, Date, date_diff('microsecond', lag(Date) OVER (PARTITION BY vessel_id
        ORDER BY Date, rid), Date)/1e6 AS gap FROM v),
        q AS (SELECT vessel_id, quantile_cont(gap, 0.5) AS m, max(gap) AS x FROM g GROUP BY 1)
        SELECT g.vessel_id, strftime(Date, '%Y-%m-%d') AS date, count(*) AS records, round_even(any_value(m), 6) AS median_gap_sec,
        round_even(any_value(x), 6) AS max_gap_sec FROM g JOIN q USING (vessel_id) GROUP BY 1, 2"""),
    "duplicate_timestamps": (
        lambda s, d: A.duplicate_timestamps(with_duplicates(s, d)),
        f"""{VD} SELECT vessel_id, Date AS "timestamp", count(*) AS n_occurrences, strftime(Date, '%Y-%m') AS month
        FROM v GROUP BY vessel_id, Date HAVING count(*) > 1"""),
    "duplicate_summary": (
        lambda s, d: A.duplicate_summary(with_duplicates(s, d)),
        f"""{VD}, u AS (SELECT vessel_id, Date, count(*) AS n FROM v GROUP BY ALL)
        SELECT vessel_id, CAST(sum(n) AS BIGINT) AS n_total, count(*) AS n_unique, count(*) FILTER (n > 1) AS n_dup_ts,
        CAST(sum(n - 1) AS BIGINT) AS n_dup_rows, round_even(sum(n - 1) / sum(n) * 100, 3) AS pct_dup FROM u GROUP BY 1"""),
    "sort_order_check": (
        lambda s, d: A.sort_order_check(with_duplicates(s, d)),
        f"""{VD}, l AS (SELECT vessel_id, Date, lag(Date) OVER (PARTITION BY vessel_id ORDER BY rid) AS p FROM v)
        SELECT vessel_id, count(*) FILTER (Date < p) AS n_out_of_order, count(*) FILTER (Date < p) = 0 AS is_sorted
        FROM l GROUP BY 1"""),
    "distinct_timestamps": (
        lambda s, d: A.distinct_timestamps(with_duplicates(s, d)), f"{VD} SELECT DISTINCT vessel_id, Date FROM v"),
    "step_diff": (
        lambda s, d: rounded(W.step_diff(vessel(s, d), "GPSSpeed_kn").select("vessel_id", "rid", "dt_s", "dv")),
        f"""{V} SELECT vessel_id, rid, round_even(date_diff('microsecond', lag(Date) OVER w, Date)/1e6, 6) AS dt_s,
        round_even(GPSSpeed_kn - lag(GPSSpeed_kn) OVER w, 6) AS dv FROM v
        WINDOW w AS (PARTITION BY vessel_id ORDER BY Date, rid)"""),
    "interval_stats": (
        lambda s, d: A.interval_stats(vessel(s, d), E),
        f"""{V}{STEPS} SELECT vessel_id, round_even(quantile_cont(step_s, 0.5), 1) AS median_interval_sec,
        round_even(count(*) FILTER (step_s BETWEEN {E - 15} AND {E + 15}) / count(step_s) * 100, 2) AS pct_at_expected
        FROM s GROUP BY 1"""),
    "interval_distribution": (
        lambda s, d: A.interval_distribution(vessel(s, d)),
        f"""{V}{STEPS}, c AS (SELECT vessel_id, round_even(step_s, 0) AS r, count(*) AS c FROM s WHERE step_s IS NOT NULL
        GROUP BY ALL), m AS (SELECT vessel_id, r FROM c QUALIFY row_number() OVER (PARTITION BY vessel_id ORDER BY c DESC, r) = 1)
        SELECT s.vessel_id, round_even(quantile_cont(step_s, 0.5), 4) AS median_interval,
        round_even(avg(step_s), 4) AS mean_interval, round_even(quantile_cont(step_s, 0.95), 4) AS p95_interval,
        round_even(quantile_cont(step_s, 0.99), 4) AS p99_interval, round_even(max(step_s), 4) AS max_interval,
        any_value(r) AS most_common_interval FROM s JOIN m USING (vessel_id) GROUP BY 1"""),
    "missed_beats": (
        lambda s, d: A.missed_beats(vessel(s, d), E),
        f"""{V}{STEPS} SELECT vessel_id, count(*) AS n_unique, CAST(sum({MISSED}) AS BIGINT) AS n_missed_beats,
        round_even(count(*) / (count(*) + sum({MISSED})) * 100, 2) AS pct_coverage FROM s GROUP BY 1"""),
    "coverage_by_day": (lambda s, d: A.coverage_by_day(vessel(s, d), E), f"{V}{STEPS}{DAILY} SELECT * FROM dc"),
    "outer_align_daily": (
        lambda s, d: _align(s, d),
        f"""{V}{STEPS}{DAILY}, miss AS (SELECT vessel_id, date, missed_beats FROM d WHERE missed_beats > 0),
        rec AS (SELECT vessel_id, date, n_records FROM d WHERE n_records >= 13)
        SELECT vessel_id, date, coalesce(n_records, 0) AS n_records, coalesce(missed_beats, 0) AS missed_beats
        FROM rec FULL OUTER JOIN miss USING (vessel_id, date)"""),
    "irregular_gaps": (
        lambda s, d: A.irregular_gaps(vessel(s, d), E),
        f"{V}{STEPS} SELECT vessel_id, count(*) FILTER ({IRREGULAR}) AS n_irregular_gaps FROM s GROUP BY 1"),
    "long_gap_catalogue": (lambda s, d: A.long_gap_catalogue(vessel(s, d), E), f"{V}{STEPS}{GAPS} SELECT * FROM g"),
    "gap_neighbourhood": (
        _neighbourhood,
        f"""{V}, a AS ({_around(['DRAFTAFT', 'DRAFTFWD'])}) SELECT vessel_id, rid, round_even(gap_s, 6) AS gap_s, n_pre, n_post,
        {', '.join(f'{c}_{f}_{k}' for c in ('DRAFTAFT', 'DRAFTFWD') for f in ('pre', 'post') for k in ('lo', 'hi'))}
        FROM a WHERE gap_s > {10 * E}"""),
    "repeated_blocks": (
        lambda s, d: A.repeated_blocks(vessel(s, d), STUCKABLE, E),
        f"""{V}, a AS ({_around(STUCKABLE)}) SELECT vessel_id, count(*) AS n_long_gaps,
        count(*) FILTER (n_pre >= 3 AND n_post >= 3 AND ({STUCK})) AS n_repeated_blocks
        FROM a WHERE gap_s > {10 * E} GROUP BY 1"""),
    "time_audit_summary": (
        lambda s, d: A.time_audit_summary(with_duplicates(s, d), STUCKABLE, E),
        f"""{VD}{STEPS}, o AS (SELECT vessel_id, Date, lag(Date) OVER (PARTITION BY vessel_id ORDER BY rid) AS p FROM v),
        oo AS (SELECT vessel_id, count(*) FILTER (Date < p) AS n_out_of_order FROM o GROUP BY 1),
        a AS ({_around(STUCKABLE)}), b AS (SELECT vessel_id, count(*) FILTER (n_pre >= 3 AND n_post >= 3 AND ({STUCK})) AS rb
        FROM a WHERE gap_s > {10 * E} GROUP BY 1),
        w AS (SELECT s.vessel_id, CAST(sum(n) AS DOUBLE) AS n_total_timestamps, CAST(0 AS DOUBLE) AS n_unparseable,
          CAST(count(*) AS DOUBLE) AS n_unique_timestamps, CAST(count(*) FILTER (n > 1) AS DOUBLE) AS n_duplicate_timestamps,
          CAST(sum(n - 1) AS DOUBLE) AS n_duplicate_rows, round_even(sum(n - 1)/sum(n)*100, 3) AS pct_duplicates,
          CAST(any_value(n_out_of_order) = 0 AS DOUBLE) AS is_sorted, CAST(any_value(n_out_of_order) AS DOUBLE) AS n_out_of_order,
          round_even(quantile_cont(step_s, 0.5), 1) AS median_interval_sec,
          round_even(count(*) FILTER (step_s BETWEEN {E - 15} AND {E + 15}) / count(step_s) * 100, 2) AS pct_at_expected,
          CAST(sum({MISSED}) AS DOUBLE) AS n_missed_beats,
          round_even(count(*) / (count(*) + sum({MISSED})) * 100, 2) AS pct_coverage,
          CAST(count(*) FILTER ({IRREGULAR}) AS DOUBLE) AS n_irregular_gaps,
          CAST(count(*) FILTER (step_s > {10 * E}) AS DOUBLE) AS n_long_gaps,
          round_even(coalesce(sum(round_even(step_s/3600, 3)) FILTER (step_s > {10 * E}), 0), 2) AS total_gap_hours,
          CAST(coalesce(any_value(rb), 0) AS DOUBLE) AS n_repeated_blocks
        FROM s JOIN oo USING (vessel_id) LEFT JOIN b USING (vessel_id) GROUP BY 1)
        UNPIVOT w ON COLUMNS(* EXCLUDE (vessel_id)) INTO NAME metric VALUE value"""),
    "month_spine": (
        lambda s, d: _spine(s, d),
        f"""{V}, x AS (SELECT vessel_id, min(Date) AS a, max(Date) AS b FROM v GROUP BY 1)
        SELECT vessel_id, strftime(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)),
        '%Y-%m') AS month FROM x"""),
    "monthly_gap_coverage": (
        lambda s, d: rounded(A.monthly_gap_coverage(vessel(s, d), E), 4),
        f"""{V}{STEPS}{DAILY}{GAPS}, gm AS (SELECT vessel_id, month, count(*) AS n_gaps, sum(duration_min) AS m FROM g GROUP BY ALL),
        cm AS (SELECT vessel_id, substr(date, 1, 7) AS month, round_even(avg(pct_coverage), 2) AS c FROM dc GROUP BY ALL)
        SELECT vessel_id, month, coalesce(n_gaps, 0) AS n_gaps, round_even(coalesce(m, 0), 4) AS total_gap_min,
        coalesce(c, 0) AS mean_coverage FROM cm LEFT JOIN gm USING (vessel_id, month)"""),
    "coverage_calendar": (
        lambda s, d: A.coverage_calendar(vessel(s, d), E),
        f"""{V}{STEPS}{DAILY} SELECT vessel_id, substr(date, 1, 7) AS month, {', '.join(
            f"any_value(pct_coverage) FILTER (substr(date, 9, 2) = '{k:02d}') AS d{k:02d}" for k in range(1, 32))}
        FROM dc GROUP BY 1, 2"""),
    "rank_rows": (
        lambda s, d: Ordered(vessel(s, d).select("vessel_id", "rid", "Date"), ["vessel_id"], ["Date", "rid"]).position("position").result().select("rid", "position"),
        f"{V} SELECT rid, row_number() OVER (PARTITION BY vessel_id ORDER BY Date, rid) - 1 AS position FROM v"),
    "index_align": (
        lambda s, d: _aligned(s, d),
        f"{V} SELECT rid, Date, round_even(Main_Engine_Power_kW - Fuel_Consumption_t_per_day, 6) AS difference FROM v WHERE Main_Engine_Power_kW IS NOT NULL"),
    "rate_of_change": (
        lambda s, d: rounded(W.signal_steps(vessel(s, d), ["Main_Engine_Power_kW", "DRAFTAFT"], max_step_s=STEP)
                             .where("roc IS NOT NULL").select("vessel_id", "signal", "ts", "roc")),
        f"""{V}, l AS ({unpivot_sql(['Main_Engine_Power_kW', 'DRAFTAFT'])}),
        r AS (SELECT *, value - lag(value) OVER w AS dv, date_diff('microsecond', lag(Date) OVER w, Date)/1e6 AS dt FROM l
        WINDOW w AS (PARTITION BY vessel_id, signal ORDER BY Date, rid))
        SELECT vessel_id, signal, Date AS ts, round_even(dv/dt, 6) AS roc FROM r WHERE dt > 0 AND dt <= {STEP}"""),
    "run_length_islands": (
        lambda s, d: W.run_length_islands(vessel(s, d), "DRAFTAFT").drop("run_id"),
        f"""{V}, l AS (SELECT vessel_id, rid, Date, round_even(DRAFTAFT, 4) AS v FROM v WHERE DRAFTAFT IS NOT NULL),
        c AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS chg FROM l WINDOW w AS (PARTITION BY vessel_id ORDER BY rid)),
        r AS (SELECT *, sum(chg) OVER (PARTITION BY vessel_id ORDER BY rid) AS run FROM c)
        SELECT vessel_id, count(*) AS n, min(rid) AS rid_start, max(rid) AS rid_end, min(Date) AS ts_start, max(Date) AS ts_end,
        any_value(v) AS v FROM r GROUP BY vessel_id, run"""),
}


def _aligned(s, d):
    """Two signals of one row are aligned by being in the row; nothing is joined."""
    v = vessel(s, d).where("Main_Engine_Power_kW IS NOT NULL")
    return rounded(v.selectExpr("rid", "Date", "Main_Engine_Power_kW - Fuel_Consumption_t_per_day AS difference"))


def _align(s, d):
    from pyspark.sql import functions as F
    days = A.coverage_by_day(vessel(s, d), E)
    return A.outer_align_daily(days.where("n_records >= 13").select("vessel_id", "date", "n_records"),
                               days.where("missed_beats > 0").select("vessel_id", "date", "missed_beats"))


def _spine(s, d):
    from pyspark.sql import functions as F
    return A.month_spine(vessel(s, d).groupBy("vessel_id").agg(F.min("Date").alias("first_ts"), F.max("Date").alias("last_ts")))
