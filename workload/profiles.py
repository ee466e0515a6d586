"""Signal profile and distribution queries."""

from itertools import combinations

from pyspark.sql import functions as F

from keelson import config as cfg
from keelson.operators import profile as P
from keelson.operators import windows as W

from .base import FEATURES, SIGNALS, STEP, V, VD, rounded, unpivot_sql, vessel, with_duplicates

UN = "WITH v AS MATERIALIZED (" + V + " SELECT * FROM v), l AS (" + unpivot_sql(SIGNALS) + ")"


def q(p, x="value"):
    return f"quantile_cont({x}, {p})"


def re(x, d):
    return f"round_even({x}, {d})"


def _corr(pairs):
    return " UNION ALL ".join(f"SELECT vessel_id, '{a}' AS signal_a, '{b}' AS signal_b, round_even(corr({a}, {b}), 6) AS corr "
                              f"FROM v GROUP BY 1" for a, b in pairs)


def _grouped_corr():
    parts = []
    for g in cfg.FEATURE_GROUPS:
        own = [s for s in SIGNALS if cfg.group_of(s) == g]
        members = list(dict.fromkeys([*own, "Main_Engine_Power_kW", "GPSSpeed_kn"]))
        parts += [f"SELECT vessel_id, '{g}' AS feature_group, '{a}' AS signal_a, '{b}' AS signal_b, "
                  f"round_even(corr({a}, {b}), 6) AS corr FROM v GROUP BY 1" for a, b in sorted({tuple(sorted(p)) for p in combinations(members, 2)})]
    return " UNION ALL ".join(parts)


def _values(rows):
    def lit(x):
        if x is None:
            return "CAST(NULL AS DOUBLE)"
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return "true" if x is True else "false" if x is False else f"CAST({x} AS DOUBLE)"
    return ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


LIMITS = cfg.physical_limits()
PROFILE_ROWS = []
for _s in SIGNALS:
    _p = next((p for p in cfg.SIGNAL_PROFILES if p[0] == _s), None) or next((p for p in cfg.SIGNAL_PROFILES if _s in p[6]), None)
    _lo, _hi = LIMITS.get(_s, (None, None))
    PROFILE_ROWS.append((_s, cfg.group_of(_s), _p[1] if _p else _s, _p[2] if _p else "", _lo, _hi))
PROFILE_SQL = f"pr AS (SELECT * FROM (VALUES {_values(PROFILE_ROWS)}) t(signal, feature_group, label, unit, lo, hi))"


def roc_sql(order, source="l"):
    return f"""st AS (SELECT vessel_id, signal, Date, value, value - lag(value) OVER w AS dv,
      date_diff('microsecond', lag(Date) OVER w, Date)/1e6 AS dt, lag(value) OVER w AS pv, row_number() OVER w AS pos, rid
      FROM {source} WINDOW w AS (PARTITION BY vessel_id, signal ORDER BY {order})),
    rc AS (SELECT *, CASE WHEN dt > 0 AND dt <= {STEP} THEN dv/dt END AS roc FROM st)"""


def hist_sql(source, value, bins, lo, hi, keys="vessel_id, signal"):
    """Histogram of `value`; lo/hi are SQL aggregates, bins an SQL expression over n."""
    return f"""e AS (SELECT {keys}, count(*) AS n, {lo} AS lo, {hi} AS hi FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL),
    f AS (SELECT * REPLACE (CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi),
      {bins} AS k FROM e),
    h AS (SELECT {', '.join('f.' + x.strip() for x in keys.split(','))}, n, lo, (hi - lo)/k AS w,
      CAST(least(floor((least(greatest({value}, lo), hi) - lo) / ((hi - lo)/k)), k - 1) AS INT) AS bin FROM {source} JOIN f USING ({keys})
      WHERE {value} IS NOT NULL)
    SELECT {keys}, bin, round_even(any_value(lo + bin * w) + 1e-9, 5) AS bin_lo, round_even(any_value(lo + bin * w + w) + 1e-9, 5) AS bin_hi,
      count(*) AS count, round_even(count(*) / (any_value(n) * any_value(w)), 6) AS density FROM h GROUP BY {keys}, bin"""


def box_sql(source, keys, value="value", digits=6):
    return f"""bq AS (SELECT {keys}, {q(.25, value)} AS q1, {q(.5, value)} AS med, {q(.75, value)} AS q3 FROM {source}
      WHERE {value} IS NOT NULL GROUP BY ALL),
    bx AS (SELECT {keys}, count(*) AS n, any_value(q1) AS q1, any_value(med) AS median, any_value(q3) AS q3,
      least(min({value}) FILTER ({value} >= q1 - 1.5*(q3-q1)), any_value(q1)) AS whisker_lo,
      greatest(max({value}) FILTER ({value} <= q3 + 1.5*(q3-q1)), any_value(q3)) AS whisker_hi
      FROM {source} JOIN bq USING ({keys}) WHERE {value} IS NOT NULL GROUP BY ALL),
    bb AS (SELECT {keys}, n, {', '.join(f'round_even({c}, {digits}) AS {c}' for c in ('q1', 'median', 'q3', 'whisker_lo', 'whisker_hi'))} FROM bx)"""


ADAPT = "CAST(least(100, greatest(20, floor(pow(n, 0.38)))) AS INT)"
ADAPT_ROC = "CAST(least(80, greatest(20, floor(pow(n, 0.35)))) AS INT)"
QN = list(zip(P.QNAMES, P.PROBS))

UNITS = f"""{UN}, rules AS (SELECT * FROM (VALUES {_values(cfg.UNIT_CHECKS)}) t(signal, label, ok_lo, ok_hi, hint, note_ok, note_warn, note_hint)),
a AS (SELECT vessel_id, signal, count(*) AS n_valid, min(value) AS mn, {q(.05)} AS p5, {q(.5)} AS med, {q(.95)} AS p95, max(value) AS mx
  FROM l GROUP BY 1, 2),
c AS (SELECT *, hint = 'radian' AND abs(p95) < 2 AND abs(p5) < 2 AS rad, hint = 'ms' AND p95 < 13 AND med > 0.5 AS slow,
  (hint = 'watt' AND p95 > 100000) OR (hint = 'mm' AND p95 > 100) AS big, mn < ok_lo OR p95 > ok_hi AS beyond FROM a JOIN rules USING (signal))
SELECT vessel_id, signal AS "column", label, n_valid, {re('mn', 4)} AS observed_min, {re('p5', 4)} AS p5, {re('med', 4)} AS median,
{re('p95', 4)} AS p95, {re('mx', 4)} AS observed_max,
CASE WHEN rad THEN 'CRITICAL' WHEN slow AND mx < 15 AND med < 6 THEN 'WARNING' WHEN slow THEN 'ok' WHEN big THEN 'CRITICAL'
  WHEN beyond THEN 'WARNING' ELSE 'ok' END AS status,
CASE WHEN rad THEN note_hint WHEN slow AND mx < 15 AND med < 6 THEN note_hint WHEN slow THEN note_ok WHEN big THEN note_hint
  WHEN beyond THEN note_warn ELSE note_ok END AS note FROM c"""


def _kde_sql(points=400, cells=2048):
    return f"""{UN},
    e AS (SELECT vessel_id, signal, {q(.001)} AS lo, {q(.999)} AS hi FROM l GROUP BY 1, 2),
    x AS (SELECT vessel_id, signal, lo, hi, least(greatest(value, lo), hi) AS x FROM l JOIN e USING (vessel_id, signal)),
    b AS (SELECT vessel_id, signal, least(floor((x-lo)/(hi-lo)*{cells}), {cells - 1}) AS cell, count(*) AS c, avg(x) AS m FROM x GROUP BY 1,2,3),
    s AS (SELECT vessel_id, signal, count(*) AS n, stddev_samp(x) AS sd, any_value(lo) AS lo, any_value(hi) AS hi FROM x GROUP BY 1,2),
    g AS (SELECT *, sd * pow(n*0.75, -0.2) AS h FROM b JOIN s USING (vessel_id, signal), (SELECT CAST(range AS INT) AS i FROM range({points})))
    SELECT vessel_id, signal, i, round_even(any_value(lo + (hi-lo)*i/{points - 1}), 5) AS x,
    round_even(sum(c*exp(-0.5*pow((lo + (hi-lo)*i/{points - 1} - m)/h, 2))/(n*h*2.5066282746310002)), 8) AS density FROM g GROUP BY 1,2,3"""


QUERIES = {
    "summary_stats": (
        lambda s, d: P.summary_stats(vessel(s, d)),
        f"""{UN} SELECT vessel_id, signal, count(*) AS count, {re('avg(value)', 4)} AS mean, {re('stddev_samp(value)', 4)} AS std,
        {re('min(value)', 4)} AS min, {re('max(value)', 4)} AS max, {re(q(.25), 4)} AS p25, {re(q(.5), 4)} AS p50, {re(q(.75), 4)} AS p75
        FROM l WHERE signal <> 'RelWindAngle_deg' GROUP BY 1, 2"""),
    "numeric_describe_ext": (
        lambda s, d: P.numeric_describe_ext(vessel(s, d)),
        f"""{UN}, t AS (SELECT vessel_id, count(*) AS nt FROM v GROUP BY 1) SELECT vessel_id, signal, any_value(nt) - count(*) AS missing,
        count(*) AS count, {re('avg(value)', 4)} AS mean, {re('stddev_samp(value)', 4)} AS std, {re('min(value)', 4)} AS min,
        {re('max(value)', 4)} AS max, {', '.join(f"{re(q(p), 4)} AS p{round(p * 100):02d}" for p in (.01, .05, .5, .95, .99))}
        FROM l JOIN t USING (vessel_id) WHERE signal <> 'RelWindAngle_deg' GROUP BY 1, 2"""),
    "correlation_matrix": (
        lambda s, d: rounded(P.correlation_matrix(vessel(s, d), FEATURES)), f"{V} {_corr(combinations(FEATURES, 2))}"),
    "grouped_correlations": (
        lambda s, d: rounded(P.grouped_correlations(vessel(s, d), SIGNALS)), f"{V} {_grouped_corr()}"),
    "top_correlations": (
        lambda s, d: rounded(P.top_correlations(P.correlation_matrix(vessel(s, d), FEATURES), 5)),
        f"""{V}, c AS ({_corr(combinations(FEATURES, 2)).replace('round_even(corr(', '(corr(').replace(', 6) AS', ') AS')}),
        r AS (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY abs(corr) DESC, signal_a, signal_b) AS rank FROM c)
        SELECT vessel_id, signal_a, signal_b, round_even(corr, 6) AS corr, rank FROM r WHERE rank <= 5"""),
    "target_correlations": (
        lambda s, d: rounded(P.target_correlations(vessel(s, d), "Fuel_Consumption_t_per_day", FEATURES)),
        f"""{V}, c AS ({' UNION ALL '.join(f"SELECT vessel_id, '{a}' AS signal, corr({a}, Fuel_Consumption_t_per_day) AS corr FROM v GROUP BY 1"
                                           for a in FEATURES if a != 'Fuel_Consumption_t_per_day')})
        SELECT vessel_id, signal, round_even(corr, 6) AS corr,
        row_number() OVER (PARTITION BY vessel_id ORDER BY abs(corr) DESC, signal) AS rank FROM c"""),
    "univariate_report": (
        lambda s, d: P.univariate_report(vessel(s, d), SIGNALS, max_step_s=STEP),
        f"""{UN}, {PROFILE_SQL}, {roc_sql('Date, rid')}, t AS (SELECT vessel_id, count(*) AS nt FROM v GROUP BY 1),
        rr AS (SELECT vessel_id, signal, {re('quantile_cont(abs(roc), 0.5)', 8)} AS m, {re('quantile_cont(abs(roc), 0.99)', 8)} AS p
          FROM rc GROUP BY 1, 2)
        SELECT vessel_id, signal, any_value(feature_group) AS feature_group, any_value(label) AS label, any_value(unit) AS unit,
        any_value(nt) AS n_total, count(*) AS n_valid, any_value(nt) - count(*) AS n_missing,
        {re('(any_value(nt) - count(*)) / any_value(nt) * 100', 2)} AS pct_missing, {re('avg(value)', 4)} AS mean,
        {re('stddev_samp(value)', 4)} AS std, {re('min(value)', 4)} AS min, {re('max(value)', 4)} AS max,
        {', '.join(f'{re(q(p), 4)} AS {n}' for n, p in QN)}, count(*) FILTER (value < 0) AS n_negative,
        count(*) FILTER (value = 0) AS n_zero, count(*) FILTER (value < lo) + count(*) FILTER (value > hi) AS n_physical_outliers,
        coalesce(any_value(m), 0) AS roc_median_per_s, coalesce(any_value(p), 0) AS roc_p99_per_s
        FROM l JOIN t USING (vessel_id) JOIN pr USING (signal) JOIN rr USING (vessel_id, signal) GROUP BY 1, 2 HAVING count(*) >= 20"""),
    "unit_sanity_check": (lambda s, d: P.unit_sanity_check(vessel(s, d)), UNITS),
    "period_box_stats": (
        lambda s, d: rounded(P.period_box_stats(vessel(s, d), SIGNALS, "week")),
        f"""WITH v AS MATERIALIZED ({V} SELECT * FROM v), l0 AS ({unpivot_sql(SIGNALS)}),
        l AS (SELECT vessel_id, signal, strftime(Date, '%G-W%V') AS period, value FROM l0), {box_sql('l', 'vessel_id, signal, period')}
        SELECT * FROM bb QUALIFY count(*) OVER (PARTITION BY vessel_id, signal) >= 2"""),
    "period_box_stats_monthly": (
        lambda s, d: rounded(P.period_box_stats(_two_months(vessel(s, d)), SIGNALS, "month")),
        f"""WITH v AS MATERIALIZED (SELECT * REPLACE (Date + INTERVAL 15 DAY AS Date) FROM ({V} SELECT * FROM v)), l0 AS ({unpivot_sql(SIGNALS)}),
        l AS (SELECT vessel_id, signal, strftime(Date, '%Y-%m') AS period, value FROM l0), {box_sql('l', 'vessel_id, signal, period')}
        SELECT * FROM bb QUALIFY count(*) OVER (PARTITION BY vessel_id, signal) >= 2"""),
    "histogram": (
        lambda s, d: _bins(P.signal_histogram(vessel(s, d), SIGNALS, bins=60, clip=None)),
        f"{UN}, {hist_sql('l', 'value', '60', 'min(value)', 'max(value)')}"),
    "histogram_adaptive": (
        lambda s, d: _bins(P.signal_histogram(vessel(s, d), SIGNALS)), f"{UN}, {hist_sql('l', 'value', ADAPT, q(.001), q(.999))}"),
    "grouped_histogram": (
        lambda s, d: _bins(P.grouped_histogram(vessel(s, d), SIGNALS)),
        f"""WITH gh AS ({UN}, {hist_sql('l', 'value', '50', q(.01), q(.99))}) SELECT gh.*, CASE signal {' '.join(f"WHEN '{c}' THEN '{cfg.group_of(c)}'" for c in SIGNALS)} END AS feature_group FROM gh"""),
    "roc_histogram": (
        lambda s, d: _bins(P.roc_histogram(W.signal_steps(vessel(s, d), SIGNALS, max_step_s=STEP))),
        f"{UN}, {roc_sql('Date, rid')}, {hist_sql('rc', 'roc', ADAPT_ROC, q(.005, 'roc'), q(.995, 'roc'))}"),
    "kde_curve": (
        lambda s, d: rounded(P.kde_curve(vessel(s, d), SIGNALS), x=5, density=8), _kde_sql()),
    "ecdf": (
        lambda s, d: rounded(P.ecdf(vessel(s, d).withColumn("vessel_id", F.lit("fleet")), SIGNALS, points=5000)),
        f"""{UN}, r AS (SELECT 'fleet' AS vessel_id, signal, value,
        row_number() OVER (PARTITION BY signal ORDER BY value, rid) - 1 AS i, count(*) OVER (PARTITION BY signal) AS n FROM l)
        SELECT vessel_id, signal, round_even(value, 6) AS value, round_even((i+1)/n, 6) AS cumulative FROM r
        WHERE n <= 5000 OR round_even(round_even(i*4999/(n-1), 0)*(n-1)/4999, 0) = i"""),
    "cumulative_distribution": (
        lambda s, d: rounded(P.ecdf(vessel(s, d), SIGNALS, points=1_000_000_000)),
        f"""{UN} SELECT vessel_id, signal, round_even(value, 6) AS value,
        round_even(row_number() OVER (PARTITION BY vessel_id, signal ORDER BY value, rid) / count(*) OVER (PARTITION BY vessel_id, signal), 6) AS cumulative FROM l"""),
    "density_2d": (
        lambda s, d: rounded(P.density_2d(vessel(s, d))),
        f"""{V}, r AS (SELECT vessel_id, GPSSpeed_kn AS x, Main_Engine_Power_kW AS y FROM v WHERE GPSSpeed_kn >= 0 AND Main_Engine_Power_kW >= 0),
        e AS (SELECT vessel_id, min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM r GROUP BY 1)
        SELECT vessel_id, CAST(least(floor((x-xl)/((xh-xl)/60)), 59) AS INT) AS x_bin, CAST(least(floor((y-yl)/((yh-yl)/60)), 59) AS INT) AS y_bin,
        count(*) AS count, round_even(log10(count(*)), 6) AS log_count FROM r JOIN e USING (vessel_id) GROUP BY 1, 2, 3"""),
    "basic_metrics": (
        lambda s, d: P.basic_metrics(with_duplicates(s, d)),
        f"""{VD}, c AS (SELECT * EXCLUDE (rid), count(*) AS n FROM v GROUP BY ALL), w AS (SELECT vessel_id, CAST(sum(n) AS BIGINT) AS n_rows,
        CAST(14 AS BIGINT) AS n_columns, CAST(sum(n-1) AS BIGINT) AS n_duplicate_rows,
        CAST({' + '.join(f"(count(*) > count({c}))::INT" for c in SIGNALS)} AS BIGINT) AS n_columns_with_missing FROM c GROUP BY 1)
        UNPIVOT w ON COLUMNS(* EXCLUDE (vessel_id)) INTO NAME metric VALUE value"""),
    "series_overview": (
        lambda s, d: rounded(P.series_overview(vessel(s, d), SIGNALS)),
        f"""{UN}, t AS (SELECT vessel_id, count(*) AS nt FROM v GROUP BY 1) SELECT vessel_id, signal, count(*) AS n,
        any_value(nt) - count(*) AS n_missing, {re(q(.01), 6)} AS p01, {re(q(.5), 6)} AS median, {re(q(.99), 6)} AS p99
        FROM l JOIN t USING (vessel_id) GROUP BY 1, 2"""),
}


def _bins(df):
    """Bin ends a hair higher, on both sides of the comparison: many are ties of the rounding otherwise."""
    return rounded(df.withColumns({c: F.col(c) + 1e-9 for c in ("bin_lo", "bin_hi")}), bin_lo=5, bin_hi=5)


def _two_months(df):
    return df.withColumn("Date", F.col("Date") + F.expr("INTERVAL 15 DAYS"))
