"""Bivariate queries."""

from itertools import permutations

from keelson.operators import bivariate as B
from keelson.operators import windows as W

from .base import V, rounded, vessel
from .profiles import box_sql

P, S, F_, D, T, WI, A = B.POWER, B.SPEED, B.FUEL, B.DRAFT, B.TRIM, B.WIND, B.ANGLE


def det(m):
    terms = []
    for p in permutations(range(len(m))):
        sign = (-1) ** sum(p[i] > p[j] for i in range(len(p)) for j in range(i + 1, len(p)))
        terms.append(f"{sign} * " + " * ".join(m[i][j] for i, j in enumerate(p)))
    return "(" + " + ".join(terms) + ")"


def cubic_sql(source, x, y, tag="", more=0):
    """CTEs fit<tag>(vessel_id, n, xs, xm, c0..c3) for a cubic through (x, y) of `source`."""
    base = [[f"s{i + j}" for j in range(4)] for i in range(4)]
    coef = ", ".join(f"{det([[f't{i}' if j == k else base[i][j] for j in range(4)] for i in range(4)])} / {det(base)} AS c{k}" for k in range(4))
    return f"""xs{tag} AS (SELECT vessel_id, max(abs({x})) AS xs, max({x}) AS xm FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1),
    ps{tag} AS (SELECT vessel_id, count(*) AS n, any_value(xs) AS xs, any_value(xm) AS xm, {', '.join(f'avg(pow({x}/xs, {k})) AS s{k}' for k in range(7))},
      {', '.join(f'avg(pow({x}/xs, {k}) * {y}) AS t{k}' for k in range(4))} FROM {source} JOIN xs{tag} USING (vessel_id)
      WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1),
    fit{tag} AS (SELECT vessel_id, n, xs, xm, {coef} FROM ps{tag} WHERE n > {more})"""


def val(x):
    return f"(c0 + ({x})/xs * (c1 + ({x})/xs * (c2 + ({x})/xs * c3)))"


NONNEG = f", a AS (SELECT * FROM v WHERE {P} >= 0 AND {S} >= 0)"
UNDER = f", w AS (SELECT * FROM v WHERE {P} >= 0 AND {S} > 1 AND {WI} >= 0), {cubic_sql('w', S, P)}, " \
        f"r AS (SELECT w.*, {P} - {val(S)} AS residual FROM w JOIN fit USING (vessel_id))"
FP = f", b AS (SELECT * FROM v WHERE {P} >= 0 AND {F_} >= 0), lf AS (SELECT vessel_id, count(*) AS n, regr_slope({F_}, {P}) AS slope, " \
     f"regr_intercept({F_}, {P}) AS intercept FROM b GROUP BY 1 HAVING count(*) > 50), " \
     f"lr AS (SELECT vessel_id, {F_} - (slope*{P} + intercept) AS r FROM b JOIN lf USING (vessel_id))"
MS = f", ms AS (SELECT vessel_id, strftime(Date, '%Y-%m') AS month, count(*) AS n, round_even(regr_slope({F_}, {P}), 6) AS slope " \
     "FROM b GROUP BY 1, 2 HAVING count(*) >= 50)"


def _points():
    out = []
    for name, (x, y, z, lo, hi) in B.POINT_TABLES.items():
        cond = [f"{c} IS NOT NULL" for c in (x, y, z)]
        for c in (x, y, z):
            if c == P and x == S or c in (S, WI, F_):
                cond.append(f"{c} >= 0")
            if c == D:
                cond.append(f"{c} > 0")
        w = " AND ".join(cond)
        out.append(f"""SELECT '{name}' AS point_table, vessel_id, rid, round_even({x}, 6) AS x, round_even({y}, 6) AS y, round_even({z}, 6) AS z,
        round_even(lo, 6) AS z_lo, round_even(hi, 6) AS z_hi FROM v JOIN (SELECT vessel_id, quantile_cont({z}, {lo}) AS lo,
        quantile_cont({z}, {hi}) AS hi FROM v WHERE {w} GROUP BY 1) USING (vessel_id) WHERE {w}""")
    return " UNION ALL ".join(out)


def _long(section, cols):
    return " UNION ALL ".join(f"SELECT vessel_id, '{section}' AS section, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM {t}" for m, e, t in cols)


REPORT = f"""{V}{NONNEG}{FP}{MS}, qa AS (SELECT vessel_id, quantile_cont({P}, .75) AS p75, quantile_cont({S}, .25) AS s25 FROM a GROUP BY 1),
sa AS (SELECT vessel_id, count(*) AS n, count(*) FILTER ({S} < 0.5) AS rest, count(*) FILTER ({P} > p75 AND {S} < s25) AS hp,
  round_even(quantile_cont({S}, .5), 3) AS s50, round_even(quantile_cont({P}, .5), 3) AS p50 FROM a JOIN qa USING (vessel_id) GROUP BY 1),
sb AS (SELECT vessel_id, any_value(lf.n) AS n, round_even(any_value(slope), 6) AS slope, round_even(quantile_cont(r, .95), 4) AS p95
  FROM lf JOIN lr USING (vessel_id) GROUP BY 1),
nm AS (SELECT vessel_id, count(*) AS n FROM ms GROUP BY 1),
sc AS (SELECT vessel_id, count(*) AS n, round_even(quantile_cont({D}, .25), 3) AS a, round_even(quantile_cont({D}, .75), 3) AS b
  FROM v WHERE {D} > 0 AND {P} IS NOT NULL GROUP BY 1),
sd AS (SELECT vessel_id, count(*) AS n, round_even(quantile_cont({WI}, .5), 3) AS a, round_even(quantile_cont({WI}, .95), 3) AS b
  FROM v WHERE {WI} >= 0 AND {P} >= 0 AND {S} > 1 GROUP BY 1)
{_long('A_power_vs_speed', [('n_valid', 'n', 'sa'), ('n_at_rest_speed', 'rest', 'sa'), ('n_high_power_low_speed', 'hp', 'sa'), ('speed_p50', 's50', 'sa'), ('power_p50', 'p50', 'sa')])}
UNION ALL {_long('B_fuel_vs_power', [('n_valid', 'n', 'sb'), ('linear_slope', 'slope', 'sb'), ('residual_p95', 'p95', 'sb'), ('n_monthly_slopes', 'n', 'nm')])}
UNION ALL {_long('C_draft_vs_power', [('n_valid', 'n', 'sc'), ('draft_p25', 'a', 'sc'), ('draft_p75', 'b', 'sc')])}
UNION ALL {_long('D_wind_vs_power', [('n_valid', 'n', 'sd'), ('aws_p50', 'a', 'sd'), ('aws_p95', 'b', 'sd')])}"""

QUERIES = {
    "linear_fit": (
        lambda s, d: rounded(B.linear_fit(vessel(s, d))),
        f"""{V}{FP} SELECT vessel_id, any_value(lf.n) AS n, round_even(any_value(slope), 6) AS slope, round_even(any_value(intercept), 6) AS intercept,
        round_even(quantile_cont(r, .05), 6) AS residual_p05, round_even(quantile_cont(r, .95), 6) AS residual_p95
        FROM lf JOIN lr USING (vessel_id) GROUP BY 1"""),
    "monthly_slopes": (
        lambda s, d: rounded(B.monthly_slopes(vessel(s, d))),
        f"""{V}{FP}{MS}, md AS (SELECT vessel_id, quantile_cont(slope, .5) AS m FROM ms GROUP BY 1)
        SELECT vessel_id, month, n, slope, round_even(m, 6) AS median_slope, slope > m*1.15 AS above_median FROM ms JOIN md USING (vessel_id)"""),
    "cubic_fit": (
        lambda s, d: rounded(B.cubic_curve(B.cubic_fit(vessel(s, d).where(f"{P} >= 0 AND {S} >= 0"))), 2),
        f"""{V}{NONNEG}, {cubic_sql('a', S, P, more=100)} SELECT vessel_id, i, round_even(xm*i/199, 2) AS x,
        round_even(greatest({val('xm*i/199')}, 0), 2) AS y FROM fit, (SELECT CAST(range AS INT) AS i FROM range(200))"""),
    "speed_detrended_residuals": (
        lambda s, d: rounded(B.detrended_residuals(vessel(s, d)).select("vessel_id", "rid", "residual"), 2),
        f"{V}{UNDER} SELECT vessel_id, rid, round_even(residual, 2) AS residual FROM r"),
    "fuel_detrended_residuals": (
        lambda s, d: rounded(B.detrended_residuals(vessel(s, d), y=F_, more_than=50).select("vessel_id", "rid", "residual"), 2),
        f"""{V}, w AS (SELECT * FROM v WHERE {F_} >= 0 AND {S} > 1 AND {WI} >= 0), {cubic_sql('w', S, F_, more=50)}
        SELECT vessel_id, rid, round_even({F_} - {val(S)}, 2) AS residual FROM w JOIN fit USING (vessel_id)"""),
    "wind_sector_stats": (
        lambda s, d: rounded(B.wind_sector_stats(B.detrended_residuals(vessel(s, d))), 2),
        f"""{V}{UNDER}, ws AS (SELECT vessel_id, residual, CAST(floor((({A} % 360 + 360) % 360)/45)*45 AS INT) AS sector_deg FROM r),
        {box_sql('ws', 'vessel_id, sector_deg', 'residual', 2)} SELECT * FROM bb"""),
    "wind_rose": (
        lambda s, d: rounded(B.wind_rose(vessel(s, d))),
        f"""{V}, r AS (SELECT vessel_id, {WI} AS w, CAST(least(floor((({A} % 360 + 360) % 360)*36/360), 35) AS INT) AS bin FROM v
          WHERE {WI} >= 0 AND {A} IS NOT NULL),
        g AS (SELECT vessel_id, bin, avg(w) AS m, count(*) AS n FROM r GROUP BY 1, 2),
        sp AS (SELECT vessel_id, CAST(unnest(range(36)) AS INT) AS bin FROM (SELECT vessel_id FROM r GROUP BY 1 HAVING count(*) > 50))
        SELECT vessel_id, bin, round_even(coalesce(m, 0), 6) AS mean_wind, coalesce(n, 0) AS n FROM sp LEFT JOIN g USING (vessel_id, bin)"""),
    "draft_quartile_bands": (
        lambda s, d: rounded(B.draft_quartile_bands(vessel(s, d))),
        f"""{V}{NONNEG}, e AS (SELECT vessel_id, {', '.join(f'quantile_cont({D}, {p}) AS e{i}' for i, p in enumerate((0, .25, .5, .75, 1)))}
          FROM a WHERE {D} IS NOT NULL GROUP BY 1),
        p AS ({' UNION ALL '.join(f'SELECT a.vessel_id, {S}, {P}, {D}, {i + 1} AS band, e{i} AS band_lo, e{i + 1} AS band_hi FROM a JOIN e USING (vessel_id) WHERE {D} >= e{i} AND {D} < e{i + 1} + 0.01' for i in range(4))}),
        z AS (SELECT *, count(*) OVER (PARTITION BY vessel_id, band) AS band_n FROM p)
        SELECT vessel_id, round_even({S}, 6) AS {S}, round_even({P}, 6) AS {P}, {D}, band, band_lo, band_hi, band_n FROM z WHERE band_n >= 20"""),
    "leg_direction_split": (
        lambda s, d: rounded(B.leg_direction_split(vessel(s, d)), 4),
        f"""{V}{NONNEG}, l AS (SELECT *, coalesce(GPS_LAT - lag(GPS_LAT) OVER (PARTITION BY vessel_id ORDER BY rid), 0) AS dl FROM a)
        SELECT vessel_id, CASE WHEN dl >= 0 THEN 'northing' ELSE 'southing' END AS leg, count(*) AS n, round_even(avg({S}), 4) AS mean_speed,
        round_even(avg({P}), 4) AS mean_power FROM l GROUP BY 1, 2"""),
    "monthly_split": (
        lambda s, d: rounded(B.monthly_split(vessel(s, d)), 4),
        f"""{V}{NONNEG} SELECT vessel_id, strftime(Date, '%Y-%m') AS month, count(*) AS n, round_even(avg({S}), 4) AS mean_speed,
        round_even(avg({P}), 4) AS mean_power, round_even(max({S}), 4) AS max_speed, round_even(max({P}), 4) AS max_power FROM a GROUP BY 1, 2"""),
    "bivariate_report": (lambda s, d: rounded(B.bivariate_report(vessel(s, d))), REPORT),
    "bivariate_point_tables": (lambda s, d: rounded(B.bivariate_point_tables(vessel(s, d))), f"{V} {_points()}"),
    "track_points": (
        lambda s, d: rounded(B.track_points(vessel(s, d)).select("vessel_id", "rid", "GPS_LAT", "GPS_LON")),
        f"""{V} SELECT vessel_id, rid, round_even(GPS_LAT, 6) AS GPS_LAT, round_even(GPS_LON, 6) AS GPS_LON FROM v
        WHERE GPS_LAT IS NOT NULL AND GPS_LON IS NOT NULL"""),
    "track_summary": (
        lambda s, d: rounded(B.track_summary(vessel(s, d))),
        f"""{V} SELECT vessel_id, count(*) AS n_points, {', '.join(f'round_even({e}, 6) AS {n}' for e, n in (
            ('arg_min(GPS_LAT, rid)', 'start_lat'), ('arg_min(GPS_LON, rid)', 'start_lon'), ('arg_max(GPS_LAT, rid)', 'end_lat'),
            ('arg_max(GPS_LON, rid)', 'end_lon'), ('min(GPS_LAT)', 'lat_min'), ('max(GPS_LAT)', 'lat_max'), ('min(GPS_LON)', 'lon_min'),
            ('max(GPS_LON)', 'lon_max'), ('quantile_cont(GPS_LAT, .5)', 'lat_centre'), ('quantile_cont(GPS_LON, .5)', 'lon_centre')))} FROM v GROUP BY 1"""),
    "rolling_mean_centered": (
        lambda s, d: rounded(W.rolling_mean_centered(vessel(s, d).where(f"{P} >= 0 AND {F_} >= 0"), [F_, P]).select(
            "vessel_id", "rid", f"roll_{F_}", f"roll_{P}"), 6),
        f"""{V}{FP}, r AS (SELECT vessel_id, rid, {', '.join(f'CASE WHEN count({c}) OVER w >= 20 THEN round_even(avg({c}) OVER w, 6) END AS roll_{c}' for c in (F_, P))}
        FROM b WINDOW w AS (PARTITION BY vessel_id ORDER BY Date, rid ROWS BETWEEN 100 PRECEDING AND 99 FOLLOWING)) SELECT * FROM r"""),
    "rolling_median_by_wind": (
        lambda s, d: rounded(W.rolling_median_by(B.detrended_residuals(vessel(s, d)), "residual", WI).select(
            "vessel_id", "rid", "rolling_median"), 2),
        f"""{V}{UNDER}, p AS (SELECT vessel_id, quantile_cont(abs(residual), .99) AS p99 FROM r GROUP BY 1),
        c AS (SELECT r.vessel_id, rid, {WI} AS wi, least(greatest(residual, -p99), p99) AS x FROM r JOIN p USING (vessel_id))
        SELECT vessel_id, rid, CASE WHEN count(x) OVER w >= 30 THEN round_even(quantile_cont(x, .5) OVER w, 2) END AS rolling_median FROM c
        WINDOW w AS (PARTITION BY vessel_id ORDER BY wi, rid ROWS BETWEEN 200 PRECEDING AND 199 FOLLOWING)"""),
}
