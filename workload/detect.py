"""Scaling, clustering, detector, vote and detector-report queries."""

from pyspark.sql import functions as F

from keelson import config as cfg
from keelson.operators import autoencoder as AE
from keelson.operators import detectors
from keelson.operators import ensemble as EN
from keelson.operators import iforest as IF
from keelson.operators import modes as M
from keelson.operators import normalize as N
from keelson.operators import svd as S

from .base import FEATURES, V, VS, rounded, scored, table, vessel
from .profiles import box_sql, unpivot_sql

FX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
METHODS = ["svd", "iforest", "autoencoder"]
LINES = """l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, ascii(l_returnflag) % 3 AS cluster_id,
  l_discount >= 0.1e0 AND l_tax >= 0.08e0 AS flag_any_constraint"""
SCALED = "(x - lo)"
L0 = f"""WITH li AS MATERIALIZED (SELECT {LINES} FROM lineitem),
mm AS (SELECT cluster_id, {', '.join(f'min({c}) AS {c}_lo, max({c}) AS {c}_hi' for c in FX)} FROM li GROUP BY 1),
sc AS MATERIALIZED (SELECT li.* EXCLUDE ({', '.join(FX)}), {', '.join(f'({c} - {c}_lo)/coalesce(nullif({c}_hi - {c}_lo, 0), 1) AS {c}' for c in FX)}
  FROM li JOIN mm USING (cluster_id))"""
SCORES = {"svd": "(l_quantity + l_extendedprice) / 2e0", "iforest": "(l_discount + l_extendedprice) / 2e0",
          "autoencoder": "(l_tax + l_quantity) / 2e0"}
L1 = f"""{L0}, so AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS score_{m}' for m, e in SCORES.items())} FROM sc),
th AS (SELECT cluster_id, {', '.join(f'quantile_cont(score_{m}, 0.95) AS t_{m}' for m in METHODS)} FROM so GROUP BY 1),
fl AS MATERIALIZED (SELECT so.*, {', '.join(f't_{m}, score_{m} > t_{m} AS is_{m}_anomaly' for m in METHODS)},
  CASE cluster_id WHEN 0 THEN 'Quiet' WHEN 1 THEN 'Returned' ELSE 'Cluster_' || cluster_id END AS cluster_name FROM so JOIN th USING (cluster_id)),
an AS MATERIALIZED (SELECT *, {' + '.join(f'is_{m}_anomaly::INT' for m in METHODS)} >= 2 AS is_ensemble_anomaly, score_svd AS anomaly_score,
  ({' + '.join(f'is_{m}_anomaly::INT' for m in METHODS)} >= 2) OR flag_any_constraint AS is_anomaly FROM fl)"""


def lines(s, d):
    from .base import _split
    return table(s, d, "lineitem").selectExpr(*[p.strip() for p in _split(LINES)])


def scaled_lines(s, d):
    return N.minmax_scale(lines(s, d), FX, ["cluster_id"])


def score_lines(s, d):
    df = scaled_lines(s, d)
    return df.withColumns({f"score_{m}": F.expr(e) for m, e in SCORES.items()})


def thresholds(df):
    return {m: EN.threshold_by_group(df, f"score_{m}") for m in METHODS}


def annotated(s, d):
    df = EN.flag_methods(score_lines(s, d), METHODS)
    names = cfg.local_table(s, [(0, "Quiet"), (1, "Returned")], "cluster_id int, cluster_name string")
    return EN.annotate(EN.lookup_cluster_names(df, names), METHODS)


ID = ["l_orderkey", "l_linenumber"]
CENTRES = [[1.0, 50.0, 6.0, 0.0], [4.0, 600.0, 5.0, 1.0], [9.0, 1500.0, 4.0, 0.0], [18.0, 3000.0, 7.0, -1.0]]
CF = ["GPSSpeed_kn", "Main_Engine_Power_kW", "Avg_draft_m", "Trim_m"]
LO, HI = [0.0, -200.0, -0.5, -6.5], [22.0, 20000.0, 9.5, 5.5]
FIXED = M.ModeModel(CF, CENTRES, LO, HI)
_d2 = [" + ".join(f"pow(({f} - {LO[i]})/{HI[i] - LO[i]}::DOUBLE - ({c[i]} - {LO[i]})/{HI[i] - LO[i]}::DOUBLE, 2)" for i, f in enumerate(CF)) for c in CENTRES]
ASSIGN = f"""{V}, ds AS (SELECT *, {', '.join(f'{e} AS d{k}' for k, e in enumerate(_d2))} FROM v),
 asg AS MATERIALIZED (SELECT *, CASE WHEN d0 IS NULL THEN NULL WHEN d0 <= least(d1, d2, d3) THEN 0 WHEN d1 <= least(d2, d3) THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS cluster_id FROM ds)"""


def _names(slow, power, prefix="Mode"):
    return f"""'{prefix}_' || cluster_id || CASE WHEN GPSSpeed_kn < 0.5 AND Main_Engine_Power_kW < 100 THEN CASE WHEN Avg_draft_m > 6.5 THEN '_AtRest_Loaded'
    ELSE '_AtRest_Unloaded' END WHEN GPSSpeed_kn < {slow} {power} THEN '_SlowSpeed' WHEN GPSSpeed_kn < 10 THEN '_MediumSpeed' ELSE '_HighSpeed' END"""


def _gram(s, d):
    g = S.gram(scaled_lines(s, d), FX)
    return rounded(g.select("cluster_id", "n", *[F.col(c) for c in g.columns if c[:2] in ("g_", "m_")]), 4)


def _svd_parts(s, d):
    df = scaled_lines(s, d)
    return df, S.settled(S.svd_fit(df, FX, 2))


def _svd_scored(s, d):
    df, comp = _svd_parts(s, d)
    return S.svd_score(df, comp, FX, 2)


SVD_ROWS = ID + ["cluster_id", "score_svd"]


def _vectors(s, d):
    return lines(s, d).drop("cluster_id").withColumn("rid", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


def _iforest(s, d):
    df = _vectors(s, d)
    return rounded(IF.IsolationForest.fit(df, FX, 3).transform(df).select(*ID, "cluster_id", "score_iforest", "is_iforest_anomaly"))


def _autoencoder(s, d):
    df = _vectors(s, d)
    return rounded(AE.Autoencoder.fit(df, FX, 3).transform(df).select(*ID, "cluster_id", "score_autoencoder", "is_autoencoder_anomaly"))


def _clustered(s, d):
    df = _vectors(s, d)
    return rounded(S.ClusteredSVD.fit(df, FX, 3).transform(df).select(*ID, "cluster_id", "score_svd", "is_svd_anomaly"))


def _saved(s, d):
    from .base import scratch
    df, path = _vectors(s, d), scratch(s)
    S.ClusteredSVD.fit(df, FX, 3).save(s, path)
    return rounded(detectors.load_detector(s, "svd", path).transform(df).select(*ID, "cluster_id", "score_svd", "is_svd_anomaly"))


def _applied(s, d):
    """A forest fitted on all rows, saved, loaded, and applied to them."""
    from .base import scratch
    df, path = _vectors(s, d), scratch(s)
    IF.IsolationForest.fit(df, FX, 3).save(s, path)
    return rounded(detectors.load_detector(s, "iforest", path).transform(df).select(*ID, "cluster_id", "score_iforest", "is_iforest_anomaly"))


def _kmeans(s, d):
    df = lines(s, d).drop("cluster_id")
    return M.kmeans_modes(df, FX, 3).assign(df).select(*ID, "cluster_id")


def _gmm(s, d, kind="full"):
    df = lines(s, d).drop("cluster_id")
    m = M.gmm_modes(df, FX, 3, kind)
    return rounded(M.gmm_summary(m.predict_proba(df), m), 4)


def _gmm_scores(s, d):
    m = M.gmm_modes(lines(s, d).drop("cluster_id"), FX, 3, "diag")
    x = m.scores()
    return cfg.local_table(s, [(float(x["aic"]), float(x["bic"]), bool(x["converged"]), int(x["n_iter"]))],
                           "aic double, bic double, converged boolean, n_iter int")


def _spectrum(s, d):
    """Mode assignment and SVD residual on the 64-wide embedding vectors."""
    df = table(s, d, "embeddings").select(F.col("vec_id").alias("rid"), F.lit(0).alias("cluster_id"),
                                          *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    cols = [f"e{i}" for i in range(64)]
    return rounded(S.svd_score(df, S.settled(S.svd_fit(df, cols, 8)), cols, 8).select("rid", "score_svd"))


QUERIES = {
    "minmax_scale": (lambda s, d: rounded(scaled_lines(s, d).select(*ID, "cluster_id", *FX)),
                     f"{L0} SELECT l_orderkey, l_linenumber, cluster_id, {', '.join(f'round_even({c}, 6) AS {c}' for c in FX)} FROM sc"),
    "minmax_scale_global": (
        lambda s, d: rounded(N.minmax_scale(lines(s, d), FX).select(*ID, *FX)),
        f"""WITH m AS (SELECT {', '.join(f'min({c}) AS {c}_lo, max({c}) AS {c}_hi' for c in FX)} FROM lineitem)
        SELECT l_orderkey, l_linenumber, {', '.join(f'round_even((l.{c} - {c}_lo)/({c}_hi - {c}_lo), 6) AS {c}' for c in FX)} FROM lineitem l, m"""),
    "inverse_minmax": (
        lambda s, d: rounded(N.inverse_minmax(scaled_lines(s, d), N.fit_minmax(lines(s, d), FX, ["cluster_id"]), FX, ["cluster_id"]).select(*ID, *FX), 4),
        f"SELECT l_orderkey, l_linenumber, {', '.join(f'round_even({c}, 4) AS {c}' for c in FX)} FROM lineitem"),
    "assign_modes": (lambda s, d: FIXED.assign(vessel(s, d)).select("rid", "cluster_id"), f"{ASSIGN} SELECT rid, cluster_id FROM asg"),
    "mode_names": (
        lambda s, d: rounded(_named(s, d)),
        f"""{ASSIGN}, c AS (SELECT cluster_id, avg(GPSSpeed_kn) AS GPSSpeed_kn, avg(Main_Engine_Power_kW) AS Main_Engine_Power_kW, avg(Avg_draft_m) AS Avg_draft_m
        FROM asg WHERE cluster_id IS NOT NULL GROUP BY 1)
        SELECT cluster_id, {_names(3, 'AND Main_Engine_Power_kW < 500')} AS name FROM c"""),
    "mode_names_by_mean": (
        lambda s, d: rounded(M.mode_names_by_mean(FIXED.assign(vessel(s, d)).where("cluster_id IS NOT NULL"), CF), 4),
        f"""{ASSIGN}, c AS (SELECT cluster_id, {', '.join(f'avg({f}) AS {f}' for f in CF)} FROM asg WHERE cluster_id IS NOT NULL GROUP BY 1)
        SELECT cluster_id, {', '.join(f'round_even({f}, 4) AS {f}' for f in CF)}, {_names(5, '')} AS name FROM c"""),
    "cluster_summary": (
        lambda s, d: rounded(M.cluster_summary(FIXED.assign(vessel(s, d)), FIXED)),
        f"""{ASSIGN}, n AS (SELECT cluster_id, count(*) AS count FROM asg WHERE cluster_id IS NOT NULL GROUP BY 1),
        c AS (SELECT * FROM (VALUES {', '.join(f"({k}, {', '.join(f'{x}::DOUBLE' for x in c)})" for k, c in enumerate(CENTRES))}) t(cluster_id, {', '.join(CF)}))
        SELECT cluster_id, {', '.join(f'{f} AS center_{f}' for f in CF)}, {_names(3, 'AND Main_Engine_Power_kW < 500')} AS name,
        coalesce(count, 0) AS count, round_even(coalesce(count, 0)/(SELECT sum(count) FROM n)*100, 6) AS percentage FROM c LEFT JOIN n USING (cluster_id)"""),
    "kmeans_modes": (_kmeans, None),
    "gmm_modes": (_gmm, None),
    "gmm_modes_spherical": (lambda s, d: _gmm(s, d, "spherical"), None),
    "gmm_scores": (_gmm_scores, None),
    "svd_gram": (
        _gram, f"""{L0} SELECT cluster_id, count(*) AS n, {', '.join(f'round_even(sum({FX[i]}*{FX[j]}), 4) AS g_{i}_{j}' for i in range(4) for j in range(i, 4))},
        {', '.join(f'round_even(avg({c}), 4) AS m_{i}' for i, c in enumerate(FX))} FROM sc GROUP BY 1"""),
    "svd_fit": (lambda s, d: rounded(_svd_parts(s, d)[1].select("cluster_id", "n", F.posexplode("v").alias("i", "value"))), None),
    "svd_score": (lambda s, d: rounded(_svd_scored(s, d).select(*SVD_ROWS)), None),
    "svd_predict": (lambda s, d: _predict(s, d), None),
    "svd_explained_variance": (lambda s, d: rounded(S.explained_variance(_svd_parts(s, d)[1])), None),
    "svd_wide_vectors": (_spectrum, None),
    "clustered_svd": (_clustered, None),
    "isolation_forest": (_iforest, None),
    "autoencoder": (_autoencoder, None),
    "model_save_load": (_saved, None),
    "apply_saved_model": (_applied, None),
    "threshold_by_group": (
        lambda s, d: rounded(EN.threshold_by_group(score_lines(s, d), "score_svd")),
        f"{L1} SELECT cluster_id, round_even(any_value(t_svd), 6) AS threshold FROM fl GROUP BY 1"),
    "cluster_param_lookup": (
        lambda s, d: _lookup(s, d),
        f"{L1} SELECT l_orderkey, l_linenumber, CASE WHEN cluster_id = 2 THEN false ELSE is_svd_anomaly END AS hit FROM fl"),
    "cluster_name_lookup": (
        lambda s, d: annotated(s, d).select(*ID, "cluster_id", "cluster_name"), f"{L1} SELECT l_orderkey, l_linenumber, cluster_id, cluster_name FROM fl"),
    "majority_vote": (lambda s, d: annotated(s, d).select(*ID, "is_ensemble_anomaly"), f"{L1} SELECT l_orderkey, l_linenumber, is_ensemble_anomaly FROM an"),
    "annotate": (
        lambda s, d: rounded(annotated(s, d).select(*ID, "cluster_id", "cluster_name", "anomaly_score", "is_ensemble_anomaly", "is_anomaly",
                                                    *[c for m in METHODS for c in (f"is_{m}_anomaly", f"score_{m}")])),
        f"""{L1} SELECT l_orderkey, l_linenumber, cluster_id, cluster_name, round_even(anomaly_score, 6) AS anomaly_score, is_ensemble_anomaly, is_anomaly,
        {', '.join(f'is_{m}_anomaly, round_even(score_{m}, 6) AS score_{m}' for m in METHODS)} FROM an"""),
    "scatter_back_valid_rows": (
        lambda s, d: rounded(_scatter(s, d)),
        f"""{V} SELECT rid, CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} THEN CAST(rid % 4 AS INT) ELSE -1 END AS cluster_id,
        CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} THEN 'M' || (rid % 4) ELSE 'Unknown' END AS cluster_name,
        coalesce({' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} AND GPSSpeed_kn > 15, false) AS is_svd_anomaly,
        CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in FEATURES)} THEN round_even(GPSSpeed_kn, 6) END AS score_svd FROM v"""),
    "constraint_recall": (
        lambda s, d: rounded(EN.constraint_recall(annotated(s, d), METHODS, ["cluster_id"])),
        f"{L1} " + " UNION ALL ".join(
            f"SELECT cluster_id, '{m}' AS method, round_even(coalesce(avg(is_{m}_anomaly::INT) FILTER (flag_any_constraint), 0), 6) AS recall FROM an GROUP BY 1"
            for m in [*METHODS, "ensemble"])),
    "detection_summary": (
        lambda s, d: _summary(s, d),
        f"""{L1} SELECT cluster_id, cluster_name, count(*) AS total, {', '.join(f'count(*) FILTER (is_{m}_anomaly) AS {m}_anomalies' for m in [*METHODS, 'ensemble'])},
        {', '.join(f'round_even(count(*) FILTER (is_{m}_anomaly)/count(*)*100, 2) AS {m}_rate_pct' for m in [*METHODS, 'ensemble'])},
        {', '.join(f'round_even(any_value(t_{m}), 6) AS {m}_threshold' for m in METHODS)} FROM an GROUP BY 1, 2"""),
    "method_comparison": (
        lambda s, d: EN.method_comparison(annotated(s, d), METHODS),
        f"{L1} " + " UNION ALL ".join(
            f"""SELECT '{m}' AS method, count(*) FILTER (is_{m}_anomaly) AS n_anomalies, round_even(avg(is_{m}_anomaly::INT)*100, 3) AS anomaly_rate,
            round_even(coalesce(avg(is_{m}_anomaly::INT) FILTER (flag_any_constraint), 0)*100, 1) AS recall_known, round_even(avg(score_{m}), 6) AS avg_score,
            round_even(max(score_{m}), 6) AS max_score, 0e0 AS fit_time_sec FROM an""" for m in METHODS)),
    "pairwise_agreement": (
        lambda s, d: rounded(EN.pairwise_agreement(annotated(s, d), METHODS)),
        f"{L1} " + " UNION ALL ".join(
            f"SELECT '{a}' AS method_a, '{b}' AS method_b, round_even(avg((is_{a}_anomaly = is_{b}_anomaly)::INT)*100, 6) AS agreement_pct FROM an"
            for a in METHODS for b in METHODS)),
    "avg_threshold": (
        lambda s, d: rounded(EN.avg_threshold(thresholds(score_lines(s, d)))),
        f"{L1} SELECT round_even(avg(t), 6) AS avg_threshold FROM (SELECT cluster_id, any_value(t_svd) AS t FROM fl GROUP BY 1)"),
    "saving_threshold": (
        lambda s, d: rounded(EN.saving_threshold(annotated(s, d))),
        f"{L1} SELECT round_even(coalesce(quantile_cont(anomaly_score, 0.05), 0.1), 6) AS threshold FROM an WHERE is_anomaly"),
    "feature_box_normal_vs_anomaly": (
        lambda s, d: rounded(EN.feature_box_normal_vs_anomaly(scored(s, d), FEATURES)),
        f"""{VS}, bl AS ({unpivot_sql(FEATURES, 'a', "vessel_id, CASE WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS label")}),
        {box_sql('bl', 'vessel_id, signal, label')} SELECT * FROM bb"""),
    "cluster_anomaly_rate": (
        lambda s, d: EN.cluster_anomaly_rate(annotated(s, d)),
        f"""{L1} SELECT cluster_name, count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (NOT is_anomaly) AS normal,
        round_even(count(*) FILTER (is_anomaly)/count(*)*100, 2) AS anomaly_rate FROM an GROUP BY 1"""),
    "spatial_score_table": (
        lambda s, d: rounded(EN.spatial_score_table(scored(s, d))),
        f"""{VS}, p AS (SELECT vessel_id, quantile_cont(anomaly_score, .05) AS a, quantile_cont(anomaly_score, .99) AS b FROM a GROUP BY 1)
        SELECT vessel_id, rid, round_even(GPS_LAT, 6) AS GPS_LAT, round_even(GPS_LON, 6) AS GPS_LON, round_even(anomaly_score, 6) AS score, cluster_name, is_anomaly,
        round_even(p.a, 6) AS score_p05, round_even(p.b, 6) AS score_p99 FROM a JOIN p USING (vessel_id)"""),
    "power_speed_fuel_diag": (
        lambda s, d: rounded(EN.power_speed_fuel_diag(scored(s, d))),
        f"""{VS}, r AS (SELECT * FROM a WHERE GPSSpeed_kn IS NOT NULL AND Main_Engine_Power_kW IS NOT NULL),
        p AS (SELECT vessel_id, quantile_cont(anomaly_score, .05) AS a, quantile_cont(anomaly_score, .97) AS b FROM r WHERE Fuel_Consumption_t_per_day IS NOT NULL GROUP BY 1)
        SELECT vessel_id, rid, {', '.join(f'round_even({c}, 6) AS {c}' for c in ('GPSSpeed_kn', 'Main_Engine_Power_kW', 'Fuel_Consumption_t_per_day', 'anomaly_score'))},
        is_anomaly, round_even(p.a, 6) AS score_p05, round_even(p.b, 6) AS score_p97 FROM r JOIN p USING (vessel_id)"""),
    "flagged_series": (
        lambda s, d: rounded(EN.flagged_series(scored(s, d), FEATURES)),
        f"{VS} " + " UNION ALL ".join(
            f"SELECT vessel_id, rid, Date, is_anomaly, '{c}' AS signal, round_even({c}, 6) AS value FROM a" for c in FEATURES)),
    "cluster_pair_table": (
        lambda s, d: rounded(EN.cluster_pair_table(scored(s, d))),
        f"{VS} " + " UNION ALL ".join(
            f"SELECT vessel_id, rid, cluster_name, is_anomaly, '{x}|{y}' AS pair, round_even({x}, 6) AS x, round_even({y}, 6) AS y FROM a"
            for x, y in EN.PAIRS if x != "Speed_rpm")),
    "score_histogram": (
        lambda s, d: rounded(EN.score_histogram(annotated(s, d), METHODS, overflow=False), 5),
        f"{L1}, r AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, score_{m} AS s, is_{m}_anomaly AS hit FROM an" for m in METHODS) + """),
        c AS (SELECT method, quantile_cont(s, .95) AS p95, quantile_cont(s, .995) AS cap FROM r GROUP BY 1),
        b AS (SELECT r.method, CASE WHEN hit THEN 'anomaly' ELSE 'normal' END AS label, CAST(least(floor(s/(cap/69)), 68) AS INT) AS bin, cap/69 AS w, p95
          FROM r JOIN c USING (method) WHERE s BETWEEN 0 AND cap),
        n AS (SELECT method, label, bin, count(*) AS count, any_value(w) AS w, any_value(p95) AS p95 FROM b GROUP BY 1, 2, 3)
        SELECT method, label, bin, round_even(bin*w, 5) AS bin_lo, count, round_even(count/(sum(count) OVER (PARTITION BY method, label)*w), 5) AS density,
        round_even(p95, 5) AS p95 FROM n"""),
}


def _named(s, d):
    rows = FIXED.assign(vessel(s, d)).where("cluster_id IS NOT NULL")
    means = rows.groupBy("cluster_id").agg(*[F.avg(f).alias(f) for f in CF[:3]])
    return M.mode_names(means, CF[:3]).select("cluster_id", "name")


def _predict(s, d):
    scored_rows = _svd_scored(s, d)
    return S.svd_predict(scored_rows, EN.threshold_by_group(scored_rows, "score_svd")).select(*ID, "is_svd_anomaly")


def _lookup(s, d):
    df = score_lines(s, d)
    known = EN.threshold_by_group(df, "score_svd").where("cluster_id <> 2")
    return EN.apply_thresholds(df, known, "score_svd", "hit").select(*ID, "hit")


def _scatter(s, d):
    v = vessel(s, d)
    from keelson.operators.flags import complete
    part = v.where(complete(FEATURES)).select(
        "rid", (F.col("rid") % 4).cast("int").alias("cluster_id"), F.concat(F.lit("M"), (F.col("rid") % 4).cast("string")).alias("cluster_name"),
        (F.col("GPSSpeed_kn") > 15).alias("is_svd_anomaly"), F.col("GPSSpeed_kn").alias("score_svd"))
    return EN.scatter_back(v, part, ["svd"]).select("rid", "cluster_id", "cluster_name", "is_svd_anomaly", "score_svd")


def _summary(s, d):
    df = annotated(s, d)
    t = {m: EN.threshold_by_group(df, f"score_{m}") for m in METHODS}
    return rounded(EN.detection_summary(df, METHODS, t))
