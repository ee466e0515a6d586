"""Masked moments, sliding medians, wide scores, gap timers and density curves against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelson.operators import moments, ordered, profile, svd, windows


def test_correlations_of_forty_columns_with_gaps(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(3000, 5))
    x = base @ rng.normal(size=(5, 40)) + rng.normal(size=(3000, 40)) + 1e7         # a large offset costs no digits
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 7] = 3.0                                                                    # constant
    x[:, 8] = np.where(np.isnan(x[:, 9]), x[:, 8], 5.0)                              # constant where column 9 is there
    names = [f"c{i}" for i in range(40)]
    pdf = pd.DataFrame(x, columns=names)
    pdf["k"] = [None if i % 3 == 0 else "a" for i in range(3000)]
    df = spark.createDataFrame(pdf.astype({"k": object}).where(pdf.notna(), None), ", ".join(f"{n} double" for n in names) + ", k string").repartition(6)
    got = {(r.k, r.signal_a, r.signal_b): r for r in moments.pair_correlations(df, names, ["k"]).collect()}
    assert len(got) == 2 * 40 * 39 // 2
    for key in (None, "a"):
        own = pdf[pdf.k.isna() if key is None else pdf.k == key][names]
        want = own.corr()
        for (k, a, b), r in got.items():
            if k == key:
                both = own[[a, b]].dropna()
                assert (r.n, r.n_a, r.n_b) == (len(both), own[a].count(), own[b].count())
                if 7 in (int(a[1:]), int(b[1:])) or (a, b) == ("c8", "c9"):
                    assert r["corr"] is None
                else:
                    assert r["corr"] == pytest.approx(want.loc[a, b], abs=1e-9)
    assert moments.pair_correlations(df.where("false"), names, ["k"]).count() == 0


def test_moments_hand_on_many_keys(spark, monkeypatch):
    df = spark.range(2000).select((F.col("id") % 500).alias("k"), F.col("id").cast("double").alias("a"), (F.col("id") * F.col("id")).cast("double").alias("b"))
    got = {r.k: r["corr"] for r in moments.pair_correlations(df.repartition(3), ["a", "b"], ["k"]).collect()}
    pdf = df.toPandas()
    assert len(got) == 500 and all(got[k] == pytest.approx(g.a.corr(g.b)) for k, g in pdf.groupby("k"))


@pytest.mark.parametrize("rows,slice_rows", [(40, 60), (40, 10 ** 6), (6, 7)])
def test_rolling_median_equals_numpy(spark, rows, slice_rows, monkeypatch):
    rng = np.random.default_rng(3)
    data = [("ab"[i % 4 == 0], i, float(v) if rng.random() > 0.1 else None, float(w)) for i, (v, w) in enumerate(rng.normal(size=(700, 2)))]
    df = spark.createDataFrame(data, "vessel_id string, rid bigint, v double, w double")
    monkeypatch.setattr(ordered, "SLIDING_ROWS", slice_rows)
    got = {r.rid: r.rolling_median for r in windows.rolling_median_by(df, "v", "w", rows=rows, at_least=3).collect()}
    for key in "ab":
        own = sorted((w, i, v) for k, i, v, w in data if k == key)
        values = np.array([np.nan if v is None else v for _, _, v in own])
        limit = np.percentile(np.abs(values[~np.isnan(values)]), 99)
        clipped = np.clip(values, -limit, limit)
        for at, (_, i, _) in enumerate(own):
            near = clipped[max(0, at - rows // 2):at + rows // 2]
            near = near[~np.isnan(near)]
            assert got[i] == (pytest.approx(np.median(near)) if len(near) >= 3 else None)


@pytest.mark.parametrize("most", [svd.WIDE_NUMBERS, 0])
def test_wide_scores_by_block_products_and_by_join(spark, monkeypatch, most):
    monkeypatch.setattr(svd, "WIDE_NUMBERS", most)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 24))
    names = [f"e{i}" for i in range(24)]
    pdf = pd.DataFrame(x, columns=names).assign(cluster_id=[i % 3 for i in range(400)], rid=range(400))
    df = spark.createDataFrame(pdf)
    fitted = svd.svd_fit(df.where("cluster_id < 2"), names, 4)
    got = {r.rid: r.score_svd for r in svd.svd_score(df, ordered.settled(fitted), names, 4).collect()}
    for c in range(3):
        own = x[c::3]
        if c == 2:
            assert all(got[i] == np.inf for i in range(2, 400, 3))
            continue
        _, _, vt = np.linalg.svd(own, full_matrices=False)
        want = (own ** 2).sum(axis=1) - ((own @ vt[:4].T) ** 2).sum(axis=1)
        assert [got[i] for i in range(c, 400, 3)] == pytest.approx(want.tolist())


def test_density_curve_equals_numpy(spark):
    rng = np.random.default_rng(6)
    values = rng.gamma(2.0, 3.0, 4000)
    df = spark.createDataFrame([("s", float(v)) for v in values], "vessel_id string, v double").repartition(3)
    got = profile.kde_curve(df, ["v"], points=50, cells=20_000).orderBy("i").toPandas()
    lo, hi = np.percentile(values, [0.1, 99.9])
    x = np.clip(values, lo, hi)
    h = x.std(ddof=1) * (len(x) * 0.75) ** -0.2
    grid = np.linspace(lo, hi, 50)
    want = np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2).sum(axis=1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got["x"], grid) and np.allclose(got["density"], want, rtol=1e-4)


def test_gap_alerts_of_a_vessel_that_never_reports_again(spark, tmp_path):
    """`a` falls silent for good, `b` resumes, `c` goes on and moves the watermark; records come in two files, some late."""
    from keelson.streaming import live
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    first = [("a", at(0)), ("a", at(10)), ("b", at(5)), ("c", at(0)), ("c", at(12)), (None, at(3))]
    second = [("b", at(200)), ("b", at(5 + 20)), *[("c", at(12 + 30 * i)) for i in range(1, 14)]]
    schema = "vessel_id string, Date string"
    for n, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).select("vessel_id", F.col("Date").cast("timestamp_ntz")).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    source = (spark.readStream.schema("vessel_id string, Date timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
              .parquet(str(tmp_path / "in")))
    live.run_available(live.stream_gap_alert(source, 300), str(tmp_path / "out"), str(tmp_path / "progress"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    clock = lambda t: None if t is None else t.hour * 60 + t.minute
    got = {(r.vessel_id, r.status, clock(r.active_from), clock(r.gap_start), r.n_records, clock(r.gap_end)) for r in rows}
    # limit: 50 minutes; the last record is at 402, the watermark ten minutes before it
    assert got == {("a", "silent", 0, 10, 2, None), ("b", "silent", 5, 25, 2, None), ("b", "resumed", None, 25, None, 200),
                   ("b", "silent", 200, 200, 1, None), (None, "silent", 3, 3, 1, None)}
