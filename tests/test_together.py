"""Independent reports and fits run side by side, each with the caller's local properties."""

import threading

import pytest

from keelson import config as cfg
from keelson.plans import eda, jobs
from keelson.plans.together import together


def test_parts_run_side_by_side_in_order_with_the_callers_properties(spark):
    sc, meet = spark.sparkContext, threading.Barrier(3, timeout=60)
    sc.setLocalProperty("keelson.test", "kept")

    def part(i):
        meet.wait()                                              # passes only when all three run at once
        return i, sc.getLocalProperty("keelson.test"), spark.range(i).count()

    try:
        assert together(spark, [lambda i=i: part(i) for i in (3, 1, 2)]) == [(3, "kept", 3), (1, "kept", 1), (2, "kept", 2)]
    finally:
        sc.setLocalProperty("keelson.test", None)


def test_a_failing_part_raises(spark):
    with pytest.raises(ZeroDivisionError):
        together(spark, [lambda: 1, lambda: 1 // 0, lambda: 2])


def test_the_exploratory_run_writes_its_groups_side_by_side(spark, tmp_path, monkeypatch):
    meet = threading.Barrier(2, timeout=60)

    def group(name, n):
        def build():
            meet.wait()
            return {name: spark.range(n)}
        return build

    monkeypatch.setattr(eda, "load_raw", lambda s, path, config: s.range(5))
    monkeypatch.setattr(eda, "report_groups", lambda df, config: [group("a", 2), group("b", 3)])
    folder = eda.run_eda(spark, "stenaline", str(tmp_path))["folder"]
    assert [spark.read.parquet(f"{folder}/{n}").count() for n in ("normalised", "a", "b")] == [5, 2, 3]


def test_every_report_has_a_group_of_its_own_name(spark):
    names = [n for n in cfg.STENALINE.column_map.values() if n != "Date"]
    df = spark.createDataFrame([], "vessel_id string, rid bigint, " + ", ".join(f"`{n}` double" for n in dict.fromkeys(names)))
    assert len(eda.report_groups(df, cfg.STENALINE)) > 10


class Met(Exception):
    pass


def test_the_detectors_are_fitted_side_by_side(spark, tmp_path, monkeypatch):
    meet = threading.Barrier(2, timeout=30)

    def fit(*_):
        meet.wait()
        raise Met

    monkeypatch.setattr(jobs, "_cleaned", lambda s, run: (s.range(1), ["id"]))
    monkeypatch.setattr(jobs.modes, "kmeans_modes", lambda *_: None)
    monkeypatch.setattr(jobs, "fit_detector", fit)
    with pytest.raises(Met):
        jobs.stage_detect(spark, jobs.RunConfig("stenaline", str(tmp_path), methods=("svd", "iforest")))
