"""Files in, result tables out."""

import zipfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelson import config as cfg
from keelson.plans import jobs
from keelson.sources import files, store as st


def test_discovery_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.discover_files(spark, str(tmp_path / "nowhere"))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        files.discover_files(spark, str(tmp_path / "a.txt"))
    with pytest.raises(FileNotFoundError):
        files.discover_files(spark, str(tmp_path))


def test_load_raw_mixed_layouts(spark, tmp_path):
    from workload.sources import _workbook
    base = tmp_path / "grimaldi"
    base.mkdir()
    (base / "1.csv").write_text('Time stamp,LATITUDE,"DRAFTAFT[m]",DRAFTFOR[m]\n2024-08-01 00:00:13.440,0.9,6.0,5.0\n01/07/2024 00:05,,  ,5.0\n')
    (base / "2.csv").write_text("Time stamp,SHAFT POWER[kW],Extra\n2024-08-02 00:00:00,12 kW,x1\n")
    (base / "3.csv").write_text("")
    (base / "4.xlsx").write_bytes(_workbook(pd.DataFrame({"Time stamp": [pd.Timestamp("2024-08-03 12:00:00")], "SHAFT POWER[kW]": [150.5]})))
    (base / "5.xlsx").write_bytes(b"not a zip")
    with pytest.warns(UserWarning):
        df = files.load_raw(spark, str(base))
    rows = df.orderBy("rid").collect()
    assert [r["source_file"] for r in rows] == ["1.csv", "1.csv", "2.csv", "4.xlsx"]
    assert rows[0]["Date"] == datetime(2024, 8, 1, 0, 0, 13, 440000) and rows[1]["Date"] == datetime(2024, 7, 1, 0, 5)
    assert rows[0]["Avg_draft_m"] == 5.5 and rows[1]["DRAFTAFT"] is None and rows[2]["Main_Engine_Power_kW"] is None
    assert rows[3]["Main_Engine_Power_kW"] == 150.5 and rows[3]["Date"] == datetime(2024, 8, 3, 12)
    assert {r["path"].rsplit("/", 1)[1] for r in files.skipped_files(spark, str(base)).collect()} == {"3.csv", "5.xlsx"}


def test_all_files_unreadable(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    with pytest.raises(RuntimeError), pytest.warns(UserWarning):
        files.load_raw(spark, str(tmp_path))


def test_store_round_trip(spark, tmp_path):
    store = st.ResultStore(spark, str(tmp_path / "db")).create().create()
    rows = spark.createDataFrame([(datetime(2024, 1, 1), 2.0, -1.0, 9.0), (datetime(2024, 1, 2), None, 5.0, 0.0)],
                                 "Date timestamp_ntz, anomaly_score double, Main_Engine_Power_kW double, Trim_m double")
    assert store.append_anomalies(rows, 0.7) == 2 and store.append_anomalies(rows.limit(1), 0.7) == 1
    assert sorted(r["id"] for r in store.read("anomalies").collect()) == [1, 2, 3]
    assert store.append_detection_run("m", "f", 3, 2, 0.7, 3, 95.0) == 1 and store.append_detection_run("m", "f", 3, 2, 0.7, 3, 95.0) == 2
    store.mark_reviewed(store.read("anomalies").where("anomaly_type = 'multivariate_outlier'").select("id"), "fine")
    done = store.anomalies().where("reviewed = 1").collect()
    assert len(done) == 1 and done[0]["notes"] == "fine" and done[0]["anomaly_score"] == 0.7
    assert store.unreviewed().count() == 2 and store.of_type("extreme_trim").count() == 2
    with pytest.raises(ValueError):
        store.clear_anomalies()
    store.clear_anomalies(confirm=True)
    assert store.anomalies().count() == 0


def test_writers_at_the_same_time_get_different_ids(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    st.ResultStore(spark, str(tmp_path / "db")).create()
    rows = spark.range(40).select(F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id % 7)").alias("Date"), F.lit(1.0).alias("anomaly_score"),
                                  F.col("id").cast("double").alias("Trim_m")).repartition(5)
    with ThreadPoolExecutor(6) as pool:
        counts = list(pool.map(lambda i: st.ResultStore(spark, str(tmp_path / "db")).append_anomalies(rows.where(f"Trim_m < {30 + i}"), 0.5), range(6)))
        runs = list(pool.map(lambda i: st.ResultStore(spark, str(tmp_path / "db")).append_detection_run("m", "f", 1, 1, 0.5, 3, 95.0), range(6)))
    assert counts == [30 + i for i in range(6)] and sorted(runs) == [1, 2, 3, 4, 5, 6]
    store = st.ResultStore(spark, str(tmp_path / "db"))
    found = [r["id"] for r in store.read("anomalies").orderBy("id").collect()]
    assert found == list(range(1, sum(counts) + 1))
    first = store.read("anomalies").where("id <= 30").orderBy("id").collect()
    assert [r["data_timestamp"] for r in first] == sorted(r["data_timestamp"] for r in first)


def test_stage_fallback(spark, tmp_path):
    made = []
    st.stage_or(spark, str(tmp_path / "none"), lambda: made.append(1))
    assert made == [1]
    with pytest.raises(ValueError):
        jobs.stage_detect(spark, jobs.RunConfig(_folder(spark, tmp_path), str(tmp_path / "r"), methods=()))


def _folder(spark, tmp_path):
    path = tmp_path / "default_data"
    path.mkdir(exist_ok=True)
    lines = ["Date,GPSSpeed_kn,Main_Engine_Power_kW,Avg_draft_m,Trim_m"] + [
        f"2024-01-01 00:{i // 60:02d}:{i % 60:02d},{i % 17},{(i * 37) % 3000},{5 + i % 3},{i % 4 - 2}" for i in range(600)]
    (path / "a.csv").write_text("\n".join(lines))
    return str(path)


def test_whole_run(spark, tmp_path):
    run = jobs.RunConfig(_folder(spark, tmp_path), str(tmp_path / "out"), skip_eda=True, skip_metadata=True, n_clusters=2, restarts=1, trees=10, epochs=1)
    out = jobs.run_all(spark, run)
    assert list(out) == ["03_cleaning", "04_clustering", "05_detection", "06_classification", "07_saving"]
    assert out["07_saving"]["n_anomalies_logged"] == out["06_classification"]["n_anomalies"] > 0
    names = [r["name"] for r in spark.read.json(run.folder("cluster_names")).collect()]
    assert len(names) == 2 and all(n.startswith("Mode_") for n in names)


def test_load_raw_numbers_rows_and_reads_odd_names(spark, tmp_path):
    from workload.sources import _workbook
    base = tmp_path / "grimaldi"
    base.mkdir()
    names = ["a b.csv", "c[1].csv", "ü+%20.csv", "z.csv"]
    for n, name in enumerate(names):
        rows = "".join(f"2024-08-0{n + 1} 00:{i // 60:02d}:{i % 60:02d},{i}\n" for i in range(50))
        (base / name).write_text("Time stamp,LATITUDE\n" + rows)
    (base / "d.xlsx").write_bytes(_workbook(pd.DataFrame({"Time stamp": [pd.Timestamp("2024-08-03 12:00:00")] * 3, "SHAFT POWER[kW]": [1.0, 2.0, 3.0]})))
    (base / "e.xls").write_bytes(b"old")
    (base / "f.csv").write_text("")
    with pytest.warns(UserWarning):
        rows = files.load_raw(spark, str(base)).orderBy("rid").collect()
    assert [r["rid"] for r in rows] == list(range(203))
    order = sorted([*names, "d.xlsx"], key=str.encode)
    assert [r["source_file"] for r in rows] == [n for n in order for _ in range(3 if n == "d.xlsx" else 50)]
    assert all(r["GPS_LAT"] == i for n in names for i, r in enumerate(x for x in rows if x["source_file"] == n))


@pytest.mark.parametrize("before,after", [(12, 3), (1, 9)])
def test_row_numbers_do_not_depend_on_the_scan(spark, tmp_path, before, after):
    """The numbers of a table loaded under one packing of the files are the same when it is computed under another."""
    base = tmp_path / "grimaldi"
    base.mkdir()
    for n in range(24):
        # uneven files, two layouts; file 7 is cut into several splits
        rows = "".join(f"2024-08-01 00:00:00,{n * 10_000 + i}\n" for i in range(3000 if n == 7 else 20 + n % 3))
        (base / f"{n:02d}.csv").write_text(("Time stamp,LATITUDE\n" if n % 2 else "Time stamp,\"Depth, m\"\n") + rows)
    settings = {"spark.sql.leafNodeDefaultParallelism": str(before), "spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "500"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = files.load_raw(spark, str(base))
        assert spark.read.csv(str(base / "07.csv")).rdd.getNumPartitions() > 1
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(after))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
        value = F.coalesce("GPS_LAT", F.col("`Depth, m`").cast("double"))
        got = [(r["rid"], r["v"]) for r in df.select("rid", value.alias("v")).orderBy("rid").collect()]
    finally:
        for k in settings:
            spark.conf.unset(k)
    want = [n * 10_000 + i for n in range(24) for i in range(3000 if n == 7 else 20 + n % 3)]
    assert got == list(enumerate(map(float, want)))


def test_columns_are_read_by_name(spark, tmp_path):
    (tmp_path / "1.csv").write_text("LAT,LONG\n1,2\n")
    (tmp_path / "2.csv").write_text("LONG,LAT,Other\n20,10,x\n")
    (tmp_path / "3.csv").write_text("LAT\n5\n")
    got = files.scan_columns_glob(spark, str(tmp_path), "*.csv", ["LAT", "LONG"]).collect()
    assert {tuple(r) for r in got} == {("1", "2"), ("10", "20"), ("5", None)}


def test_detection_without_the_cleaning_stage_keeps_incomplete_rows(spark, tmp_path):
    folder = _folder(spark, tmp_path)
    with open(f"{folder}/more.csv", "w") as f:
        f.write("Date,GPSSpeed_kn,Main_Engine_Power_kW,Avg_draft_m,Trim_m\n2024-01-02 00:00:00,5,,6,1\n2024-01-02 00:01:00,5,,6,9\n")
    run = jobs.RunConfig(folder, str(tmp_path / "r"), methods=("svd",), n_clusters=2, restarts=1)
    jobs.stage_detect(spark, run)
    rows = spark.read.parquet(run.folder("annotated")).where("Main_Engine_Power_kW IS NULL").orderBy("Trim_m").collect()
    assert [(r["cluster_id"], r["cluster_name"], r["is_svd_anomaly"], r["is_anomaly"]) for r in rows] == [(-1, "Unknown", False, False), (-1, "Unknown", False, True)]
