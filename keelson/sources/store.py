"""Result tables as Parquet folders: append-only facts, reviews as a second append-only table.

Every append is a run with a folder of its own below the table. A run claims a range of ids, one for each of its rows, by creating
a file named after the range's first id; creation fails if another writer was faster, who then is waited for. So ids are
gapless over all runs that finish, whoever writes at the same time. (The file system must refuse to create a file twice, as HDFS
and local ones do.)
"""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from py4j.protocol import Py4JJavaError

from ..functions.columns import half_even
from ..operators.classify import db_type
from ..operators.flags import missing_reason
from ..operators.ordered import with_position
from .files import file_system, path_exists

CLAIM_SECONDS = 60

SENSORS = ("GPSSpeed_kn", "GPS_LAT", "GPS_LON", "Main_Engine_Power_kW", "Speed_rpm", "Fuel_Consumption_t_per_day", "Avg_draft_m",
           "Trim_m", "TrueWindSpeed_kn", "RelWindSpeed_kn")
_S = ", ".join(f"{c} double" for c in SENSORS)
TABLES = {
    "anomalies": "id bigint, detection_timestamp timestamp, data_timestamp timestamp_ntz, anomaly_score double, threshold double, "
                 f"model_version string, {_S}, anomaly_type string, primary_type string, cluster_name string, reviewed int, notes string",
    "detection_runs": "id bigint, run_timestamp timestamp, model_version string, data_file string, total_records bigint, "
                      "anomalies_detected bigint, threshold double, n_components int, threshold_percentile double",
    "missing_records": "id bigint, logged_timestamp timestamp, data_timestamp timestamp_ntz, reason string, missing_columns string, "
                       f"source_file string, {_S}, DRAFTFWD double, DRAFTAFT double",
    "reviews": "id bigint, notes string, reviewed_at timestamp",
}


def _sensor(df: DataFrame, c: str):
    return (F.col(c).try_cast("double") if c in df.columns else F.lit(None).cast("double")).alias(c)


class ResultStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def create(self) -> "ResultStore":
        """Create the tables that are not there yet."""
        for name, ddl in TABLES.items():
            if not path_exists(self.spark, self.path(name)):
                self.spark.createDataFrame([], ddl).coalesce(1).write.parquet(self.path(name))
        return self

    def read(self, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).option("recursiveFileLookup", True).parquet(self.path(table))

    def _claim(self, table: str, n: int) -> int:
        """The first of n ids that no other run has or will get."""
        folder, fs = file_system(self.spark, f"{self.root}/_claims/{table}")
        fs.mkdirs(folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        deadline = time.time() + CLAIM_SECONDS
        while time.time() < deadline:
            last = max((status.getPath().getName() for status in fs.listStatus(folder)), default=None)
            end = self._claimed_end(fs, path(folder, last)) if last else 1
            if end is not None and self._create(fs, path(folder, f"{end:020d}"), end + max(n, 1)):
                return end
            time.sleep(0.05)                        # another run was faster, or has not said yet how many ids it takes
        raise TimeoutError(f"the last claim in {folder} was not finished within {CLAIM_SECONDS} s")

    @staticmethod
    def _create(fs, claim, end: int) -> bool:
        """Create the claim with the end of its range; False if it is there already."""
        if fs.getScheme() == "file":                # Hadoop's local file system looks first and creates then
            try:
                handle = os.open(claim.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(handle, "wb") as out:
                out.write(end.to_bytes(8, "big"))
            return True
        try:
            out = fs.create(claim, False)
        except Py4JJavaError:
            if fs.exists(claim):
                return False
            raise
        out.writeLong(end)
        out.close()
        return True

    @staticmethod
    def _claimed_end(fs, claim):
        if fs.getFileStatus(claim).getLen() < 8:
            return None
        held = fs.open(claim)
        try:
            return held.readLong()
        finally:
            held.close()

    def _write(self, rows: DataFrame, table: str, run: str) -> None:
        names = [c.split(" ")[0] for c in TABLES[table].split(", ")]
        rows.select(*names).write.parquet(f"{self.path(table)}/run-{run}")

    def _append(self, rows: DataFrame, table: str, order) -> int:
        """Number the rows in `order` inside the run, claim that many ids, and write. Returns the row count."""
        placed = with_position(rows, [], [*order, F.xxhash64(*[F.col(c) for c in rows.columns])])
        n = placed.count()
        first = self._claim(table, n)
        self._write(placed.withColumn("id", F.col("_pos") + first), table, f"{first:020d}")
        return n

    def append_detection_run(self, model_version: str, data_file: str, total_records: int, anomalies_detected: int, threshold: float,
                             n_components: int, threshold_percentile: float) -> int:
        run_id = self._claim("detection_runs", 1)
        row = self.spark.range(1).select(
            F.lit(run_id).cast("bigint").alias("id"), F.current_timestamp().alias("run_timestamp"), F.lit(model_version).alias("model_version"),
            F.lit(data_file).alias("data_file"), F.lit(total_records).cast("bigint").alias("total_records"),
            F.lit(anomalies_detected).cast("bigint").alias("anomalies_detected"), F.lit(float(threshold)).alias("threshold"),
            F.lit(n_components).alias("n_components"), F.lit(float(threshold_percentile)).alias("threshold_percentile"))
        self._write(row.coalesce(1), "detection_runs", f"{run_id:020d}")
        return run_id

    def append_anomalies(self, anomalies: DataFrame, threshold: float, model_version: str = "svd_v1") -> int:
        """Project anomalous rows to the table; the stored type is the three-rule one. Returns the row count."""
        optional = {c: (F.col(c) if c in anomalies.columns else F.lit(None).cast("string")) for c in ("primary_type", "cluster_name")}
        rows = anomalies.select(
            F.current_timestamp().alias("detection_timestamp"),
            F.col("Date").cast("timestamp_ntz").alias("data_timestamp"), F.coalesce("anomaly_score", F.lit(float(threshold))).alias("anomaly_score"),
            F.lit(float(threshold)).alias("threshold"), F.lit(model_version).alias("model_version"),
            *[_sensor(anomalies, c) for c in SENSORS], db_type(anomalies.columns).alias("anomaly_type"),
            *[e.alias(c) for c, e in optional.items()], F.lit(0).alias("reviewed"), F.lit(None).cast("string").alias("notes"))
        return self._append(rows, "anomalies", ["data_timestamp"])

    def append_missing_records(self, missing: DataFrame, features) -> int:
        source = F.col("source_file") if "source_file" in missing.columns else F.lit(None).cast("string")
        rows = missing_reason(missing, features).select(
            F.current_timestamp().alias("logged_timestamp"),
            F.col("Date").cast("timestamp_ntz").alias("data_timestamp"), "reason", "missing_columns", source.alias("source_file"),
            *[_sensor(missing, c) for c in (*SENSORS, "DRAFTFWD", "DRAFTAFT")])
        return self._append(rows, "missing_records", ["data_timestamp"])

    def mark_reviewed(self, ids: DataFrame, notes: str | None = None) -> int:
        """Record a review of the ids (a DataFrame with an `id` column); Parquet rows are never updated in place."""
        rows = ids.select("id", F.lit(notes).cast("string").alias("notes"), F.current_timestamp().alias("reviewed_at"))
        run = uuid.uuid4().hex
        self._write(rows, "reviews", run)
        return self.spark.read.parquet(f"{self.path('reviews')}/run-{run}").count()

    def anomalies(self) -> DataFrame:
        """Anomalies with the outcome of their reviews: the latest non-empty note wins."""
        latest = self.read("reviews").groupBy("id").agg(
            F.max_by("notes", F.when(F.col("notes").isNotNull(), F.col("reviewed_at"))).alias("_notes"))
        marked = latest.withColumn("_r", F.lit(1))
        return self.read("anomalies").join(marked, "id", "left").withColumns(
            {"reviewed": F.coalesce("_r", "reviewed"), "notes": F.coalesce("_notes", "notes")}).drop("_r", "_notes")

    def clear_anomalies(self, confirm: bool = False) -> None:
        if not confirm:
            raise ValueError("clearing the anomalies needs confirm=True")
        for name in ("anomalies", "reviews"):
            self.spark.createDataFrame([], TABLES[name]).coalesce(1).write.mode("overwrite").parquet(self.path(name))

    def anomaly_summary(self) -> DataFrame:
        return self.anomalies().groupBy("anomaly_type").agg(
            F.count(F.lit(1)).alias("count"), F.avg("anomaly_score").alias("avg_score"), F.min("anomaly_score").alias("min_score"),
            F.max("anomaly_score").alias("max_score"), F.min("data_timestamp").alias("first_seen"), F.max("data_timestamp").alias("last_seen"),
            F.sum("reviewed").alias("reviewed_count")).orderBy(F.desc("count"))

    def missing_records_summary(self) -> DataFrame:
        return self.read("missing_records").groupBy("reason", "missing_columns").agg(
            F.count(F.lit(1)).alias("count"), F.min("data_timestamp").alias("first_seen"),
            F.max("data_timestamp").alias("last_seen")).orderBy(F.desc("count"))

    def missing_records(self) -> DataFrame:
        return self.read("missing_records").orderBy("data_timestamp")

    def top_anomalies(self, limit: int | None = None) -> DataFrame:
        out = self.anomalies().orderBy(F.desc("anomaly_score"), "data_timestamp", "id")
        return out.limit(limit) if limit else out

    def unreviewed(self, limit: int | None = None) -> DataFrame:
        out = self.anomalies().where("reviewed = 0").orderBy(F.desc("anomaly_score"), "data_timestamp", "id")
        return out.limit(limit) if limit else out

    def run_history(self, limit: int | None = None) -> DataFrame:
        out = self.read("detection_runs").orderBy(F.desc("run_timestamp"), F.desc("id"))
        return out.limit(limit) if limit else out

    def of_type(self, kind: str) -> DataFrame:
        """Documented extract: all stored anomalies carrying one type."""
        return self.anomalies().where(F.array_contains(F.split("anomaly_type", ","), kind))

    def cluster_counts(self) -> DataFrame:
        return self.anomalies().groupBy("cluster_name").agg(F.count(F.lit(1)).alias("n"), F.avg("anomaly_score").alias("avg_score"))


def run_report(df: DataFrame, store: ResultStore) -> DataFrame:
    """The summary report in long form (section, key, value): totals, types, clusters and the last five runs."""
    hit = F.col("is_anomaly").cast("bigint")
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("a"), F.min("Date").alias("from"), F.max("Date").alias("to"))
    rate = half_even(F.col("a") / F.col("n") * 100, 2)
    head = totals.select(F.lit("totals").alias("section"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))
        for k, v in (("total_records", F.col("n")), ("total_anomalies", F.col("a")), ("anomaly_rate_pct", rate),
                     ("first_date", F.col("from")), ("last_date", F.col("to")))])))
    types = store.anomaly_summary().select(F.lit("types").alias("section"), F.col("anomaly_type").alias("key"), F.col("count").cast("string").alias("value"))
    clusters = df.where("is_anomaly").groupBy("cluster_name").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("clusters").alias("section"), F.col("cluster_name").alias("key"), F.col("n").cast("string").alias("value"))
    runs = store.run_history(5).select(F.lit("runs").alias("section"), F.concat_ws(" ", F.col("id").cast("string"), "model_version").alias("key"),
                                       F.concat_ws("/", F.col("anomalies_detected").cast("string"), F.col("total_records").cast("string")).alias("value"))
    return head.unionByName(types).unionByName(clusters).unionByName(runs)


def write_report(report: DataFrame, path: str) -> None:
    """The report as text lines; it has a few dozen rows, so one file."""
    report.select(F.concat_ws("\t", "section", "key", "value").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, partition_by=()) -> None:
    df.write.mode("overwrite").option("header", True).partitionBy(*partition_by).csv(path)


def write_names_json(centres: DataFrame, path: str) -> None:
    """Cluster id -> name, one row per cluster."""
    centres.select("cluster_id", "name").coalesce(1).write.mode("overwrite").json(path)


def export_labelled(df: DataFrame, root: str) -> None:
    """All anomalies and the whole labelled data set, partitioned by vessel."""
    parts = ["vessel_id"] if "vessel_id" in df.columns else []
    df.where("is_anomaly").write.mode("overwrite").partitionBy(*parts).parquet(f"{root}/all_anomalies")
    df.write.mode("overwrite").partitionBy(*parts).parquet(f"{root}/full_dataset_with_labels")


def stage_or(spark: SparkSession, path: str, compute) -> DataFrame:
    """A stage table if an earlier run left one, else the result of computing it."""
    return spark.read.parquet(path) if path_exists(spark, path) else compute()


def classified_or_annotated(spark: SparkSession, classified: str, annotated: str) -> DataFrame:
    """The classified table, or the annotated one with a default type."""
    if path_exists(spark, classified):
        return spark.read.parquet(classified)
    return spark.read.parquet(annotated).withColumn(
        "primary_type", F.when(F.coalesce(F.col("is_anomaly"), F.lit(False)), "multivariate_outlier").otherwise("normal"))
