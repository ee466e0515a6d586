"""Raw file discovery and loading: many exports with differing headers into one canonical DataFrame."""

from __future__ import annotations

import csv
import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as cfg
from ..operators.normalize import normalize
from ..operators.ordered import Ordered, settled, written
from .excel import scan_excel, workbook_headers

EXTENSIONS = (".csv", ".xlsx", ".xls")
READABLE = (".csv", ".xlsx")
GLOB_CHARACTERS = "\\{}[]*?"


def file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = file_system(spark, path)
    return fs.exists(p)


def discover_files(spark: SparkSession, path: str) -> list[str]:
    """A file itself, or every supported file below a directory, sorted by full path."""
    p, fs = file_system(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(f"data path not found: {path}")
    if fs.getFileStatus(p).isFile():
        if not path.lower().endswith(EXTENSIONS):
            raise ValueError(f"unsupported file extension: {path}")
        return [path]
    found, listing = [], fs.listFiles(p, True)
    while listing.hasNext():
        name = listing.next().getPath().toString()
        if name.lower().endswith(EXTENSIONS):
            found.append(name)
    if not found:
        raise FileNotFoundError(f"no CSV or Excel files under {path}")
    return sorted(found)


def _csv_header(spark: SparkSession, path: str):
    """Column names of one CSV: only its first line is read."""
    try:
        p, fs = file_system(spark, path)
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
        try:
            line = reader.readLine()
        finally:
            reader.close()
        if not line or not line.strip():
            return None, "empty file"
        return tuple(next(csv.reader([line.lstrip("﻿")]))), None
    except Exception as problem:      # a file that cannot be opened is reported and skipped
        return None, str(problem).splitlines()[0]


def literal_path(path: str) -> str:
    """A discovered name as a path pattern that matches itself only."""
    return "".join("\\" + c if c in GLOB_CHARACTERS else c for c in path)


def scan_csv(spark: SparkSession, paths, columns, glob: str | None = None) -> DataFrame:
    """CSV files with one header, every column as text; types are decided by the projection that follows."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.read.option("header", True).option("enforceSchema", True).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    return reader.csv(paths)


def scan_columns_glob(spark: SparkSession, folder: str, glob: str, columns) -> DataFrame:
    """Selected columns of all matching files, by name: files may order their columns differently.

    The other columns are not parsed. A file that lacks a column gives NULL; one without a header is skipped with a warning.
    """
    headers, skipped = csv_headers(spark, [f for f in discover_files(spark, folder) if _matches(f, glob)])
    for f, reason in skipped:
        warnings.warn(f"skipping {f}: {reason}")
    if not headers:
        raise RuntimeError(f"no file below {folder} matches {glob} and can be read")
    parts = [scan_csv(spark, [literal_path(f) for f in files], header).select(
        *[F.col(f"`{c}`") if c in header else F.lit(None).cast("string").alias(c) for c in columns]) for header, files in headers.items()]
    return reduce(DataFrame.unionByName, parts)


def _matches(path: str, glob: str) -> bool:
    from fnmatch import fnmatch
    return fnmatch(path.rsplit("/", 1)[-1], glob)


def plain_path(path):
    """A file's path as metadata report it, without percent escapes."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _with_source(df: DataFrame) -> DataFrame:
    """source_file, and the split that a row came from: _path and _block (its start)."""
    return df.select("*", plain_path(F.col("_metadata.file_path")).alias("_path"), F.col("_metadata.file_block_start").alias("_block")).withColumn(
        "source_file", F.element_at(F.split("_path", "/"), -1))


def _numbered(parts: list) -> list:
    """Add `rid` to every part: the row's number in file order, then row order, over all parts.

    Each part is read and stored once, together with the place that every row had in that reading; nothing is numbered from a
    second one, whose splits and partitions may differ. A split's rows are a range of places inside one partition, so one narrow
    pass over the stored places gives its rows' first and last place, and their running sum over the splits the number to add.
    """
    held = [written(p.withColumn("_place", F.monotonically_increasing_id())) for p in parts]
    splits = reduce(DataFrame.unionByName, [
        p.groupBy("_path", "_block").agg(F.min("_place").alias("_first"), F.max("_place").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_layout", F.lit(i)) for i, p in enumerate(held)])
    broken = F.raise_error(F.lit("the rows of a split are not in one piece")).cast("bigint")
    rows = F.when(F.col("_last") - F.col("_first") + 1 == F.col("_n"), F.col("_n")).otherwise(broken)
    totals = Ordered(splits.withColumn("_n", rows), [], ["_path", "_block"]).running(sums={"_upto": F.col("_n")}).result()
    table = settled(totals.select("_layout", F.shiftright("_first", 33).alias("_part"), "_first", "_last",
                                  (F.col("_upto") - F.col("_n") - F.col("_first")).alias("_shift")))
    numbered = []
    for i, p in enumerate(held):
        own = table.where(F.col("_layout") == i).drop("_layout")
        of_split = (F.shiftright("_place", 33) == F.col("_part")) & F.col("_place").between(F.col("_first"), F.col("_last"))
        numbered.append(p.join(own, of_split).withColumn("rid", F.col("_place") + F.col("_shift"))
                        .drop("_path", "_block", "_place", "_part", "_first", "_last", "_shift"))
    return numbered


def csv_headers(spark: SparkSession, csvs) -> tuple[dict, list]:
    """(header -> files, skipped files with the reason)"""
    headers, skipped = {}, []
    with ThreadPoolExecutor(16) as pool:
        for f, (header, problem) in zip(csvs, pool.map(lambda f: _csv_header(spark, f), csvs)):
            headers.setdefault(header, []).append(f) if header else skipped.append((f, problem))
    return headers, skipped


def load_report(spark: SparkSession, path: str) -> tuple[dict, list[tuple[str, str]]]:
    """(kind and header -> files, skipped files with the reason) for everything under `path`."""
    files = discover_files(spark, path)
    found, skipped = csv_headers(spark, [f for f in files if f.lower().endswith(".csv")])
    headers = {("csv", header): fs for header, fs in found.items()}
    books = [f for f in files if f.lower().endswith(".xlsx")]
    for f, header, problem in workbook_headers(spark, [literal_path(b) for b in books]) if books else []:
        headers.setdefault(("xlsx", header), []).append(f) if header else skipped.append((f, problem))
    skipped += [(f, "legacy .xls is not read") for f in files if f.lower().endswith(".xls")]
    return headers, skipped


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    return cfg.local_table(spark, load_report(spark, path)[1], "path string, reason string")


def load_raw(spark: SparkSession, path: str, config: cfg.VesselConfig | None = None) -> DataFrame:
    """All files under `path`, normalised, with `source_file`, `rid` and `vessel_id`.

    Files are read per distinct header, so the plan grows with the number of layouts and not of files. The raw rows are stored
    once in the checkpoint folder; `rid` is gapless and the same whatever the number of cores, splits or partitions.
    """
    config = config or cfg.detect_vessel(path)
    headers, skipped = load_report(spark, path)
    for f, reason in skipped:
        warnings.warn(f"skipping {f}: {reason}")
    if not headers:
        raise RuntimeError(f"no files could be loaded from {path}: all {len(skipped)} failed")
    parts = []
    for (kind, header), files in headers.items():
        paths = [literal_path(f) for f in files]
        parts.append(_with_source(scan_csv(spark, paths, header)) if kind == "csv" else
                     scan_excel(spark, paths, header).drop("_row").withColumn("_block", F.lit(0).cast("bigint")))
    parts = [normalize(p, config) for p in _numbered(parts)]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df.withColumn("vessel_id", F.lit(config.vessel_id))
