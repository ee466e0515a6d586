"""Helpers the operators share: table access, stored intermediate tables, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder in spark.checkpoint.dir.

    Only a session that runs wholly on this machine may leave the setting out; it gets a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        base = _LOCAL.setdefault("base", None) or tempfile.mkdtemp(prefix="keelson-llm-")
        _LOCAL["base"] = base
    return f"{base.rstrip('/')}/keelson-llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps neither repeat the work nor depend on an executor."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; no other letter changes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_mod(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo `divisor`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
                                      schema=schema)
