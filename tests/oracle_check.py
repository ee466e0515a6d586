"""Run registered queries against their SQL in DuckDB: python tests/oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


def session(cpus: int = 8):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("keelson")
             .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = df[c].dtype.kind if hasattr(df[c].dtype, "kind") else "O"
        if kind == "f":
            df[c] = df[c].map(lambda x: None if pd.isna(x) else f"{x + 0.0:.6f}".replace("-0.000000", "0.000000"))
        else:
            df[c] = df[c].map(lambda x: None if x is None or (not isinstance(x, (list,)) and pd.isna(x)) else
                              (f"{x:.6f}" if isinstance(x, float) else str(x)))
    return df.fillna("NULL").sort_values(list(df.columns)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = [(c, got[c].dtype.kind, want[c].dtype.kind) for c in got.columns
             if {got[c].dtype.kind, want[c].dtype.kind} == {"i", "f"}]
    if kinds and not any(got[c].isna().any() for c, _, _ in kinds):
        return f"types {kinds}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return ""
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    rows = (a[bad] != b[bad]).any(axis=1)
    return f"values in {bad} ({rows.sum()} of {len(a)} rows)\n{a[rows].head(4)}\n{b[rows].head(4)}"


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    spark, con = session(), duck(sf)
    queries, oracle, failed = entry.queries(), entry.oracle_sql(), []
    todo = [n for n in queries if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    for n in todo:
        t = time.time()
        try:
            got = queries[n](spark, sf).toPandas()
            dt = time.time() - t
            msg = compare(got, con.sql(oracle[n]).df()) if n in oracle else f"rows-only ({len(got)})"
            if n in oracle and not msg and not len(got):
                msg = "EMPTY on both sides"
        except Exception as e:      # report every query, whatever fails
            dt, msg = time.time() - t, f"{type(e).__name__}: {str(e)[:1500]}"
        ok = not msg or msg.startswith("rows-only")
        failed += [] if ok else [n]
        print(f"{'ok  ' if ok else 'FAIL'} {n:32s} {dt:6.2f}s {msg}", flush=True)
    print(f"{len(todo) - len(failed)}/{len(todo)} ok; failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
