"""Registered queries against DuckDB. KEELSON_ALL=1 runs all of them, at KEELSON_SF."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import SF

FAST = ["constraint_flags", "type_breakdown", "coverage_by_day", "long_gap_catalogue", "outage_blocks", "comissing_jaccard", "summary_stats",
        "correlation_matrix", "histogram", "linear_fit", "rolling_mean_centered", "anomaly_runs", "minmax_scale", "majority_vote", "load_raw",
        "parse_timestamp_auto", "unit_sanity_check", "run_length_islands", "missing_reason", "stream_gap_alert"]
NAMES = list(entry.queries()) if os.environ.get("KEELSON_ALL") else FAST
ORACLE = entry.oracle_sql()


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    from oracle_check import compare, duck
    sf = os.environ.get("KEELSON_SF", SF)
    got = entry.queries()[name](spark, sf).toPandas()
    if name in ORACLE:
        assert compare(got, duck(sf).sql(ORACLE[name]).df()) == ""
    else:
        assert len(got) > 0


def test_registry_is_complete():
    names = set(entry.queries())
    assert set(ORACLE) <= names
    assert {n for n in names if n == "pipeline" or n[:2] == "op" and n[2].isdigit()} == set(entry.EXTRA)
