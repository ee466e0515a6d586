"""Fitted ranges join to rows without moving them."""

import pytest

from keelson.operators import normalize


def test_fitted_ranges_join_without_moving_rows(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k int, x double")
        fitted = normalize.fit_minmax(rows, ["x"], ["k"])
        back = normalize.inverse_minmax(normalize.minmax_scale(rows, ["x"], ["k"]), fitted, ["x"], ["k"])
        assert "SortMergeJoin" not in back._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["x"] for r in back.collect()) == pytest.approx([float(i) for i in range(30)])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
