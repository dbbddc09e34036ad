import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import START, pandas_features, run_rows, skewed_runs, RUN_SCHEMA
from pyspark.sql import functions as F

from sunledger.operators.features import (
    ENGINEERED, add_features, clean_matrix, daytime_filter, dc_ac_power_ratio, feature_columns,
    performance_ratio, time_features)

ROLLING = ["performance_ratio", "pr_deviation", "power_step", "dc_ac_power_ratio"]


@pytest.mark.parametrize("limit,lookback", [(None, 12), (8, 12), (60, 12), (30, 3), (40, 1)])
def test_features_equal_pandas(spark, limit, lookback):
    rows = skewed_runs(spark)
    got = add_features(rows, 490.0, lookback=lookback, rows_per_slice=limit).toPandas()
    got = got.sort_values("event_id").reset_index(drop=True)
    want = pandas_features(rows.toPandas(), 490.0, lookback)
    assert list(got.event_id) == list(want.event_id)
    for name in ROLLING:
        np.testing.assert_allclose(got[name], want[name], rtol=2e-7, atol=1e-12, err_msg=name)


def test_short_runs_have_defaults(spark):
    rows = spark.createDataFrame(
        run_rows("a_noisy.parquet", 1, 3, 0) + run_rows("b_noisy.parquet", 2, 4, 10), RUN_SCHEMA)
    got = add_features(rows.withColumn("poa_global_wm2", F.lit(500.0).cast("float")), 490.0)
    table = got.toPandas().set_index("event_id")
    assert table.loc[0, "pr_deviation"] == 1 and table.loc[0, "power_step"] == 0
    assert list(table.loc[[10, 11], "pr_deviation"]) == [1, 1]  # fewer than 12 // 4 rows


def test_daytime_filter_drops_nan_null_and_the_threshold(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (10.0,), (10.1,), (500.0,)],
                                 "poa_global_wm2 float")
    kept = [round(r[0], 1) for r in daytime_filter(rows).collect()]
    assert sorted(kept) == [10.1, 500.0]


def test_zero_ac_gives_the_default_ratio(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (-0.0, 1.0), (None, 1.0), (1.0, 1.5), (0.1, 9.0)],
                                 "ac_power_kw float, dc_power_kw float")
    got = [r[0] for r in dc_ac_power_ratio(rows).select("dc_ac_power_ratio").collect()]
    assert got == [1.0, 1.0, 1.0, 1.5, 5.0]


def test_performance_ratio_is_filled_then_clipped(spark):
    rows = spark.createDataFrame([(1000.0, None), (1000.0, 980.0), (20.0, 490.0), (0.0, 5.0)],
                                 "poa_global_wm2 float, ac_power_kw float")
    got = [r["performance_ratio"] for r in performance_ratio(rows, 490.0).collect()]
    assert got == [0.0, 2.0, 2.0, 0.0]
    free = [r["performance_ratio"] for r in performance_ratio(rows, None).collect()]
    assert free == [0.0, 100.0, 100.0, 0.0]


def test_time_features_ignore_seconds(spark):
    at = dt.datetime(2024, 3, 1, 6, 30, 59)
    row = time_features(spark.createDataFrame([(at,)], "timestamp timestamp_ntz")).first()
    assert row["hour_sin"] == np.float32(np.sin(2 * np.pi * 6.5 / 24))
    assert row["doy_cos"] == np.float32(np.cos(2 * np.pi * 61 / 365))


def test_restart_breaks_the_rolling_state(spark):
    rows = skewed_runs(spark).withColumn("late", F.col("sim_day") > 5)
    got = add_features(rows, 490.0, restart=["late"]).toPandas().sort_values("event_id")
    frame = rows.toPandas()
    want = pd.concat([pandas_features(frame[frame.late], 490.0, 12),
                      pandas_features(frame[~frame.late], 490.0, 12)]).sort_values("event_id")
    np.testing.assert_allclose(got["pr_deviation"], want["pr_deviation"], rtol=2e-7)


def test_clean_matrix_and_missing_names(spark):
    rows = spark.createDataFrame(
        [(1, float("inf")), (2, float("-inf")), (3, float("nan")), (4, None), (5, 2.5)],
        "k int, x double")
    assert feature_columns(rows, ["x", "y", "x"]) == (["x"], ["y"])
    got = clean_matrix(rows, ["x", "y"], ["k"]).orderBy("k")
    assert got.columns == ["k", "x"]
    assert [r["x"] for r in got.collect()] == [0, 0, 0, 0, 2.5]


def test_engineered_names_are_all_produced(spark):
    got = add_features(skewed_runs(spark), None)
    assert set(ENGINEERED) <= set(got.columns)
    assert START.year == 2024
