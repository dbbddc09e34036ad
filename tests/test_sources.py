import json

import pytest
from helpers import pandas_features, skewed_runs
from pyspark.sql import functions as F

from sunledger.functions import columns as C
from sunledger.operators.features import add_features
from sunledger.operators.registry import file_registry
from sunledger.session import scratch_path, settle
from sunledger.sources import config as B
from sunledger.sources import manifest as MF
from sunledger.sources.telemetry import (
    downcast, list_batch_files, pick_schema_file, scan_batch, schema_file, year_filter)
from sunledger.streaming.arrivals import append_features, feature_stream, read_arrivals

RUNS = {"r1_siteA_noisy.parquet": "hot_noisy.parquet",
        "r2_fault_pid_af1_noisy.parquet": "r5_noisy.parquet",
        "r3_siteB_fault_dust_noisy.parquet": "r7_noisy.parquet"}


@pytest.fixture(scope="module")
def batch_dir(spark, tmp_path_factory):
    """Three run files with extra columns of every category."""
    folder = tmp_path_factory.mktemp("batch")
    rows = (skewed_runs(spark).drop("event_id")
            .withColumn("latitude", F.lit(35.781)).withColumn("longitude", F.lit(-78.639))
            .withColumn("voc_v", F.col("ac_power_kw").cast("double"))
            .withColumn("stress_heat", F.col("dc_power_kw").cast("double"))
            .withColumn("dhi_wm2", F.lit(0.0)).withColumn("lid_factor", F.rand(1))
            .withColumn("detailed_balance_efficiency_pct", F.rand(2))
            .withColumn("ac_power_true", F.rand(3)).withColumn("combo_id", F.rand(4))
            .withColumn("mystery", F.rand(5)))
    frame = rows.toPandas()
    for name, source in RUNS.items():
        part = frame[frame.source_file == source].sort_values("timestamp")
        part = part.drop(columns="source_file")
        if "siteB" in name:
            part = part.assign(latitude=10.0, longitude=20.0)
        part.to_parquet(folder / name, index=False)
    return str(folder)


def test_listing(spark, batch_dir, tmp_path):
    names = [r["source_file"] for r in list_batch_files(spark, batch_dir).orderBy(
        "source_file").collect()]
    assert names == sorted(RUNS)
    assert list_batch_files(spark, batch_dir, "siteB").count() == 1
    assert schema_file(spark, batch_dir).first()["source_file"] == "r1_siteA_noisy.parquet"
    with pytest.raises(FileNotFoundError):
        list_batch_files(spark, str(tmp_path))
    only_faults = spark.createDataFrame([("b_fault_noisy",), ("a_fault_noisy",)], "source_file string")
    assert pick_schema_file(only_faults).first()[0] == "a_fault_noisy"


def test_scan_prunes_and_downcasts(spark, batch_dir):
    rows = scan_batch(spark, batch_dir, ["timestamp", "ac_power_kw", "voc_v", "nope"], years=[1, 3])
    assert rows.columns == ["timestamp", "ac_power_kw", "voc_v", "sim_year", "source_file",
                            "row_index"]
    assert dict(rows.dtypes)["voc_v"] == "float"
    assert {r[0] for r in rows.select("sim_year").distinct().collect()} == {1, 3}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "poa_global_wm2" not in plan and "PushedFilters: [In(sim_year" in plan
    assert {r[0] for r in rows.select("source_file").distinct().collect()} == set(RUNS)


def test_features_of_a_scanned_batch_follow_the_file_order(spark, batch_dir):
    rows = scan_batch(spark, batch_dir)
    want = pandas_features(rows.withColumn("event_id", F.col("row_index")).toPandas(), 490.0, 12)
    for limit in (None, 40):
        got = add_features(rows, 490.0, rows_per_slice=limit).toPandas()
        keys = ["source_file", "row_index"]
        got, expected = (t.sort_values(keys).reset_index(drop=True) for t in (got, want))
        assert abs(got.pr_deviation - expected.pr_deviation).max() < 1e-6
        assert abs(got.power_step - expected.power_step).max() < 1e-6


def test_nan_becomes_null(spark):
    rows = spark.createDataFrame([(float("nan"), 1), (2.0, 1)], "x double, sim_year int")
    assert [r["x"] for r in downcast(rows).collect()] == [None, 2.0]
    assert year_filter(rows, None) is rows


def test_batch_without_config(spark, batch_dir):
    batch = B.Batch.open(spark, batch_dir)
    assert batch.columns["scada"] == ["ac_power_kw", "dc_power_kw", "poa_global_wm2"]
    assert batch.columns["constant"] == ["dhi_wm2"]
    assert batch.columns["stress"] == ["stress_heat"] and batch.columns["iv_curve"] == ["voc_v"]
    assert batch.columns["uncategorized"] == ["mystery"]
    assert batch.columns["simulator_internal"] == ["lid_factor"]
    assert batch.columns["noise"] == ["ac_power_true"]
    first = scan_batch(spark, batch_dir, ["dc_power_kw"], pattern="r1_siteA_noisy.parquet")
    top = first.agg(F.max("dc_power_kw")).first()[0]
    assert abs(batch.array_kwp - top * 1.05) < 1e-9
    assert {r["site_name"] for r in batch.sites.collect()} == {"35.78_-78.64", "10.0_20.0"}
    one = batch.summary().first()
    assert (one["n_sites"], one["n_scada"], one["n_features"]) == (2, 3, 5)
    assert "mystery" not in batch.load_columns and "timestamp" in batch.load_columns
    assert batch.feature_set("scada")[3] == "hour_sin"
    assert batch.feature_set("full")[-2:] == ["stress_heat", "voc_v"]
    assert batch.feature_set("scada+device") == batch.feature_set("scada+iv_curve")


def test_config_json(spark, tmp_path):
    def read(config):
        path = tmp_path / f"{abs(hash(json.dumps(config)))}.json"
        path.write_text(json.dumps(config, indent=2))
        table = B.read_batch_config(spark, str(path))
        return B.config_capacity(table).first()[0], B.config_sites(table).orderBy("site_no").collect()

    stated, sites = read({
        "installation_fixed": {"array_power_kWp": 17.43, "system_area_m2": 5},
        "stc_parameters": {"efficiency": 0.2},
        "sweep_summary": {"locations": [{"lat": 35.779, "lon": -78.638, "name": "Raleigh, USA"},
                                        {"lat": 1.0, "lon": 2.0}]}})
    assert stated == 17.43
    assert [tuple(r) for r in sites] == [(0, 35.78, -78.64, "Raleigh"), (1, 1.0, 2.0, "1.0_2.0")]
    assert read({"installation_fixed": {"system_area_m2": 50.0},
                 "stc_parameters": {"efficiency": 0.2}})[0] == 10.0
    assert read({"installation_fixed": {"system_area_m2": 50.0}}) == (None, [])


def test_classification_is_default_deny(spark):
    rows = spark.createDataFrame([], "timestamp_true string, fault_x int, brand_new double")
    got = {r["column"]: (r["category"], r["included"]) for r in C.classify_columns(
        rows, spark.createDataFrame([], "column string")).collect()}
    assert got == {"timestamp_true": ("noise", False), "fault_x": ("label", False),
                   "brand_new": ("uncategorized", False)}


def test_metrics_csv(spark):
    table = spark.createDataFrame([("a", 0.5), ("b", None)], "fault_type string, f1 double")
    path = MF.write_metrics_csv(table, scratch_path(spark, "csv"))
    back = MF.read_metrics_csv(spark, path, "fault_type string, f1 double")
    assert sorted(map(tuple, back.collect())) == [("a", 0.5), ("b", None)]


def test_settled_tables_prune_columns_and_folders(spark):
    table = settle(spark.range(100).selectExpr("id", "id % 4 as part", "id * 2 as x"), by="part")
    assert table.count() == 100 and table.where("part = 1").count() == 25
    plan = table.where("part = 1").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "ReadSchema: struct<x:bigint>" in plan


def test_stream_of_arriving_files_equals_the_batch(spark, batch_dir):
    schema = spark.read.parquet(batch_dir).schema
    out = scratch_path(spark, "features")
    query = feature_stream(read_arrivals(spark, batch_dir, schema, files_per_batch=1), 490.0,
                           append_features(out), scratch_path(spark, "stream"))
    query.awaitTermination(300)
    assert len(query.recentProgress) >= 3
    names = ["source_file", "row_index", "pr_deviation", "power_step"]
    streamed = spark.read.parquet(out).select(names)
    batch = add_features(scan_batch(spark, batch_dir), 490.0).select(names)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_registry_of_scanned_files(spark, batch_dir):
    table = {r["source_file"]: r["file_fault_type"] for r in file_registry(
        list_batch_files(spark, batch_dir)).collect()}
    assert table["r3_siteB_fault_dust_noisy.parquet"] == "dust"


def test_columns_of_the_schema_file_survive_files_that_lack_them(spark, batch_dir, tmp_path):
    for i in range(6):
        frame = spark.read.parquet(f"{batch_dir}/r1_siteA_noisy.parquet").toPandas()
        if i == 1:
            frame = frame.drop(columns="voc_v")
        name = f"r{i}_fault_pid_noisy.parquet" if i == 1 else f"r{i}_noisy.parquet"
        frame.to_parquet(tmp_path / name, index=False)
    from sunledger.plans.flows import open_dataset
    data = open_dataset(spark, str(tmp_path))
    assert "voc_v" in data.features.columns
    empty = data.features.groupBy("source_file").agg(F.count("voc_v").alias("n")).where("n = 0")
    assert [r["source_file"] for r in empty.collect()] == ["r1_fault_pid_noisy.parquet"]


def test_a_scan_of_named_files_opens_no_other(spark, batch_dir):
    name = "r1_siteA_noisy.parquet"
    rows = scan_batch(spark, batch_dir, ["ac_power_kw"], files=[name])
    assert {r[0] for r in rows.select("source_file").distinct().collect()} == {name}
    rows.collect()
    scan = rows._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numFiles").value() == 1
