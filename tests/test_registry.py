import itertools
import json

import pytest
from pyspark.sql import functions as F

from sunledger.operators import registry as R
from sunledger.sources import manifest as MF
from sunledger.session import scratch_path

NAMES = {
    "r001_siteA_noisy.parquet": ("r001", "none"),
    "r002_fault_pid_af1.2_noisy.parquet": ("r002", "pid"),
    "r003_fault_cell_crack_aging5_clean.parquet": ("r003", "cell_crack"),
    "r004_fault_soiling_noisy.parquet": ("r004", "soiling"),
    "r005_combo_2_noisy.parquet": ("r005", "combo"),
    "r6_fault_a_fault_b_noisy.parquet": ("r6", "a"),
    "r7_x_clean_noisy.parquet": ("r7", "none"),
    "r8_fault_x_aging1_af2_noisy.parquet": ("r8", "x_aging1"),
    "r9_fault_y_clean_noisy.parquet": ("r9", "y"),
}


def files(spark, sizes):
    rows = [(f"{kind}{i:04d}_fault_{kind}_noisy.parquet",)
            for kind, n in sizes.items() for i in range(n)]
    return R.file_registry(spark.createDataFrame(rows, "source_file string"))


def test_file_names(spark):
    table = R.file_registry(spark.createDataFrame([(n,) for n in NAMES], "source_file string"))
    got = {r["source_file"]: (r["run_id"], r["file_fault_type"]) for r in table.collect()}
    assert got == NAMES


@pytest.mark.parametrize("limit", [None, 3])
def test_split_sizes_per_type(spark, limit):
    sizes = {"a": 1, "b": 2, "c": 3, "d": 5, "e": 10, "f": 33}
    splits = R.assign_splits(files(spark, sizes), rows_per_slice=limit)
    got = {(r["file_fault_type"], r["split"]): r["n_files"]
           for r in R.split_counts(splits, by_type=True).collect()}
    want = {("a", "train"): 1, ("b", "train"): 1, ("b", "test"): 1}
    for kind in "cdef":
        part = max(1, int(0.2 * sizes[kind]))
        want |= {(kind, "val"): part, (kind, "test"): part, (kind, "train"): sizes[kind] - 2 * part}
    assert got == want
    assert R.split_leaks(splits).count() == 0


def test_splits_do_not_depend_on_slicing_and_follow_the_seed(spark):
    table = files(spark, {"a": 30, "b": 9})
    one, cut, other = (
        {tuple(r) for r in R.assign_splits(table, seed=s, rows_per_slice=n).collect()}
        for s, n in ((42, None), (42, 4), (7, None)))
    assert one == cut and one != other


def test_limit_runs(spark):
    table = files(spark, {"a": 7, "b": 2, "c": 1})
    got = [r["source_file"] for r in R.limit_runs(table, 6).orderBy("source_file").collect()]
    assert [g[:5] for g in got] == ["a0000", "a0001", "b0000", "b0001", "c0000"]
    assert R.limit_runs(table, 10).count() == 10


@pytest.mark.parametrize("per_batch", [1, 3, 4, 20])
def test_balanced_batches_equal_a_hand_loop(spark, per_batch):
    sizes = {"a": 7, "b": 2, "c": 1}
    table = files(spark, sizes)
    groups = [[f"{k}{i:04d}_fault_{k}_noisy.parquet" for i in range(n)] for k, n in sizes.items()]
    target = -(-10 // per_batch) * per_batch
    want = list(itertools.islice(
        (g[turn % len(g)] for turn in itertools.count() for g in groups), target))
    got = R.class_balanced_batches(table, per_batch).orderBy("slot").collect()
    assert [r["source_file"] for r in got] == want
    assert [r["batch"] for r in got] == [i // per_batch for i in range(target)]


def test_site_names(spark):
    sites = spark.createDataFrame(
        [(0, 10.0, 20.0, "First"), (1, 10.04, 20.0, "Second"), (2, 50.0, 60.0, "Far")],
        "site_no int, site_lat double, site_lon double, site_name string")
    points = spark.createDataFrame(
        [(10.04, 20.0), (10.02, 20.0), (10.06, 20.04), (50.04, 60.0), (50.06, 60.0), (9.955, 20.0)],
        "latitude double, longitude double")
    got = {(r[0], r[1]): r[2] for r in R.site_name(points, sites).collect()}
    assert got == {(10.04, 20.0): "Second", (10.02, 20.0): "First", (10.06, 20.04): "Second",
                   (50.04, 60.0): "Far", (50.06, 60.0): "50.06_60.00", (9.955, 20.0): "First"}


def test_temporal_folds_need_two_years(spark):
    table = R.assign_splits(files(spark, {"a": 10}))
    rows = table.select("source_file", F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("sim_year"))
    folds = R.temporal_folds(rows, table).collect()
    assert {tuple(r["years"]) for r in folds if r["split"] == "test"} == {(4,)}
    assert {tuple(r["years"]) for r in folds if r["split"] == "train"} == {(1, 2)}
    pool = table.where("split <> 'test'").count()
    assert sum(r["split"] == "test" for r in folds) == pool
    assert R.temporal_folds(rows.where("sim_year = 1"), table).count() == 0


def test_location_folds(spark):
    table = R.assign_splits(files(spark, {"a": 12, "b": 6}))
    sites = table.select("source_file", F.when(
        F.substring("source_file", 5, 1).cast("int") % 2 == 0, "x").otherwise("y").alias("loc_id"))
    folds = R.location_folds(table, sites)
    assert folds.where("(split = 'test') <> (loc_id = test_loc_id)").count() == 0
    assert folds.groupBy("test_loc_id", "source_file").count().where("count > 1").count() == 0
    assert R.location_folds(table, sites.withColumn("loc_id", F.lit("x"))).count() == 0


def test_resolve_entries_is_empty_without_a_test_side(spark):
    table = R.assign_splits(files(spark, {"a": 1}))
    assert R.resolve_entries(table, "fault_active").count() == 0
    healthy = table.withColumn("file_fault_type", F.lit("none")).withColumn("split", F.lit("test"))
    assert R.resolve_entries(table.union(healthy.select(table.columns)), "fault_active").count()
    assert R.resolve_entries(table.union(healthy.select(table.columns)), "fault_type").count() == 0


def test_manifest_round_trip(spark):
    table = R.assign_splits(files(spark, {"a": 5, "b": 3}))
    path = MF.save_manifest(table, scratch_path(spark, "m"), {"fault_active": {"rf": "/x"}},
                            {"seed": 42})
    loaded, header = MF.load_manifest(spark, path)
    assert {tuple(r) for r in loaded.collect()} == {tuple(r) for r in table.collect()}
    assert header["version"] == 1 and header["n_entries"] == 8
    assert header["model_paths"] == {"fault_active": {"rf": "/x"}}
    assert json.loads(json.dumps(header["extra"])) == {"seed": "42"}
