"""Footer statistics against scans of the same files."""

import math
import uuid

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sunledger.operators import stats
from sunledger.sources import footers, manifest
from sunledger.sources.config import Batch
from sunledger.sources.telemetry import list_files, scan_batch

LONG = "x" * 80


def frame(n, first, **other):
    base = {"timestamp": pd.date_range("2024-01-01", periods=n, freq="5min"),
            "whole": [7] * n, "moving": list(range(first, first + n)), "big": [2 ** 60 + first] * n,
            "real": [1.5] * n, "with_nan": [1.5] * (n - 1) + [math.nan], "none": [None] * n,
            "part": ["a"] * (n - 1) + [None], "text": ["same"] * n, "cut": [LONG + str(first)] * n,
            "flag": [True] * n, "dc_power_kw": [float(first + i) for i in range(n)]}
    return pd.DataFrame({**base, **other})


@pytest.fixture()
def batch_dir(tmp_path):
    for i, n in enumerate((5, 1, 12)):
        table = pa.Table.from_pandas(frame(n, 10 * i), preserve_index=False)
        table = table.set_column(table.schema.get_field_index("none"), "none",
                                 pa.array([None] * n, pa.float64()))
        table = table.set_column(table.schema.get_field_index("with_nan"), "with_nan",
                                 pa.array([1.5] * (n - 1) + [math.nan]))
        table = table.set_column(table.schema.get_field_index("part"), "part",
                                 pa.array(["a"] * (n - 1) + [None], pa.string()))
        pq.write_table(table, tmp_path / f"r{i}_x_noisy.parquet", row_group_size=4)
    return str(tmp_path)


def test_footers_agree_with_scans(spark, batch_dir):
    files = list_files(spark, batch_dir)
    schema = spark.read.parquet(batch_dir).schema
    rows = scan_batch(spark, batch_dir, schema=schema)
    read = footers.read_footers(files)
    counts = {r["source_file"]: r["n_rows"] for r in footers.row_counts(read).collect()}
    assert counts == {r["source_file"]: r["n_rows"]
                      for r in stats.file_row_counts(rows).collect()}
    bounds = footers.column_bounds(read, schema)
    assert (bounds["moving"]["low"], bounds["moving"]["high"]) == (0.0, 31.0)
    assert footers.highest(bounds, "dc_power_kw") == 31.0
    certain, open_ones = footers.constant_by_footer(bounds, schema)
    assert {"whole", "none", "flag"} <= set(certain)
    assert {"real", "with_nan", "text", "cut"} <= set(open_ones)
    assert not {"moving", "part"} & {*certain, *open_ones}
    got = {r[0] for r in footers.constant_columns(files, rows, schema, bounds).collect()}
    assert got == {r[0] for r in stats.constant_columns(rows, schema.names).collect()}
    assert got == {"whole", "none", "flag", "real", "text"}


def test_missing_statistics_and_columns_are_scanned(spark, tmp_path):
    bare = pa.Table.from_pandas(frame(3, 0)[["whole", "dc_power_kw"]], preserve_index=False)
    pq.write_table(bare, tmp_path / "a_noisy.parquet", write_statistics=False)
    less = pa.Table.from_pandas(frame(3, 0)[["whole"]], preserve_index=False)
    pq.write_table(less, tmp_path / "b_noisy.parquet")
    files = list_files(spark, str(tmp_path))
    schema = spark.read.parquet(str(tmp_path / "a_noisy.parquet")).schema
    rows = scan_batch(spark, str(tmp_path), schema=schema)
    bounds = footers.column_bounds(footers.read_footers(files), schema)
    assert footers.highest(bounds, "dc_power_kw") is None
    assert footers.constant_by_footer(bounds, schema) == ([], ["whole", "dc_power_kw"])
    assert [r[0] for r in footers.constant_columns(files, rows, schema, bounds).collect()] == [
        "whole"]


def test_files_that_python_cannot_open_are_left_to_the_scan(spark, batch_dir):
    files = list_files(spark, batch_dir)
    foreign = files.select(F.concat(F.lit("nosuch://store/"), "source_file").alias("path"))
    read = footers.read_footers(foreign)
    schema = spark.read.parquet(batch_dir).schema
    assert footers.row_counts(read).count() == 0
    bounds = footers.column_bounds(read, schema)
    assert footers.constant_by_footer(bounds, schema) == ([], schema.names)
    assert footers.column_bounds(footers.read_footers(files.where("false")), schema)[
        "whole"]["values"] == 0


@pytest.fixture()
def foreign_dir(spark, tmp_path):
    """A folder by a path that Spark opens and Python does not."""
    box = uuid.uuid4().hex
    (tmp_path / "runs").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set(
        f"fs.viewfs.mounttable.{box}.link./runs", f"file://{tmp_path}/runs")
    return tmp_path / "runs", f"viewfs://{box}/runs"


def test_rows_of_files_that_python_cannot_open_are_counted_by_spark(spark, foreign_dir):
    local, foreign = foreign_dir
    sizes = {"a b_noisy.parquet": 5, "c+d_noisy.parquet": 3, "e%20f_noisy.parquet": 2,
             "none_noisy.parquet": 0}
    for name, n in sizes.items():
        pq.write_table(pa.table({"v": pa.array(range(n), pa.int64())}), local / name)
    read = footers.read_footers(list_files(spark, foreign))
    assert footers.open_footer(f"{foreign}/none_noisy.parquet") is None
    scan = lambda: spark.read.schema("v long").parquet(foreign)
    got = footers.row_counts(read, scan=scan).collect()
    assert sorted(map(tuple, got)) == sorted(sizes.items())
    # files of both kinds, each counted once
    pq.write_table(pa.table({"v": pa.array([1], pa.int64())}), local / "g_noisy.parquet")
    near = footers.read_footers(list_files(spark, str(local)).where("source_file like 'g%'"))
    both = read.unionByName(near)
    split = lambda: scan().where("_metadata.file_name not like 'g%'")
    got = footers.row_counts(both, scan=split).collect()
    assert sorted(map(tuple, got)) == sorted({**sizes, "g_noisy.parquet": 1}.items())


def test_a_scan_of_other_files_is_an_error_and_none_is_made_without_need(spark, foreign_dir):
    local, foreign = foreign_dir
    for name in ("a_noisy.parquet", "b_noisy.parquet"):
        pq.write_table(pa.table({"v": pa.array([1, 2], pa.int64())}), local / name)
    scan = lambda: spark.read.schema("v long").parquet(foreign)
    one = footers.read_footers(list_files(spark, foreign, "a_*"))
    with pytest.raises(Exception, match="scanned but not listed"):
        footers.row_counts(one, scan=scan).collect()

    def never():
        raise AssertionError
    opened = footers.read_footers(list_files(spark, str(local)))
    assert footers.row_counts(opened, scan=never).count() == 2


def test_footer_row_counts_counts_runs_in_a_store_that_only_spark_reads(
        spark, sf, foreign_dir, monkeypatch):
    from sunledger.catalog import queries
    monkeypatch.setattr(queries, "scratch_path", lambda spark, name: f"{foreign_dir[1]}/{name}")
    got = {tuple(r) for r in queries.footer_row_counts(spark, sf).collect()}
    assert got == {tuple(r) for r in queries.file_row_counts(spark, sf).collect()} and got


def test_opening_a_batch_scans_only_columns_that_footers_leave_open(spark, batch_dir, monkeypatch):
    scanned = []
    plain = stats.constant_columns
    monkeypatch.setattr(stats, "constant_columns",
                        lambda rows, names: scanned.append(list(names)) or plain(rows, names))
    for i in range(3):
        path = f"{batch_dir}/r{i}_x_noisy.parquet"
        table = pq.read_table(path)
        for name, at in (("latitude", 30.0 + i), ("longitude", -100.0)):
            table = table.append_column(name, pa.array([at] * table.num_rows))
        pq.write_table(table, path, row_group_size=4)
    batch = Batch.open(spark, batch_dir)
    assert batch.array_kwp == pytest.approx(31.0 * 1.05)
    assert len(scanned) == 1 and "moving" not in scanned[0] and "dc_power_kw" not in scanned[0]
    assert batch.sites.count() == 3


def test_a_manifest_keeps_path_years_and_lookback(spark, tmp_path):
    entries = spark.createDataFrame(
        [("a_noisy.parquet", "a", "none", "train", "/x/a_noisy.parquet", [1, 2], 12),
         ("a_noisy.parquet", "a", "none", "test", "/x/a_noisy.parquet", [3], 12),
         ("b_noisy.parquet", "b", "pid", "val", None, None, None)], manifest.REGISTRY_SCHEMA)
    path = manifest.save_manifest(entries.withColumn("more", F.lit(1)), str(tmp_path / "m"))
    loaded, header = manifest.load_manifest(spark, path)
    assert loaded.columns == entries.columns and header["n_entries"] == 3
    assert sorted(map(str, loaded.collect())) == sorted(map(str, entries.collect()))
    short = entries.select(*manifest.ENTRY)
    manifest.save_manifest(short, str(tmp_path / "s"))
    assert manifest.load_manifest(spark, str(tmp_path / "s"))[0].columns == short.columns


def test_run_files_are_written_by_as_many_tasks_as_their_rows_ask_for(spark, sf, monkeypatch):
    from sunledger.catalog import inputs, queries
    n_rows = inputs.rows(spark, sf).count()
    monkeypatch.setattr(queries, "WRITTEN_ROWS", -(-n_rows // 5))
    path, files, _ = queries._run_files(spark, sf)
    tasks = files.select(F.regexp_extract("path", r"part-(\d+)-", 1)).distinct().count()
    runs = inputs.rows(spark, sf).select("source_file").distinct().count()
    assert tasks == 5 and files.count() == runs
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) <= 256


def test_bounds_read_every_footer_once(spark, batch_dir):
    files = list_files(spark, batch_dir)
    read = footers.read_footers(files)
    counter = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            counter.add(batch.num_rows)
            yield batch
    watched = read.mapInArrow(note, read.schema)
    footers.column_bounds(watched, spark.read.parquet(batch_dir).schema)
    assert counter.value == read.count()
