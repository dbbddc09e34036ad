"""Windows by convolution against plain loops, and what they tell apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import skewed_runs
from sunledger.operators import convolutions as V
from sunledger.operators import sequences as Q
from sunledger.plans import models as P

NAMES = ["poa_global_wm2", "ac_power_kw"]


def plain(block, kernel):
    """Largest output and share above zero of one window, tap by tap."""
    size, out = len(block), []
    reach = (len(kernel.weights) - 1) * kernel.dilation
    for start in range(-kernel.padding, size + kernel.padding - reach):
        total = kernel.offset
        for tap, weight in enumerate(kernel.weights):
            at = start + tap * kernel.dilation
            if 0 <= at < size:
                total += float(weight @ block[at])
        out.append(total)
    return max(out), sum(v > 0 for v in out) / len(out)


@pytest.mark.parametrize("size, stride", [(6, 2), (5, 5), (4, 7), (1, 1), (13, 3)])
def test_windows_equal_plain_loops(spark, monkeypatch, size, stride):
    monkeypatch.setattr(Q, "CHUNK_ROWS", 16)  # many stretches meet in a run
    monkeypatch.setattr(Q, "CHUNK_WINDOWS", 1)
    rows = skewed_runs(spark).withColumn("label", F.col("fault_active").cast("int"))
    kernels = V.seeded_kernels(size, 2, 9)
    found = V.window_kernels(rows, NAMES, size, stride, kernels, rows_per_slice=50)
    got = {(r["source_file"], r["window_id"]): r for r in found.collect()}
    wanted = 0
    for _, run in rows.toPandas().groupby("source_file"):
        run = run.sort_values(["timestamp", "event_id"])
        x, y = run[NAMES].to_numpy(float), run["label"].to_numpy()
        for w, start in enumerate(range(0, len(run) - size + 1, stride)):
            row = got[(run["source_file"].iloc[0], w)]
            wanted += 1
            assert row["label"] == y[start + size - 1] and row["n_rows"] == size
            for i, kernel in enumerate(kernels):
                top, above = plain(x[start:start + size], kernel)
                assert abs(row[f"kernel_{i}_max"] - top) < 1e-6 * max(1, abs(top))
                assert abs(row[f"kernel_{i}_above"] - above) < 1e-9
    assert len(got) == wanted


def test_rows_are_not_copied_by_window(spark):
    rows = skewed_runs(spark).withColumn("label", F.lit(0))
    sent = Q.window_chunks(rows, NAMES, 12, 1).agg(F.sum(F.size("labels"))).first()[0]
    long_enough = rows.groupBy("source_file").count().where("count >= 12")
    assert sent == long_enough.agg(F.sum("count")).first()[0]  # explode would send 12 times that


def test_kernels_are_seeded_and_must_fit(spark):
    one, two = V.seeded_kernels(12, 3), V.seeded_kernels(12, 3)
    assert all((a.weights == b.weights).all() and a.offset == b.offset for a, b in zip(one, two))
    assert len({k.dilation for k in V.seeded_kernels(60, 3)}) > 3
    assert all(np.abs(k.weights.sum(axis=0)).max() < 1e-9 for k in one)
    rows = skewed_runs(spark).withColumn("label", F.lit(0))
    with pytest.raises(ValueError):
        V.window_kernels(rows, NAMES, 4, 2, [V.Kernel(np.ones((3, 2)), dilation=2)])
    assert V.window_kernels(rows.limit(0), NAMES, 4, 2).collect() == []
    assert V.window_kernels(rows, NAMES, 5000, 2).collect() == []


def ordered_runs(spark, n=240, size=24):
    """Runs of one window; both kinds have the same values, slope and ends, but not their order."""
    rng, rows, at = np.random.default_rng(5), [], 0
    quick = np.tile([1, -1, 1, -1], 3)
    shapes = (np.concatenate([quick, quick[::-1]]), np.tile([1, -1, -1, 1], size // 4))
    for i in range(n):
        kind = i % 2
        values = shapes[kind] * rng.choice([-1, 1]) + rng.normal(scale=0.3, size=size)
        for step, v in enumerate(values):
            rows.append((f"r{i:03d}.parquet", at, step, float(v), bool(kind)))
            at += 1
    table = spark.createDataFrame(rows, "source_file string, event_id long, step int, x float, fault_active boolean")
    side = F.regexp_extract("source_file", r"(\d+)", 1).cast("int") % 10
    files = table.select("source_file").distinct().select(
        "source_file", F.when(side < 6, "train").when(side < 8, "val").otherwise("test").alias("split"),
        F.lit("none").alias("file_fault_type"), F.lit("r").alias("run_id"))
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    return table.withColumn("timestamp", start + F.make_interval(mins=F.col("step"))).withColumn(
        "fault_type", F.when(F.col("fault_active"), "click").otherwise("none")), files


def test_order_is_seen_where_moments_are_equal(spark):
    table, files = ordered_runs(spark)
    result = P.run_task(table, files, P.DETECTION, ["x"], ["window_summary", "window_kernels"],
                        window_size=24, stride=24, sequence_params={
                            "window_summary": {"numTrees": 20, "maxDepth": 5}})
    aucs = result.aucs()
    assert aucs["window_kernels"] > 0.95, aucs
    assert 0.25 < aucs["window_summary"] < 0.75, aucs
