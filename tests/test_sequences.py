import numpy as np
import pytest
from helpers import START, skewed_runs
from pyspark.sql import functions as F

from sunledger.operators import sequences as Q


def by_hand(frame, size, stride):
    out = {}
    for name, run in frame.groupby("source_file"):
        run = run.sort_values(["timestamp", "event_id"]).reset_index(drop=True)
        for w in range(0, (len(run) - size) // stride + 1 if len(run) >= size else 0):
            out[name, w] = run.iloc[w * stride:w * stride + size]
    return out


@pytest.mark.parametrize("size,stride,limit", [(12, 5, None), (12, 5, 20), (3, 7, None), (4, 4, 9)])
def test_windows_equal_a_hand_loop(spark, size, stride, limit):
    rows = skewed_runs(spark).withColumn("label", F.col("event_id") % 5)
    want = by_hand(rows.toPandas(), size, stride)
    got = Q.sequence_windows(rows, size, stride, rows_per_slice=limit).collect()
    assert {(r["source_file"], r["window_id"]) for r in got} == set(want)
    for r in got:
        part = want[r["source_file"], r["window_id"]]
        assert r["n_rows"] == size and r["label"] == part.label.iloc[-1]
        assert r["start_ts"] == part.timestamp.iloc[0] and r["end_ts"] == part.timestamp.iloc[-1]
    last = Q.last_step(rows, ["ac_power_kw"], size, stride, rows_per_slice=limit).collect()
    assert {(r["source_file"], r["window_id"], r["label"]) for r in last} == {
        (*key, part.label.iloc[-1]) for key, part in want.items()}


@pytest.mark.parametrize("size,stride,limit", [
    (12, 5, None), (12, 5, 20), (6, 4, 20), (2, 4, None), (4, 4, 9), (8, 2, 30), (1, 1, None)])
def test_window_blocks_and_summaries(spark, size, stride, limit):
    rows = skewed_runs(spark, hot=150, others=(11, 12, 25, 1)).withColumn("label", F.lit(1))
    names = ["ac_power_kw", "dc_power_kw"]
    want = by_hand(rows.toPandas(), size, stride)
    blocks = Q.window_arrays(rows, names, size, stride, rows_per_slice=limit).collect()
    assert sorted((r["source_file"], r["window_id"]) for r in blocks) == sorted(want)
    for r in blocks:
        part = want[r["source_file"], r["window_id"]]
        np.testing.assert_array_equal(np.array(r["block"], dtype=np.float32),
                                      part[names].to_numpy())
    found = Q.window_summary(rows, names, size, stride, rows_per_slice=limit).collect()
    assert sorted((r["source_file"], r["window_id"]) for r in found) == sorted(want)
    for r in found:
        for name in names:
            x = want[r["source_file"], r["window_id"]][name].to_numpy().astype(float)
            assert r[f"{name}_last"] == x[-1]
            assert (r[f"{name}_min"], r[f"{name}_max"]) == (x.min(), x.max())
            if size == 1:
                assert r[f"{name}_std"] is None and r[f"{name}_slope"] is None
                continue
            np.testing.assert_allclose(
                [r[f"{name}_mean"], r[f"{name}_std"], r[f"{name}_slope"]],
                [x.mean(), x.std(ddof=1), np.polyfit(np.arange(size), x, 1)[0]],
                rtol=1e-9, atol=1e-9)


def test_summaries_keep_their_digits_far_from_zero(spark):
    rows = skewed_runs(spark, hot=60, others=(30,)).withColumn("label", F.lit(1)).withColumn(
        "ac_power_kw", (F.lit(1_000_000) + F.col("event_id") % 7 * 0.25).cast("float"))
    want = by_hand(rows.toPandas(), 12, 5)
    for r in Q.window_summary(rows, ["ac_power_kw"], 12, 5).collect():
        x = want[r["source_file"], r["window_id"]].ac_power_kw.to_numpy().astype(float) - 1e6
        np.testing.assert_allclose(
            [r["ac_power_kw_std"], r["ac_power_kw_slope"]],
            [x.std(ddof=1), np.polyfit(np.arange(12), x, 1)[0]], rtol=1e-7, atol=1e-9)


def test_rows_of_pieces_do_not_grow_with_the_overlap(spark):
    rows = skewed_runs(spark).withColumn("label", F.lit(1))
    for size, stride in ((12, 5), (60, 5), (60, 1)):
        text = Q.window_summary(rows, ["ac_power_kw"], size, stride)._jdf.queryExecution(
            ).executedPlan().toString()
        assert text.count("Exchange") == 1 and "Generate" not in text


def test_short_run_loss(spark):
    rows = skewed_runs(spark, hot=300, others=(7, 1, 2, 3, 13))
    got = Q.short_run_loss(rows, 12).first()
    assert (got["runs_lost"], got["n_runs"], got["rows_lost"], got["n_rows"]) == (4, 6, 13, 326)
    assert Q.short_run_loss(rows.where("false"), 12).first()["pct_rows_lost"] == 0


def test_val_fallback(spark):
    make = lambda rows: spark.createDataFrame(rows, "w int, split string")
    read = lambda df: sorted(tuple(r) for r in Q.val_fallback(df).collect())
    assert read(make([(1, "train"), (2, "test")])) == [(1, "train"), (1, "val"), (2, "test")]
    full = [(1, "train"), (2, "test"), (3, "val")]
    assert read(make(full)) == sorted(full)
    assert read(make([(1, "train"), (3, "val")])) == []
    assert read(make([(2, "test")])) == []


def test_scaler_uses_population_deviation_and_leaves_constants(spark):
    rows = skewed_runs(spark).withColumn("flat", F.lit(3.0))
    scaler = Q.fit_scaler(rows, rows, ["ac_power_kw", "flat", "absent"])
    x = rows.toPandas().ac_power_kw.to_numpy().astype(float)
    table = {r["feature"]: r for r in Q.scaler_table(scaler).collect()}
    assert set(table) == {"ac_power_kw", "flat"}
    np.testing.assert_allclose(table["ac_power_kw"]["std"], x.std(), rtol=1e-12)
    scaled = Q.apply_scaler(rows, scaler, ["event_id"]).toPandas()
    assert (scaled.flat == 0).all() and abs(scaled.ac_power_kw.mean()) < 1e-6
    assert START is not None


def test_scaler_takes_all_rows_of_the_listed_files(spark):
    rows = spark.range(40_000).select(
        F.format_string("f%02d", F.col("id") % 30).alias("source_file"), F.col("id").alias("v"))
    for n in (30, 25):
        files = rows.where(F.col("source_file") < f"f{n}").select("source_file")
        x = np.array([i for i in range(40_000) if i % 30 < n], float)
        found = Q.scaler_table(Q.fit_scaler(rows, files, ["v"])).first()
        np.testing.assert_allclose([found["mean"], found["std"]], [x.mean(), x.std()], rtol=1e-9)
