import datetime as dt

import numpy as np
import pytest
from helpers import START, skewed_runs
from pyspark.sql import functions as F

from sunledger.operators import stats as X

NAMES = ["poa_global_wm2", "ac_power_kw", "dc_power_kw"]


def test_describe_equals_pandas(spark, monkeypatch):
    rows = skewed_runs(spark).withColumn(
        "poa_global_wm2", F.when(F.col("event_id") % 9 > 0, F.col("poa_global_wm2")))
    want = rows.toPandas()[NAMES].astype(float).describe()
    for accuracy in (10_000, 10):
        monkeypatch.setattr(X, "SKETCH", accuracy)
        for r in X.feature_describe(rows, NAMES, digits=9).collect():
            got = [r[c] for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")]
            np.testing.assert_allclose(got, want[r["feature"]], rtol=1e-8, atol=1e-8)


def test_describe_of_flat_and_empty_features(spark):
    rows = spark.range(50).select(F.lit(2.0).alias("flat"), F.lit(None).cast("float").alias("none"))
    got = {r["feature"]: r for r in X.feature_describe(rows, ["flat", "none"]).collect()}
    assert got["flat"]["q25"] == got["flat"]["q50"] == 2.0 and got["flat"]["std"] == 0
    assert got["none"]["count"] == 0 and got["none"]["q50"] is None


@pytest.mark.parametrize("shape", ["outlier", "ties", "steps"])
def test_brackets_hold_few_rows_however_values_are_spread(spark, monkeypatch, shape):
    monkeypatch.setattr(X, "SKETCH", 1000)
    noise = F.xxhash64("id") / F.lit(2.0 ** 40)
    value = {"outlier": F.when(F.col("id") == 7, F.lit(1e12)).otherwise(noise / 2 ** 23),
             "ties": F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(noise),
             "steps": F.exp(F.col("id") / 3000.0)}[shape]
    rows = X.settle(spark.range(60_000).repartition(7).select(value.alias("v")))
    x = rows.toPandas().v
    basic = X.feature_stats(rows, ["v"], X.bracket_edges(X.QUARTILES))
    sketch = basic.first()["sketch"]
    brackets = {("v", q): (sketch[2 * i], sketch[2 * i + 1]) for i, q in enumerate(X.QUARTILES)}
    inside = X.bracket_values(rows, brackets).where("value is not null")
    assert inside.groupBy("fraction").count().agg(F.max("count")).first()[0] < 60_000 * 8 / 1000
    got = X.feature_describe(rows, ["v"], digits=9).first()
    np.testing.assert_allclose([got["q25"], got["q50"], got["q75"]],
                               [x.quantile(q) for q in X.QUARTILES], rtol=1e-9, atol=1e-8)


def test_a_rank_outside_its_bracket_is_found_among_all_values(spark):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    edges = F.array(*[F.lit(900.0), F.lit(950.0)])
    stats = X.feature_stats(rows, ["v"]).withColumn("sketch", edges)
    assert X.exact_quantiles(rows, ["v"], stats, [0.5]).first()["value"] == 499.5


def test_histogram_equals_numpy(spark):
    rows = skewed_runs(spark).withColumn("flat", F.lit(1.0))
    frame = rows.toPandas()
    got = X.feature_histogram(rows, ["ac_power_kw", "flat"]).toPandas()
    for flag in (True, False):
        for name in ("ac_power_kw", "flat"):
            part = got[(got.feature == name) & (got.fault_active == flag)].sort_values("bin")
            x = frame[frame.fault_active == flag][name].to_numpy().astype(float)
            n, edges = np.histogram(x, bins=50)
            density, _ = np.histogram(x, bins=50, density=True)
            assert list(part.n) == list(n)
            np.testing.assert_allclose(part.density, density, rtol=1e-9)
            np.testing.assert_allclose(part.bin_start, edges[:-1], rtol=1e-9, atol=1e-9)


def test_correlation_equals_pandas(spark):
    rows = skewed_runs(spark)
    want = rows.toPandas()[[*NAMES, "fault_active"]].astype(float).corr()
    got = X.correlation_matrix(rows, NAMES).collect()
    assert len(got) == 16
    for r in got:
        assert abs(r["correlation"] - want.loc[r["feature_a"], r["feature_b"]]) < 1e-9


@pytest.mark.parametrize("limit", [None, 5, 30])
def test_fault_spans(spark, limit):
    rows = skewed_runs(spark)
    want = set()
    for name, run in rows.toPandas().groupby("source_file"):
        run = run.sort_values(["timestamp", "event_id"])
        island = (run.fault_active != run.fault_active.shift()).cumsum()
        for _, part in run[run.fault_active].groupby(island[run.fault_active]):
            want.add((name, part.timestamp.iloc[0], part.timestamp.iloc[-1], len(part)))
    got = X.fault_spans(rows, limit).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_flapping_fault_has_one_span_per_row(spark):
    rows = spark.createDataFrame(
        [("a", i, START + dt.timedelta(minutes=i), i % 2 == 0) for i in range(9)],
        "source_file string, event_id long, timestamp timestamp_ntz, fault_active boolean")
    assert [r["n_rows"] for r in X.fault_spans(rows).collect()] == [1] * 5


def test_constant_columns(spark):
    rows = spark.createDataFrame(
        [(i, 1.0, None, None if i else 2.0, float(i), [1], {"a": 1}) for i in range(5)],
        "k int, same double, empty string, half double, varied double, list array<int>, "
        "pairs map<string, int>")
    got = {r[0] for r in X.constant_columns(rows, rows.columns, ["k"]).collect()}
    assert got == {"same", "empty", "list"}
    # a change outside the head and tail is only seen when every row is read
    late = rows.withColumn("same", F.when(F.col("k") == 2, 9.0).otherwise(1.0))
    assert "same" in {r[0] for r in X.constant_columns(late, ["same"], ["k"], 2).collect()}
    assert X.constant_columns(late, ["same"], ["k"], None).count() == 0


def test_series_of_the_nth_row(spark):
    rows = skewed_runs(spark).withColumn("performance_ratio", F.lit(1.0))
    frame = rows.toPandas().sort_values(["source_file", "timestamp", "event_id"])
    day = frame.sim_day.iloc[100]
    got = X.sample_series(rows).toPandas()
    assert len(got) == (frame.sim_day == day).sum() and got.timestamp.is_monotonic_increasing
    assert X.nth_row(rows, 10 ** 6).count() == 0


def test_counts(spark):
    rows = skewed_runs(spark)
    table = X.fault_counts(rows).collect()
    faulted = rows.where("fault_active").count()
    assert sum(r["n"] for r in table if r["kind"] == "fault_type") == faulted
    both = X.fault_prevalence(rows).first()
    assert both["healthy"] + both["faulted"] == rows.count()
    assert abs(both["healthy_pct"] + both["faulted_pct"] - 100) < 1e-9
    assert X.fault_prevalence(rows.where("false")).first()["faulted_pct"] is None
    assert X.year_fault_rate(rows).agg(F.sum("n_rows")).first()[0] == rows.count()
