import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunledger.catalog import inputs as I
from sunledger.plans import flows
from sunledger.session import scratch_path

SMALL = {"random_forest": {"numTrees": 5, "maxDepth": 5, "minInstancesPerNode": 2}}


@pytest.fixture(scope="module")
def run_dir(spark, sf, tmp_path_factory):
    """The adapted events written as one parquet file per run."""
    folder = tmp_path_factory.mktemp("runs")
    frame = I.rows(spark, sf, extended=True).drop("event_id", "unit_id").toPandas()
    for name, part in frame.groupby("source_file"):
        part.drop(columns="source_file").sort_values("timestamp").to_parquet(
            folder / name, index=False)
    return str(folder)


def test_explore_train_evaluate(spark, sf, run_dir):
    data = flows.open_dataset(spark, run_dir)
    assert data.registry.count() == 15
    tables = flows.explore(data)
    assert tables["fault_prevalence"].first()["faulted"] == data.features.where(
        "fault_active").count()
    assert tables["feature_histogram"].agg(F.sum("n")).first()[0] == 8 * data.features.count()
    for name, table in tables.items():
        assert table.count(), name
    # the same values as over the events table
    direct = I.add_features(I.rows(spark, sf), data.batch.array_kwp).select(
        "source_file", "timestamp", "pr_deviation", "power_step").toPandas()
    scanned = data.features.select("source_file", "timestamp", "pr_deviation",
                                   "power_step").toPandas()
    both = pd.merge(direct, scanned, on=["source_file", "timestamp"])
    assert len(both) == len(direct) == len(scanned)
    np.testing.assert_array_equal(both.pr_deviation_x, both.pr_deviation_y)
    np.testing.assert_array_equal(both.power_step_x, both.power_step_y)

    out = scratch_path(spark, "out")
    results = flows.train(data, out, tabular_params=SMALL, majority_thin_factor=2)
    assert results["fault_active"].aucs()["random_forest"] > 0.95
    assert "random_forest_deployment" in results["fault_type"].models
    ranked = {(r["task"], r["model"]): r["auc"] for r in flows.evaluate(spark, run_dir, out).collect()}
    for target, result in results.items():
        for mode, auc in result.aucs().items():
            assert ranked[target, mode] == auc


def test_years_and_run_limit(spark, run_dir):
    data = flows.open_dataset(spark, run_dir, years=[2], max_runs=6)
    assert data.registry.count() <= 6
    assert [r[0] for r in data.features.select("sim_year").distinct().collect()] == [2]
