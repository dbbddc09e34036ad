"""The shape of the plans: pruning, one shuffle for all rolling features, no cartesian."""

import pytest

from sunledger.catalog import inputs as I
from sunledger.catalog import queries as Q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rolling_features_share_one_shuffle(spark, sf):
    text = plan(I.features(spark, sf))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_scans_read_only_what_they_need(spark, sf):
    assert "ReadSchema: struct<event_type:string>" in plan(Q.class_counts(spark, sf).where(
        "target = 'fault_active'"))
    assert "ReadSchema: struct<user_id:bigint>" in plan(Q.file_row_counts(spark, sf))
    text = plan(Q.downcast_rows(spark, sf))
    assert "l_shipdate" not in text and "l_returnflag" not in text


def test_windows_reuse_the_file_partitioning(spark, sf):
    assert plan(Q.sequence_windows(spark, sf)).count("Exchange") == 1


@pytest.mark.parametrize("name", ["site_name", "rows_with_split", "merge_reports", "fault_spans",
                                  "confusion_matrix", "stratified_subsample", "thin_majority"])
def test_no_cartesian_products(spark, sf, name):
    text = plan(Q.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text


def test_top_n_is_not_a_global_window(spark, sf):
    text = plan(Q.nth_row_day(spark, sf))
    assert "TakeOrderedAndProject" in text
