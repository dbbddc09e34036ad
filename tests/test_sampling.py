import pytest
from helpers import skewed_runs
from pyspark.sql import functions as F

from sunledger.operators import sampling as S


def flagged(spark, counts):
    """``{file: (n_true, n_false)}`` as rows."""
    rows, at = [], 0
    for name, (yes, no) in counts.items():
        for flag, n in ((True, yes), (False, no)):
            for _ in range(n):
                rows.append((name, at, flag))
                at += 1
    return spark.createDataFrame(rows, "source_file string, event_id long, fault_active boolean")


@pytest.mark.parametrize("limit", [None, 6])
def test_thinning_sizes(spark, limit):
    table = flagged(spark, {"tie": (4, 4), "true": (40, 3), "false": (2, 41), "one": (1, 0),
                            "few": (3, 1)})
    got = {(r[0], r[1]): r[2] for r in S.thin_majority(table, 4, rows_per_slice=limit).groupBy(
        "source_file", "fault_active").count().collect()}
    assert got == {("tie", True): 1, ("tie", False): 4, ("true", True): 10, ("true", False): 3,
                   ("false", True): 2, ("false", False): 10, ("one", True): 1,
                   ("few", True): 1, ("few", False): 1}
    assert S.thin_majority(table, 1) is table


def classes(spark, sizes):
    rows = [(i, kind) for kind, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([(at, k) for at, (_, k) in enumerate(rows)],
                                 "event_id long, fault_type string")


@pytest.mark.parametrize("limit", [None, 50])
def test_stratified_quotas_sum_to_the_cap(spark, limit):
    table = classes(spark, {"a": 600, "b": 300, "c": 101})
    got = {r[0]: r[1] for r in S.stratified_subsample(
        table, 100, "fault_type", rows_per_slice=limit).groupBy("fault_type").count().collect()}
    assert sum(got.values()) == 100
    assert got == {"a": 60, "b": 30, "c": 10}


def test_small_tables_are_returned_whole(spark):
    table = classes(spark, {"a": 5, "b": 5})
    assert S.stratified_subsample(table, 10, "fault_type") is table


@pytest.mark.parametrize("limit", [None, 50])
def test_rare_class_falls_back_to_plain_random(spark, limit):
    table = classes(spark, {"a": 1, "b": 2, "c": 1000})
    got = S.stratified_subsample(table, 200, "fault_type", rows_per_slice=limit)
    assert got.count() == 200 and got.columns == table.columns
    assert S.stratified_subsample(table, 200, None).count() == 200


def test_sampling_is_repeatable_and_follows_the_seed(spark):
    table = classes(spark, {"a": 500, "b": 500})
    pick = lambda t, seed: {r[0] for r in S.stratified_subsample(
        t, 100, "fault_type", seed).select("event_id").collect()}
    assert pick(table, 1) == pick(table.repartition(7), 1)
    assert pick(table, 1) != pick(table, 2)


def test_class_counts_and_weights(spark):
    rows = skewed_runs(spark)
    labels = S.label_table(rows)
    assert [(r[0], r[1]) for r in labels.orderBy("label").collect()] == [
        ("click", 0), ("error", 1), ("signup", 2)]
    counts = S.class_counts(rows, "fault_type", labels)
    total = rows.where("fault_active").count()
    assert counts.agg(F.sum("n")).first()[0] == total
    wide = labels.union(spark.createDataFrame([("zzz", 3)], labels.schema))
    balanced = {r["label"]: r for r in S.balanced_weights(counts, wide).collect()}
    assert balanced[3]["weight"] == 1 and balanced[3]["n"] == 0
    assert all(abs(balanced[k]["weight"] * balanced[k]["n"] - total / 4) < 1e-9 for k in range(3))
    sequence = {r["label"]: r["weight"] for r in S.sequence_weights(counts, wide).collect()}
    assert sequence[3] == total / 4
    with pytest.raises(ValueError):
        S.class_counts(rows, "fault_type")


def test_detection_counts_leave_absent_classes_out(spark):
    table = flagged(spark, {"x": (3, 0)})
    assert [tuple(r) for r in S.class_counts(table, "fault_active").collect()] == [(1, 3)]


def test_known_and_unseen(spark):
    rows = skewed_runs(spark).where("fault_active")
    labels = spark.createDataFrame([("click", 0)], "fault_type string, label int")
    known = S.known_rows(rows, labels).count()
    dropped = S.unseen_counts(rows, labels).agg(F.sum("n_dropped")).first()[0]
    assert known + dropped == rows.count() and known and dropped
    assert {r[0] for r in S.missing_classes(S.label_table(rows), S.known_rows(
        rows, labels)).collect()} == {"error", "signup"}


def test_load_split(spark):
    rows = skewed_runs(spark)
    files = rows.where("source_file like 'r%'").select("source_file").distinct()
    whole = S.load_split(rows, files)
    assert whole.count() == rows.where("source_file like 'r%'").count()
    assert S.load_split(rows, files, cap=50, thin_factor=2).count() == 50
    assert S.load_split(rows, files.where("false")).count() == 0


@pytest.mark.parametrize("limit", [None, 40])
def test_missing_class_names_are_a_class_of_their_own(spark, limit):
    table = classes(spark, {"a": 300, "b": 100}).withColumn(
        "fault_type", F.when(F.col("fault_type") == "a", F.col("fault_type")))
    got = {r[0]: r[1] for r in S.stratified_subsample(
        table, 100, "fault_type", rows_per_slice=limit).groupBy("fault_type").count().collect()}
    assert got == {"a": 75, None: 25}


def test_quotas_of_very_large_classes_do_not_overflow(spark):
    counts = spark.createDataFrame([("a", 1_200_000_000_000), ("b", 400_000_000_000)],
                                   "label string, n long")
    got = {r["label"]: r["quota"] for r in S.stratified_quotas(counts, "label", 10_000_000).collect()}
    assert got == {"a": 7_500_000, "b": 2_500_000}
