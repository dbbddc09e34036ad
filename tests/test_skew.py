import numpy as np
import pytest
from helpers import skewed_runs
from pyspark.sql import Window, functions as F

from sunledger.functions.expressions import seeded_digest
from sunledger.operators import skew
from sunledger.operators.skew import (
    global_position, hash_ordinal, prefix_sum, slice_rows, take_smallest_hash, time_ordinal,
    with_position)

ORDER = ["timestamp", "event_id"]


@pytest.mark.parametrize("limit", [8, 25, 100])
def test_position_in_cut_groups_equals_plain_window(spark, limit):
    rows = skewed_runs(spark)
    plain = rows.withColumn("want", F.row_number().over(
        Window.partitionBy("source_file").orderBy(*ORDER)))
    got = with_position(plain, ["source_file"], ORDER, time_ordinal("timestamp"), "pos", limit)
    assert got.count() == rows.count()
    assert got.where("pos <> want").count() == 0


def test_slices_are_bounded_and_halo_holds_the_preceding_rows(spark):
    rows = skewed_runs(spark, hot=400)
    cut = slice_rows(rows, ["source_file"], time_ordinal("timestamp"), reach=5,
                     rows_per_slice=40)
    assert cut.cut
    hot = cut.rows.where("source_file = 'hot_noisy.parquet'").toPandas()
    owned = hot[~hot["_halo"]]
    assert len(owned) == 400 and owned.event_id.is_unique
    assert owned.groupby("_slice").size().max() <= 2 * 40
    assert owned["_slice"].nunique() >= 5
    for number, part in owned.groupby("_slice"):
        halo = hot[(hot["_slice"] == number) & hot["_halo"]]
        first = part.event_id.min()
        need = {i for i in range(first - 5, first) if i >= 0}
        assert need <= set(halo.event_id)


def test_crowded_times_are_cut_finer(spark):
    # nearly all rows lie in one second of a long run
    rows = spark.range(2000).select(
        F.lit("a").alias("g"), "id",
        F.when(F.col("id") == 0, 0.0).when(F.col("id") == 1, 1e6)
        .otherwise(5e5 + F.col("id") / 2000.0).alias("t"))
    cut = slice_rows(rows, ["g"], F.col("t"), rows_per_slice=500)
    assert cut.rows.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 1000
    got = with_position(rows, ["g"], ["t"], F.col("t"), "pos", 500).toPandas()
    want = got.sort_values("t").reset_index(drop=True)
    assert list(want.pos) == list(range(1, 2001))


def test_prefix_sum_across_slices(spark):
    rows = skewed_runs(spark).withColumn("v", F.col("event_id") % 7)
    got = prefix_sum(rows, ["source_file"], ORDER, time_ordinal("timestamp"), "v", "s",
                     20).toPandas()
    for _, run in got.groupby("source_file"):
        run = run.sort_values(ORDER)
        assert list(run.s) == list(run.v.cumsum())


def test_without_oversized_group_the_plan_is_the_plain_window(spark):
    rows = skewed_runs(spark)
    got = with_position(rows, ["source_file"], ORDER, time_ordinal("timestamp"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("limit", [10, 45, 10_000])
def test_hash_quota_equals_full_ranking(spark, limit):
    rows = skewed_runs(spark)
    sizes = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    quotas = sizes.withColumn("quota", F.expr("n div 3")).cache()
    digest = seeded_digest(42, "event_id")
    got = take_smallest_hash(rows, ["source_file"], digest, quotas, ["event_id"], limit)
    ranked = rows.withColumn("r", F.row_number().over(
        Window.partitionBy("source_file").orderBy(digest, "event_id"))).join(quotas, "source_file")
    want = {r[0] for r in ranked.where("r <= quota").select("event_id").collect()}
    kept = [r[0] for r in got.select("event_id").collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want


def test_hash_ordinal_follows_the_text(spark):
    table = spark.range(500).withColumn("d", F.md5(F.col("id").cast("string"))).withColumn(
        "h", hash_ordinal("d")).toPandas().sort_values("d")
    assert np.all(np.diff(table.h) >= 0) and table.h.between(0, 1).all()


def test_global_position(spark):
    names = spark.range(1000).select(F.concat(F.lit("f"), (F.col("id") * 7919 % 1000)).alias("x"))
    got = global_position(names, ["x"], "at").toPandas().sort_values("x")
    assert list(got["at"]) == list(range(1, 1001))


def test_broadcast_falls_back_to_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = skewed_runs(spark)
        got = with_position(rows, ["source_file"], ORDER, time_ordinal("timestamp"), "pos", 25)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        want = rows.withColumn("want", F.row_number().over(
            Window.partitionBy("source_file").orderBy(*ORDER))).select("event_id", "want")
        assert got.join(want, "event_id").where("pos <> want").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
