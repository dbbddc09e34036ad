"""Positions inside groups of any size, and small tables whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sunledger.operators.skew import join_groups
from sunledger.session import settle

#: most rows of a table that is sent to all executors
BROADCAST_ROWS = 200_000


def ranked(df: DataFrame, group: list[str], order: list[str], out: str = "pos") -> DataFrame:
    """The rows with ``out``: their 0-based place in their group (NULL is a group, NULLs first).

    Rows are range-partitioned by group and order, so a group of any size, also one of equal
    rows only, lies in several tasks.  A range part continues at most one group from the parts
    before it: the table of rows ahead of a part has no more rows than there are parts, and
    it alone is sent to all tasks.  ``df`` is read twice, so it should be settled.
    """
    ties = df.withColumn("_tie", F.monotonically_increasing_id())
    ranged = settle(ties.repartitionByRange(*group, *order, "_tie")
                    .withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    ahead = (sizes.withColumn("_ahead", F.sum("_rows").over(before))
             .where(F.col("_ahead").isNotNull()).drop("_rows"))
    within = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order, "_tie"))
    # at most one row per range part
    return (join_groups(ranged, F.broadcast(ahead), [*group, "_part"], "left")
            .withColumn(out, F.coalesce("_ahead", F.lit(0).cast("long")) + within - 1)
            .drop("_tie", "_part", "_ahead"))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The settled table, hinted as a broadcast only if it was counted and has few rows."""
    kept = settle(df)
    return F.broadcast(kept) if kept.count() <= limit else kept
