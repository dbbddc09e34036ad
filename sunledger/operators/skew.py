"""Ordering inside groups without ever putting an oversized group in one task.

A run file, a fault class or a model may hold a third of all rows, so a plain
``Window.partitionBy(group)`` would leave that third to one task.  The functions here
cut such groups along their sort order into slices of about ``ROWS_PER_SLICE`` rows and
give each slice what it needs from its neighbours:

* ``slice_rows``  - slice number, rows before the slice, and a halo of preceding rows
* ``with_position`` - exact 1-based position in the group
* ``prefix_sum``  - exact running total in the group
* ``take_smallest_hash`` - exact per-group quotas in a repeatable random order

Groups below the limit are untouched, and when no group exceeds it the plan is the plain
window.  Every side table is bounded by ``rows / ROWS_PER_SLICE`` and is only broadcast
after it has been counted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window, functions as F

from sunledger.session import settle

ROWS_PER_SLICE = 2_000_000
CELLS_PER_SLICE = 32
BROADCAST_ROWS = 500_000

SLICE, BASE, HALO = "_slice", "_base", "_halo"
WHOLE = -9  # a row or cell that is not divided at this level
_HASH_DIGITS = 12


def broadcast_checked(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only for a table that was counted and found small.

    Above the limit the table is returned without a hint and Spark shuffles the join.
    """
    small, rows = counted(df)
    return F.broadcast(small) if rows <= (limit or BROADCAST_ROWS) else small


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    kept = df.persist()
    return kept, kept.count()


def join_groups(left: DataFrame, right: DataFrame, keys: list[str],
                how: str = "inner") -> DataFrame:
    """Equi-join on group columns in which NULL is a group of its own."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys])
    return left.join(renamed, match, how).drop(*[f"_key_{k}" for k in keys])


def time_ordinal(column: str) -> Column:
    """Microseconds since the epoch; monotone in the timestamp (session zone is UTC)."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def hash_ordinal(digest: str) -> Column:
    """The leading digits of an md5 text as a number in [0, 1), monotone in the text."""
    head = F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("double")
    return head / F.lit(float(16 ** _HASH_DIGITS))


@dataclass
class Sliced:
    """Rows with ``_slice``, ``_base`` (rows before the slice) and ``_halo`` added."""

    rows: DataFrame
    group: list[str]
    cut: bool

    def window(self, *order):
        return Window.partitionBy(*self.group, SLICE).orderBy(*order)

    def drop_helpers(self, df: DataFrame) -> DataFrame:
        if self.cut:
            df = df.where(~F.col(HALO))
        return df.drop(SLICE, BASE, HALO)


def slice_rows(df: DataFrame, group: list[str], ordinal: Column, reach: int = 0,
               rows_per_slice: int | None = None) -> Sliced:
    """Cut oversized groups along ``ordinal``, a number monotone in the sort order.

    The range of an oversized group is divided into equal-width cells; a cell that is still
    too full is divided again between its own first and last value, so bursts are cut as
    well as even series.  Rows with equal ordinal stay together.

    With ``reach`` > 0 every slice also receives (at least) the ``reach`` rows that
    precede it, flagged ``_halo``, so a frame of up to ``reach`` preceding rows gives the
    same value as over the whole group.
    """
    target = max(rows_per_slice or ROWS_PER_SLICE, 4 * reach)
    keyed = df.withColumn("_ord", ordinal.cast("double"))
    profile = keyed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_ord").alias("_lo"), F.max("_ord").alias("_hi"))
    hot, n_hot = counted(profile.where((F.col("_n") > target) & (F.col("_hi") > F.col("_lo"))))
    if n_hot == 0:
        hot.unpersist()
        plain = (df.withColumn(SLICE, F.lit(0)).withColumn(BASE, F.lit(0).cast("long"))
                 .withColumn(HALO, F.lit(False)))
        return Sliced(plain, group, False)

    rows, levels, leaves = keyed, [], []
    bounds, n_bounds, parents = hot, n_hot, list(group)
    for level in count(1):  # a cell narrows at every level, so this ends
        cell = f"_c{level}"
        hinted = F.broadcast(bounds) if n_bounds <= BROADCAST_ROWS else bounds
        rows = (join_groups(rows, hinted, parents, "left")
                .withColumn(cell, F.coalesce(_cell(target), F.lit(WHOLE)))
                .drop("_n", "_lo", "_hi"))
        levels, parents = [*levels, cell], [*parents, cell]
        counts, _ = counted(rows.where(F.col(cell) != WHOLE).groupBy(*parents).agg(
            F.count(F.lit(1)).alias("_n"), F.min("_ord").alias("_lo"), F.max("_ord").alias("_hi")))
        # finite ranges only: others cannot be narrowed
        span = F.col("_hi") - F.col("_lo")
        crowded = F.coalesce((F.col("_n") > target) & (span > 0) & (span < float("inf")),
                             F.lit(False))
        bounds = counts.where(crowded)
        n_bounds = bounds.count()
        if n_bounds == 0:
            leaves.append(counts)
            break
        leaves.append(counts.where(~crowded))

    every = [leaf.select(*group, *[F.col(c) if c in leaf.columns else F.lit(WHOLE).alias(c)
                                   for c in levels], F.col("_n").alias("_rows"))
             for leaf in leaves]
    packed = _pack_cells(reduce(DataFrame.unionByName, every), group, levels, target, reach)
    placed = (join_groups(rows, broadcast_checked(packed), [*group, *levels], "left")
              .select(*[F.col(c) for c in df.columns],
                      F.coalesce(SLICE, F.lit(0)).alias(SLICE),
                      F.coalesce(BASE, F.lit(0)).alias(BASE),
                      F.coalesce(HALO, F.lit(False)).alias(HALO)))
    return Sliced(placed, group, True)


def _cell(target: int) -> Column:
    """Equal-width cell inside the bounds of a crowded range; NULL outside such ranges.

    Rows without ordinal come first.
    """
    n_cells = F.ceil(F.col("_n") / F.lit(float(target))) * F.lit(CELLS_PER_SLICE)
    share = (F.col("_ord") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    inside = F.least(F.floor(share * n_cells), n_cells - 1)
    return F.when(F.col("_n").isNotNull(), F.coalesce(inside, F.lit(-1).cast("long")))


def _pack_cells(counts: DataFrame, group: list[str], levels: list[str], target: int,
                reach: int) -> DataFrame:
    """Merge neighbouring cells into slices; one row per (cell, slice that reads it)."""
    along = Window.partitionBy(*group).orderBy(*levels)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    later = along.rowsBetween(1, Window.unboundedFollowing)

    starts = (counts
              .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
              .withColumn("_k", F.floor(F.col("_before") / F.lit(float(target))))
              .withColumn("_new", F.coalesce(F.col("_k") != F.lag("_k").over(along), F.lit(True)))
              .withColumn("_prev", F.max(F.when(F.col("_new"), F.col("_before"))).over(earlier))
              # every slice but the last holds `reach` rows, so one neighbour is enough
              .withColumn("_new", F.col("_new") & (
                  F.col("_prev").isNull()
                  | (F.col("_before") - F.col("_prev") >= F.lit(max(reach, 1))))))
    owned = (starts
             .withColumn(SLICE, (F.sum(F.col("_new").cast("int")).over(upto) - 1).cast("int"))
             .withColumn("_next", F.min(F.when(F.col("_new"), F.col("_before"))).over(later))
             .withColumn("_feeds", F.lit(reach > 0)
                         & (F.col("_before") + F.col("_rows") > F.col("_next") - reach)))
    read_by = F.when(F.col("_feeds"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (owned.withColumn("_step", F.explode(read_by))
            .withColumn(SLICE, F.col(SLICE) + F.col("_step"))
            .withColumn(HALO, F.col("_step") == 1)
            .withColumn(BASE, F.min("_before").over(Window.partitionBy(*group, SLICE)))
            .select(*group, *levels, SLICE, BASE, HALO))


def with_position(df: DataFrame, group: list[str], order: list, ordinal: Column,
                  out: str = "pos", rows_per_slice: int | None = None) -> DataFrame:
    """1-based position of each row in its group under ``order``."""
    sliced = slice_rows(df, group, ordinal, rows_per_slice=rows_per_slice)
    numbered = sliced.rows.withColumn(
        out, F.col(BASE) + F.row_number().over(sliced.window(*order)))
    return sliced.drop_helpers(numbered)


def prefix_sum(df: DataFrame, group: list[str], order: list, ordinal: Column, value: str,
               out: str, rows_per_slice: int | None = None) -> DataFrame:
    """Running total of ``value`` up to and including each row."""
    sliced = slice_rows(df, group, ordinal, rows_per_slice=rows_per_slice)
    return sliced.drop_helpers(slice_totals(sliced, sliced.rows, order, value, out))


def slice_totals(sliced: Sliced, rows: DataFrame, order: list, value: str,
                 out: str) -> DataFrame:
    """Running total over already sliced rows (halo rows must carry 0)."""
    frame = sliced.window(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn(out, F.sum(value).over(frame))
    if not sliced.cut:
        return summed
    per_slice = rows.groupBy(*sliced.group, SLICE).agg(F.sum(value).alias("_sum"))
    ahead = (Window.partitionBy(*sliced.group).orderBy(SLICE)
             .rowsBetween(Window.unboundedPreceding, -1))
    carried = per_slice.select(
        *sliced.group, SLICE, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_carry"))
    return (join_groups(summed, broadcast_checked(carried), [*sliced.group, SLICE], "left")
            .withColumn(out, F.col(out) + F.col("_carry")).drop("_carry"))


def take_smallest_hash(df: DataFrame, group: list[str], digest: Column, quotas: DataFrame,
                       tie: list, rows_per_slice: int | None = None) -> DataFrame:
    """Keep exactly ``quota`` rows per group, those with the smallest ``digest``.

    ``quotas`` has the group columns, ``n`` (rows in the group) and ``quota``.  A large
    group is counted by hash cell first: only rows up to the cell in which the quota is
    reached are shuffled, and only that cell is ranked.
    """
    target = rows_per_slice or ROWS_PER_SLICE
    limits = (quotas.where(F.col("quota") > 0)
              .select(*group, F.col("quota").alias("_quota"),
                      F.ceil(F.col("n") / F.lit(float(target))).cast("long").alias("_cells")))
    limits, n_groups = counted(limits)
    hinted = F.broadcast(limits) if n_groups <= BROADCAST_ROWS else limits
    rows = (join_groups(df.withColumn("_digest", digest), hinted, group)
            .withColumn("_cell", F.floor(hash_ordinal("_digest") * F.col("_cells"))))

    if limits.where(F.col("_cells") > 1).limit(1).count():
        per_cell = (rows.where(F.col("_cells") > 1).groupBy(*group, "_cell")
                    .agg(F.count(F.lit(1)).alias("_rows"), F.first("_quota").alias("_quota")))
        earlier = (Window.partitionBy(*group).orderBy("_cell")
                   .rowsBetween(Window.unboundedPreceding, -1))
        edges = (per_cell
                 .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
                 .where((F.col("_before") < F.col("_quota"))
                        & (F.col("_before") + F.col("_rows") >= F.col("_quota")))
                 .select(*group, F.col("_cell").alias("_edge"),
                         (F.col("_quota") - F.col("_before")).alias("_need")))
        rows = (join_groups(rows, broadcast_checked(edges), group, "left")
                .withColumn("_edge", F.coalesce("_edge", F.lit(0)))
                .withColumn("_need", F.coalesce("_need", F.col("_quota")))
                .where(F.col("_cell") <= F.col("_edge")))
    else:
        rows = rows.withColumn("_edge", F.lit(0)).withColumn("_need", F.col("_quota"))

    ranked = rows.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*group, "_cell").orderBy("_digest", *tie)))
    return (ranked.where((F.col("_cell") < F.col("_edge")) | (F.col("_rank") <= F.col("_need")))
            .select(*df.columns))


def global_position(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """1-based position in a total order over the whole table, by a range-partitioned sort.

    The ranged table is settled so that the recorded partition numbers cannot change.
    """
    ranged = settle(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    # one row per range partition
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_b"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (ranged.join(broadcast_checked(bases), "_part")
            .withColumn(out, F.col("_b") + within).drop("_part", "_b"))
