"""The file catalogue: names, splits, sites and folds.  One row per run file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sunledger.functions.expressions import (
    loc_id, parse_file_fault_type, parse_run_id, seeded_digest)
from sunledger.operators.skew import (
    broadcast_checked, global_position, hash_ordinal, with_position)
from sunledger.session import settle
from sunledger.sources.telemetry import file_order

SEED = 42


def file_registry(files: DataFrame) -> DataFrame:
    """``(source_file, run_id, file_fault_type)`` from a column of file names."""
    name = F.col("source_file")
    return (files.select("source_file").distinct()
            .select("source_file", parse_run_id(name).alias("run_id"),
                    parse_file_fault_type(name).alias("file_fault_type")))


def limit_runs(registry: DataFrame, max_runs: int) -> DataFrame:
    """At most ``max_runs`` files, balanced over fault types, first by name."""
    total, types = registry.agg(F.count(F.lit(1)), F.countDistinct("file_fault_type")).first()
    if not max_runs or total <= max_runs:
        return registry
    per_type = max(1, max_runs // types)
    by_name = Window.partitionBy("file_fault_type").orderBy("source_file")
    # Spark keeps only the first rows of each type before the shuffle
    return (registry.withColumn("_rank", F.row_number().over(by_name))
            .where(F.col("_rank") <= per_type).drop("_rank")
            .orderBy("source_file").limit(max_runs))


def assign_splits(registry: DataFrame, val_size: float = 0.20, test_size: float = 0.20,
                  seed: int = SEED, rows_per_slice: int | None = None) -> DataFrame:
    """Stratified file split; the shuffle inside a type is the seeded md5 order.

    The registry is settled: it may stand for a scan of all rows, names are parsed once a file.
    """
    registry = settle(registry)
    hashed = registry.drop("split").withColumn("_digest", seeded_digest(seed, "source_file"))
    placed = with_position(hashed, ["file_fault_type"], ["_digest", "source_file"],
                           hash_ordinal("_digest"), "_pos", rows_per_slice)
    sizes = broadcast_checked(registry.groupBy("file_fault_type").agg(
        F.count(F.lit(1)).alias("_n")))

    def share(fraction: float):
        return F.greatest(F.lit(1), F.floor(F.lit(float(fraction)) * F.col("_n")))

    n, pos = F.col("_n"), F.col("_pos")
    n_train = n - share(val_size) - share(test_size)
    split = (F.when(n >= 3, F.when(pos <= n_train, "train")
                    .when(pos <= n_train + share(val_size), "val").otherwise("test"))
             .when((n == 2) & (pos == 2), "test").otherwise("train"))
    return (placed.join(sizes, "file_fault_type").withColumn("split", split)
            .select(*registry.drop("split").columns, "split"))


def refold(pool: DataFrame, seed: int = SEED) -> DataFrame:
    """Split a pool again; only train and val are used, the last part is set aside."""
    return assign_splits(pool, seed=seed).withColumn(
        "split", F.when(F.col("split") == "test", "unused").otherwise(F.col("split")))


def split_counts(registry: DataFrame, by_type: bool = False) -> DataFrame:
    keys = ["split", "file_fault_type"] if by_type else ["split"]
    return registry.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"))


def split_leaks(registry: DataFrame) -> DataFrame:
    """Files that appear in more than one split; must be empty."""
    return (registry.groupBy("source_file")
            .agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1"))


def drop_healthy_files(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("file_fault_type") != "none")


def resolve_entries(registry: DataFrame, target: str) -> DataFrame:
    """Files of a task; no rows at all when train or test would be empty."""
    files = registry.where(F.col("split").isin("train", "val", "test"))
    if target == "fault_type":
        files = drop_healthy_files(files)
    sides = files.agg(F.max((F.col("split") == "train").cast("int")).alias("_train"),
                      F.max((F.col("split") == "test").cast("int")).alias("_test"))
    # one-row side
    return (files.crossJoin(F.broadcast(sides))
            .where((F.col("_train") == 1) & (F.col("_test") == 1)).drop("_train", "_test"))


def rows_with_split(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Attach the registry's attributes to every row of its files."""
    return rows.join(broadcast_checked(registry), "source_file")


def rows_in_years(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows whose ``sim_year`` is in their entry's ``years`` (NULL keeps every year)."""
    return rows_with_split(rows, registry).where(
        F.col("years").isNull() | F.array_contains("years", F.col("sim_year")))


def first_row_per_file(rows: DataFrame, *columns: str) -> DataFrame:
    """The given columns at the first row of each file; a partial aggregate, no sort."""
    key = F.struct(*file_order(rows))
    return (rows.groupBy("source_file")
            .agg(F.min_by(F.struct(*columns), key).alias("_first"))
            .select("source_file", *[F.col(f"_first.{c}").alias(c) for c in columns]))


def discover_sites(rows: DataFrame) -> DataFrame:
    """Distinct rounded coordinates of the files' first rows, with a fallback name."""
    first = first_row_per_file(rows, "latitude", "longitude")
    lat, lon = F.round("latitude", 2), F.round("longitude", 2)
    return (first.select(lat.alias("latitude"), lon.alias("longitude"),
                         loc_id(F.col("latitude"), F.col("longitude")).alias("site"))
            .distinct())


def file_sites(rows: DataFrame) -> DataFrame:
    """``(source_file, loc_id)`` from each file's first row."""
    first = first_row_per_file(rows, "latitude", "longitude")
    return first.select("source_file",
                        loc_id(F.col("latitude"), F.col("longitude")).alias("loc_id"))


def site_name(points: DataFrame, sites: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Name coordinates by the exact rounded site, else the first site within tolerance.

    ``points`` has distinct (latitude, longitude); ``sites`` has (site_no, site_lat,
    site_lon, site_name).  The tolerance join is an equi-join on a grid of
    ``tolerance``-wide cells (each site is placed in its nine neighbouring cells), so it
    never pairs every point with every site.
    """
    def cell(column):
        return F.floor(column / F.lit(tolerance)).cast("long")

    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    placed = (sites.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
              .withColumn("_cx", cell(F.col("site_lat")) + F.col("_dx"))
              .withColumn("_cy", cell(F.col("site_lon")) + F.col("_dy")).drop("_dx", "_dy"))
    exact = ((F.round("latitude", 2) == F.col("site_lat"))
             & (F.round("longitude", 2) == F.col("site_lon")))
    near = ((F.abs(F.col("site_lat") - F.col("latitude")) < tolerance)
            & (F.abs(F.col("site_lon") - F.col("longitude")) < tolerance))
    tagged = points.withColumns({"_cx": cell(F.col("latitude")), "_cy": cell(F.col("longitude"))})
    matched = (tagged.join(broadcast_checked(placed), ["_cx", "_cy"], "left")
               .withColumn("_exact", exact).withColumn("_hit", exact | near))
    later = F.struct(F.coalesce(~F.col("_hit"), F.lit(True)).alias("miss"),
                     F.coalesce(~F.col("_exact"), F.lit(True)).alias("near"),
                     F.col("site_no"))
    named = matched.groupBy("latitude", "longitude").agg(
        F.min_by(F.when(F.col("_hit"), F.col("site_name")), later).alias("_name"))
    fallback = F.format_string("%.2f_%.2f", F.col("latitude"), F.col("longitude"))
    return named.select("latitude", "longitude",
                        F.coalesce("_name", fallback).alias("location_name"))


def distinct_years(rows: DataFrame) -> DataFrame:
    return rows.select("sim_year").distinct()


def train_years(rows: DataFrame) -> DataFrame:
    """All years but the last."""
    years = distinct_years(rows)
    last = years.agg(F.max("sim_year").alias("_last"))
    return years.crossJoin(F.broadcast(last)).where("sim_year < _last").select("sim_year")


def temporal_folds(rows: DataFrame, registry: DataFrame, seed: int = SEED) -> DataFrame:
    """Every pool file trains on the early years and is tested on the last one.

    Returns no rows when fewer than two years exist.
    """
    pool = registry.where(F.col("split").isin("train", "val"))
    years = (rows.join(broadcast_checked(pool.select("source_file")), "source_file", "left_semi")
             .agg(F.array_sort(F.collect_set("sim_year")).alias("_years"))
             .where(F.size("_years") >= 2))
    early = F.slice("_years", F.lit(1), F.size("_years") - 1)
    latest = F.slice("_years", F.size("_years"), F.lit(1))
    keep = ["source_file", "run_id", "file_fault_type", "split"]
    train = refold(pool.select(*keep), seed).crossJoin(F.broadcast(years)).select(
        *keep, early.alias("years"))
    test = pool.withColumn("split", F.lit("test")).crossJoin(F.broadcast(years)).select(
        *keep, latest.alias("years"))
    return train.unionByName(test)


def fold_expand(registry: DataFrame, sites: DataFrame) -> DataFrame:
    """Every site held out once against every file."""
    return registry.crossJoin(
        broadcast_checked(sites.select(F.col("loc_id").alias("test_loc_id"))))


def location_folds(registry: DataFrame, sites: DataFrame, seed: int = SEED) -> DataFrame:
    """Leave one site out: ``(test_loc_id, source_file, ..., loc_id, split)``.

    Within a fold the remaining files are split again per fault type.  No rows when there
    are fewer than two sites.
    """
    pool = (registry.where(F.col("split").isin("train", "val")).drop("split")
            .join(sites, "source_file"))
    held_out = pool.select("loc_id").distinct()
    enough = held_out.agg(F.count(F.lit(1)).alias("_sites")).where("_sites >= 2")
    folds = fold_expand(pool, held_out.crossJoin(F.broadcast(enough)))
    train = folds.where(F.col("loc_id") != F.col("test_loc_id"))
    # one split per (fold, type): the fold is made part of the stratum
    stratum = F.concat_ws("\u0001", "test_loc_id", "file_fault_type")
    split = (assign_splits(train.withColumn("_type", F.col("file_fault_type"))
                           .withColumn("file_fault_type", stratum), seed=seed)
             .withColumn("file_fault_type", F.col("_type")).drop("_type")
             .withColumn("split", F.when(F.col("split") == "test", "unused")
                         .otherwise(F.col("split"))))
    test = (folds.where(F.col("loc_id") == F.col("test_loc_id"))
            .withColumn("split", F.lit("test")))
    return split.unionByName(test)


def class_balanced_batches(registry: DataFrame, files_per_batch: int) -> DataFrame:
    """Round-robin over sorted fault types, short types cycling: ``(slot, batch, ...)``.

    ``ceil(files / files_per_batch) * files_per_batch`` slots, built by a range rather
    than by walking the list.
    """
    spark = registry.sparkSession
    names = ["file_fault_type", "source_file"]
    placed = global_position(registry.select(*names), names, "_at")
    types = placed.groupBy("file_fault_type").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    # one row per fault type
    types = types.withColumn("_type", F.row_number().over(Window.orderBy("file_fault_type")) - 1)
    n_files, n_types = types.agg(F.sum("_n"), F.count(F.lit(1))).first()
    if not n_files:
        return spark.createDataFrame(
            [], "slot long, batch long, file_fault_type string, source_file string")
    slots = -(-n_files // files_per_batch) * files_per_batch
    types = broadcast_checked(types)
    turn = (spark.range(slots).withColumnRenamed("id", "slot")
            .withColumn("_type", (F.col("slot") % n_types).cast("int"))
            .withColumn("_round", F.expr(f"slot div {n_types}")))
    return (turn.join(types, "_type")
            .withColumn("_at", F.col("_from") + F.col("_round") % F.col("_n"))
            .join(placed.select("_at", "source_file"), "_at")
            .select("slot", F.expr(f"slot div {files_per_batch}").alias("batch"),
                    "file_fault_type", "source_file"))
