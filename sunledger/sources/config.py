"""The batch description: JSON config, sites, capacity and column roles."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sunledger.functions.columns import category_lists, classify_columns, feature_set
from sunledger.functions.expressions import loc_id
from sunledger.operators.registry import first_row_per_file
from sunledger.operators.stats import estimate_capacity
from sunledger.sources.footers import column_bounds, constant_columns, highest, read_footers
from sunledger.sources.telemetry import (
    RUN_PATTERNS, batch_pattern, list_files, scan_batch, schema_file)

CONFIG_SCHEMA = (
    "installation_fixed struct<array_power_kWp: double, system_area_m2: double>, "
    "stc_parameters struct<efficiency: double>, "
    "sweep_summary struct<locations: array<struct<lat: double, lon: double, name: string>>>")


def read_batch_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(path)


def config_capacity(config: DataFrame) -> DataFrame:
    """Stated capacity, else area times efficiency when both are positive."""
    area = F.col("installation_fixed.system_area_m2")
    efficiency = F.col("stc_parameters.efficiency")
    derived = F.when((area > 0) & (efficiency > 0), area * efficiency)
    return config.select(
        F.coalesce("installation_fixed.array_power_kWp", derived).alias("array_kwp"))


def config_sites(config: DataFrame) -> DataFrame:
    """``(site_no, site_lat, site_lon, site_name)``; the name ends at its first comma.

    Two entries that round to the same place are one site: the first keeps the number,
    the last gives the name.
    """
    listed = config.select(F.posexplode("sweep_summary.locations").alias("site_no", "_l"))
    lat = F.round(F.coalesce("_l.lat", F.lit(0.0)), 2)
    lon = F.round(F.coalesce("_l.lon", F.lit(0.0)), 2)
    fallback = F.concat_ws("_", lat.cast("string"), lon.cast("string"))
    name = F.trim(F.split_part(F.coalesce("_l.name", fallback), F.lit(","), F.lit(1)))
    return (listed.select("site_no", lat.alias("site_lat"), lon.alias("site_lon"),
                          name.alias("site_name"))
            .groupBy("site_lat", "site_lon")
            .agg(F.max_by("site_name", "site_no").alias("site_name"),
                 F.min("site_no").alias("site_no"))
            .select("site_no", "site_lat", "site_lon", "site_name"))


def discovered_sites(rows: DataFrame) -> DataFrame:
    """Sites found in the data, in the order of their first file."""
    first = first_row_per_file(rows, "latitude", "longitude")
    lat, lon = F.round("latitude", 2), F.round("longitude", 2)
    return (first.groupBy(lat.alias("site_lat"), lon.alias("site_lon"))
            .agg(F.min("source_file").alias("site_no"))
            .select("site_no", "site_lat", "site_lon",
                    loc_id(F.col("site_lat"), F.col("site_lon")).alias("site_name")))


@dataclass
class Batch:
    """A batch directory: capacity, sites and column roles, read once."""

    spark: SparkSession
    data_dir: str
    pattern: str = "*_noisy.parquet"
    array_kwp: float | None = None
    columns: dict[str, list[str]] = field(default_factory=dict)
    sites: DataFrame | None = None
    schema: T.StructType | None = None

    @classmethod
    def open(cls, spark: SparkSession, data_dir: str) -> Batch:
        first = schema_file(spark, data_dir).first()
        # the schema of one file holds for the whole batch
        schema = spark.read.parquet(first["path"]).schema
        pattern = batch_pattern(spark, data_dir, (*RUN_PATTERNS, "*.parquet"))
        runs = scan_batch(spark, data_dir, pattern=pattern, schema=schema)
        # footers decide most columns; only those they leave open are scanned
        files = list_files(spark, data_dir, pattern)
        bounds = column_bounds(read_footers(files), schema)
        constants = constant_columns(files, runs, schema, bounds)
        batch = cls(spark, data_dir, pattern, schema=schema, columns=category_lists(
            classify_columns(runs.select(*schema.names), constants)))
        has_config = spark.read.format("binaryFile").option(
            "pathGlobFilter", "batch_config.json").load(data_dir).select("path").limit(1).count()
        if has_config:
            config = read_batch_config(spark, f"{data_dir}/batch_config.json")
            batch.array_kwp = config_capacity(config).first()["array_kwp"]
            batch.sites = config_sites(config)
        if batch.sites is None or not batch.sites.limit(1).count():
            batch.sites = discovered_sites(scan_batch(
                spark, data_dir, ["latitude", "longitude"], pattern="*.parquet", schema=schema))
        if batch.array_kwp is None and "dc_power_kw" in schema.names:
            most = highest(bounds, "dc_power_kw")
            batch.array_kwp = estimate_capacity(runs if most is None else spark.range(1).select(
                F.lit(most).cast("float").alias("dc_power_kw"))).first()["array_kwp"]
        return batch

    def feature_set(self, mode: str = "full") -> list[str]:
        return feature_set(self.columns, mode)

    @property
    def load_columns(self) -> list[str]:
        kinds = ("scada", "iv_curve", "stress", "meta", "label")
        return sorted(c for k in kinds for c in self.columns.get(k, ()))

    def summary(self) -> DataFrame:
        return batch_summary(self.sites, self.columns, F.lit(self.array_kwp))


def batch_summary(sites: DataFrame, lists: dict[str, list[str]], capacity: Column) -> DataFrame:
    """Capacity, number of sites and of features per category, in one row."""
    sizes = {k: len(lists.get(k, ())) for k in ("scada", "iv_curve", "stress")}
    return sites.agg(F.count(F.lit(1)).alias("n_sites")).select(
        capacity.cast("double").alias("array_kwp"), "n_sites",
        *[F.lit(n).alias(f"n_{k}") for k, n in sizes.items()],
        reduce(lambda a, b: a + b, [F.lit(n) for n in sizes.values()]).alias("n_features"))
