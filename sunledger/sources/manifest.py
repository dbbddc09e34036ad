"""Manifests, models and metric tables on storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST_VERSION = 1
REGISTRY_SCHEMA = ("source_file string, run_id string, file_fault_type string, split string, "
                   "path string, years array<int>, lookback int")
HEADER_SCHEMA = ("version int, n_entries long, columns array<string>, "
                 "model_paths map<string, map<string, string>>, extra map<string, string>")
#: columns of every registry; the others are kept where a registry has them
ENTRY = ("source_file", "run_id", "file_fault_type", "split")


def save_manifest(registry: DataFrame, path: str, model_paths: dict | None = None,
                  extra: dict | None = None) -> str:
    """Write the split registry as JSON lines next to a one-row header.

    An entry keeps its path, the years its rows are restricted to and its rolling look-back, if
    the registry has them.  The entries are written by the executors, so the size of the batch
    does not matter.
    """
    spark = registry.sparkSession
    names = [n for n in (f.split()[0] for f in REGISTRY_SCHEMA.split(", "))
             if n in ENTRY or n in registry.columns]
    registry.select(*names).write.mode("overwrite").json(f"{path}/registry")
    n_entries = spark.read.schema(REGISTRY_SCHEMA).json(f"{path}/registry").count()
    header = (MANIFEST_VERSION, n_entries, names,
              {k: dict(v) for k, v in (model_paths or {}).items()},
              {k: str(v) for k, v in (extra or {}).items()})
    spark.createDataFrame([header], HEADER_SCHEMA).coalesce(1).write.mode("overwrite").json(
        f"{path}/header")
    return path


def load_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The registry with its splits, and the header (model paths and extras)."""
    registry = spark.read.schema(REGISTRY_SCHEMA).json(f"{path}/registry")
    header = spark.read.schema(HEADER_SCHEMA).json(f"{path}/header").first().asDict()
    header["model_paths"] = header["model_paths"] or {}
    header["extra"] = header["extra"] or {}
    return registry.select(*(header["columns"] or ENTRY)), header


_NAMES = "features array<string>, classes array<string>"
_WINDOWS = "mode string, size int, stride int"


def save_model(model: PipelineModel, path: str, feature_names: list[str],
               class_names: list[str], windows=None) -> str:
    """A fitted pipeline with the feature and class names it was fitted on.

    ``windows`` (mode, size, stride and a one-row ``scaler``) is stored with a model of windows.
    """
    model.write().overwrite().save(f"{path}/pipeline")
    row = [(list(feature_names), list(class_names))]
    model_spark().createDataFrame(row, _NAMES).coalesce(1).write.mode("overwrite").json(
        f"{path}/names")
    cut = [(windows.mode, windows.size, windows.stride)] if windows else []
    model_spark().createDataFrame(cut, _WINDOWS).coalesce(1).write.mode("overwrite").json(
        f"{path}/windows")
    if windows:
        windows.scaler.coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
    return path


def load_model(path: str) -> tuple[PipelineModel, list[str], list[str]]:
    row = model_spark().read.schema(_NAMES).json(f"{path}/names").first()
    return PipelineModel.load(f"{path}/pipeline"), row["features"], row["classes"]


def load_windows(path: str) -> tuple[str, int, int, DataFrame] | None:
    """Mode, size, stride and scaler of a stored model of windows; None for other models."""
    row = model_spark().read.schema(_WINDOWS).json(f"{path}/windows").first()
    if row is None:
        return None
    return row["mode"], row["size"], row["stride"], model_spark().read.parquet(f"{path}/scaler")


def model_spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def write_metrics_csv(metrics: DataFrame, path: str) -> str:
    metrics.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def manifest_round_trip(registry: DataFrame, path: str) -> DataFrame:
    """Registry rows as they come back from a manifest, with the header's entry count."""
    save_manifest(registry, path)
    loaded, header = load_manifest(registry.sparkSession, path)
    return loaded.withColumn("n_entries", F.lit(header["n_entries"]).cast("long"))
