"""The three user-facing flows over a batch directory: explore, train, evaluate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.operators import registry as R
from sunledger.operators import stats as X
from sunledger.operators.features import ENGINEERED, LOOKBACK, add_features
from sunledger.operators.skew import broadcast_checked
from sunledger.plans import models as P
from sunledger.plans import studies as ST
from sunledger.session import configure, settle
from sunledger.sources.config import Batch
from sunledger.sources.manifest import (
    load_manifest, save_manifest, save_model, write_metrics_csv)
from sunledger.sources.telemetry import list_batch_files, scan_batch

TARGETS = (P.DETECTION, P.CLASSIFICATION)
#: listed files whose names the scan itself is given; more are found by the join alone
NAMED_FILES = 10_000


@dataclass
class Dataset:
    """A batch with its file registry, raw rows and engineered features."""

    batch: Batch
    registry: DataFrame
    rows: DataFrame
    features: DataFrame


def open_dataset(spark: SparkSession, data_dir: str, years: Sequence[int] | None = None,
                 location_filter: str | None = None, max_runs: int | None = None,
                 lookback: int = LOOKBACK, registry: DataFrame | None = None) -> Dataset:
    """Catalogue a directory and feature its rows.

    Years are filtered before the rolling features.  Without a given registry (for
    example a loaded manifest) files are listed and split afresh.
    """
    configure(spark)
    batch = Batch.open(spark, data_dir)
    if registry is None:
        files = R.file_registry(list_batch_files(spark, data_dir, location_filter))
        registry = R.assign_splits(R.limit_runs(files, max_runs) if max_runs else files)
    registry = settle(registry)
    listed = broadcast_checked(registry.select("source_file"))
    rows = scan_batch(spark, data_dir, batch.load_columns, years, batch.pattern, location_filter,
                      batch.schema, named_files(registry))
    rows = rows.join(listed, "source_file", "left_semi")
    return Dataset(batch, registry, rows,
                   add_features(rows, batch.array_kwp, lookback=lookback))


def named_files(registry: DataFrame) -> list[str] | None:
    """Names of the registry's files, for the scan to skip all others; None if they are many."""
    names = [r[0] for r in registry.select("source_file").limit(NAMED_FILES + 1).collect()]
    return names if len(names) <= NAMED_FILES else None


def explore(data: Dataset) -> dict[str, DataFrame]:
    """The exploration tables over one settled feature table."""
    table = settle(data.features)
    scada = [c for c in data.batch.columns.get("scada", ()) if c in table.columns]
    return {
        "summary": data.batch.summary(), "fault_counts": X.fault_counts(table),
        "fault_prevalence": X.fault_prevalence(table),
        "year_fault_rate": X.year_fault_rate(table),
        "feature_describe": X.feature_describe(table, ENGINEERED),
        "feature_histogram": X.feature_histogram(table, ENGINEERED),
        "correlation_matrix": X.correlation_matrix(table, scada),
        "sample_series": X.sample_series(table), "fault_spans": X.fault_spans(X.nth_row_day(table)),
    }


def train(data: Dataset, out_dir: str, modes: Sequence[str] = ("random_forest",),
          feature_mode: str = "full", **options) -> dict[str, P.TaskResult]:
    """Both tasks on the registry's splits; models, rates and the manifest go to ``out_dir``."""
    table = settle(data.features)
    names, scada = data.batch.feature_set(feature_mode), data.batch.feature_set("scada")
    results, paths = {}, {}
    for target in TARGETS:
        result = P.run_task(table, data.registry, target, names, modes, scada=scada, **options)
        results[target], paths[target] = result, {}
        for mode, fitted in result.models.items():
            if fitted.model is not None:
                paths[target][mode] = save_model(
                    fitted.model, f"{out_dir}/models/{target}/{mode}", fitted.feature_names,
                    result.class_names, fitted.windows)
        if target == P.CLASSIFICATION and len(result.models) > 1:
            write_metrics_csv(result.per_fault_f1(), f"{out_dir}/per_fault_metrics")
    save_manifest(data.registry, f"{out_dir}/manifest", paths, {"data_dir": data.batch.data_dir})
    return results


def evaluate(spark: SparkSession, data_dir: str, out_dir: str) -> DataFrame:
    """Score the manifest's test files with its models and rank them; also written as CSV."""
    registry, _ = load_manifest(spark, f"{out_dir}/manifest")
    data = open_dataset(spark, data_dir, registry=registry.where(F.col("split") == "test"))
    table = settle(data.features)
    results = [ST.evaluate_saved(table, f"{out_dir}/manifest", t) for t in TARGETS]
    comparison = ST.compare_models([r for r in results if r.models])
    write_metrics_csv(comparison, f"{out_dir}/model_comparison")
    return comparison
