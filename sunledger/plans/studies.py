"""Temporal, leave-one-site-out and feature-ablation studies, and saved-model evaluation."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.functions.columns import ABLATION_SETS, feature_set
from sunledger.operators import registry as R
from sunledger.operators.features import add_features
from sunledger.operators.skew import broadcast_checked
from sunledger.plans.models import (
    CLASSIFICATION, DETECTION, ModelResult, Task, TaskResult, WindowSpec, run_task, score,
    score_windows, split_rows, task_matrix)
from sunledger.session import settle
from sunledger.sources.manifest import load_manifest, load_model, load_windows

#: model runs of a study that are in flight at the same time
PARALLELISM = 4


def run_each(spark: SparkSession, work: Callable, items: Sequence, parallelism: int) -> list:
    """Results of ``work(*item)`` in order; independent model runs share the cluster."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(work), *item) for item in items]
        return [job.result() for job in jobs]


def fold_aucs(features: DataFrame, folds: Mapping[str, DataFrame], names: Sequence[str],
              modes: Sequence[str], parallelism: int, **options) -> DataFrame:
    """One row per fold and mode: the AUC of either task, NULL where it is undefined."""
    def rows(fold: str, target: str) -> list[tuple]:
        result = run_task(features, folds[fold], target, names, modes, **options)
        return [(fold, mode, target, auc) for mode, auc in result.aucs().items()]

    spark = features.sparkSession
    runs = run_each(spark, rows, [(f, t) for f in folds for t in (DETECTION, CLASSIFICATION)],
                    parallelism)
    long = spark.createDataFrame([row for run in runs for row in run],
                                 "fold string, model_mode string, task string, auc double")
    return long.groupBy("fold", "model_mode").agg(*[
        F.max(F.when(F.col("task") == task, F.col("auc"))).alias(name)
        for task, name in ((DETECTION, "detection_auc"), (CLASSIFICATION, "classification_auc"))])


def temporal_features(rows: DataFrame, array_kwp: float | None,
                      registry: DataFrame) -> DataFrame:
    """Features whose rolling state starts again at the last year of the pool's files.

    Early years never look ahead, so this one table equals featuring the early and the
    last years apart.
    """
    # one-row side
    pool = registry.where(F.col("split").isin("train", "val")).select("source_file")
    last = F.broadcast(rows.join(pool, "source_file", "left_semi").agg(
        F.max("sim_year").alias("_last")))
    marked = rows.crossJoin(last).withColumn("_late", F.col("sim_year") >= F.col("_last"))
    return add_features(marked, array_kwp, restart=["_late"]).drop("_late", "_last")


def temporal_split_study(rows: DataFrame, array_kwp: float | None, registry: DataFrame,
                         names: Sequence[str], modes: Sequence[str] = ("random_forest",),
                         parallelism: int = PARALLELISM, **options) -> DataFrame:
    """Train on the early years of every pool file, test on the last year."""
    folds = settle(R.temporal_folds(rows, registry).where(F.col("split") != "unused"))
    filled = {"last year": folds} if folds.limit(1).count() else {}
    features = settle(temporal_features(rows, array_kwp, registry)) if filled else rows
    return fold_aucs(features, filled, names, modes, parallelism, **options).drop("fold")


def cross_location_study(features: DataFrame, registry: DataFrame, file_sites: DataFrame,
                         site_names: DataFrame, names: Sequence[str],
                         modes: Sequence[str] = ("random_forest",),
                         parallelism: int = PARALLELISM, **options) -> DataFrame:
    """Hold out one site at a time; a site whose AUC is undefined keeps a NULL."""
    folds = settle(R.location_folds(registry, file_sites).where(F.col("split") != "unused"))
    sites = [r["test_loc_id"] for r in
             folds.select("test_loc_id").distinct().orderBy("test_loc_id").collect()]
    # one model run per held-out site and task
    by_site = {s: folds.where(F.col("test_loc_id") == s) for s in sites}
    results = fold_aucs(features, by_site, names, modes, parallelism,
                        **options).withColumnRenamed("fold", "test_loc_id")
    lat, lon = (F.split_part("test_loc_id", F.lit("_"), F.lit(i)).cast("double") for i in (1, 2))
    points = results.select(lat.alias("latitude"), lon.alias("longitude")).distinct()
    named = R.site_name(points, site_names)
    return (results.withColumns({"latitude": lat, "longitude": lon})
            .join(broadcast_checked(named), ["latitude", "longitude"])
            .select("model_mode", F.col("location_name").alias("test_location"), "test_loc_id",
                    "detection_auc", "classification_auc"))


def ablation_study(features: DataFrame, registry: DataFrame, columns: dict[str, list[str]],
                   modes: Sequence[str] = ("random_forest",),
                   parallelism: int = PARALLELISM, **options) -> DataFrame:
    """Detection AUC of the four feature sets on one settled feature table."""
    spark = registry.sparkSession
    sets = {title: feature_set(columns, kind) for title, kind in ABLATION_SETS.items()}

    def aucs(names: list[str]) -> dict[str, float | None]:
        return run_task(features, registry, DETECTION, names, modes, **options).aucs()

    found = run_each(spark, aucs, [(names,) for names in sets.values()], parallelism)
    rows = [(mode, title, len(names), value) for (title, names), values in zip(sets.items(), found)
            for mode, value in values.items()]
    return spark.createDataFrame(
        rows, "model_mode string, feature_set string, n_features int, auc double")


def evaluate_saved(features: DataFrame, manifest_path: str, target: str) -> TaskResult:
    """Score the manifest's held-out files with the models it lists for a task.

    Models of windows cut the rows by their own scaler, size and stride.
    """
    spark = features.sparkSession
    registry, header = load_manifest(spark, manifest_path)
    files = registry if target == DETECTION else R.drop_healthy_files(registry)
    rows = split_rows(features, files, "test")
    result = TaskResult(target)
    for mode, path in header["model_paths"].get(target, {}).items():
        model, names, class_names = load_model(path)
        labels = spark.createDataFrame(
            [(c, i) for i, c in enumerate(class_names)], "fault_type string, label int")
        task = Task(target, labels, class_names)
        labelled, cut = task.label_rows(rows), load_windows(path)
        windows = WindowSpec(*cut) if cut else None
        scored = settle(score_windows(model, labelled, windows, task, mode) if windows
                        else score(model, task_matrix(labelled, names), mode))
        result.models[mode] = ModelResult(mode, names, scored, task, model, windows)
        result.class_names, result.classes = class_names, task.classes()
    return result


def compare_models(results: Sequence[TaskResult]) -> DataFrame:
    """One row per task and model, best AUC first, undefined ones last."""
    spark = next(m.predictions.sparkSession for r in results for m in r.models.values())
    rows = [(r.target, mode, auc) for r in results for mode, auc in r.aucs().items()]
    table = spark.createDataFrame(rows, "task string, model string, auc double")
    return table.orderBy(F.desc_nulls_last("auc"), "task", "model")
