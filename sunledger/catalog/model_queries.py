"""Queries whose rows come from fitted models: checked by quality, not by SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.catalog import inputs as I
from sunledger.catalog import queries as Q
from sunledger.functions import columns as C
from sunledger.operators import metrics as M
from sunledger.operators import stats as X
from sunledger.operators.features import add_features, clean_matrix
from sunledger.operators.registry import assign_splits, file_registry
from sunledger.plans import attributions as A
from sunledger.plans import models as P
from sunledger.plans import studies as ST
from sunledger.session import scratch_path, settle
from sunledger.sources import manifest as MF

#: smaller forests of the queries other than random_forest, which has the library's settings
FOREST = {"random_forest": {"numTrees": 10, "maxDepth": 6, "minInstancesPerNode": 5}}
SMALL = FOREST["random_forest"]
TASK = {"tabular_params": FOREST, "majority_thin_factor": I.THIN}


def _lists(rows: DataFrame) -> dict[str, list[str]]:
    return C.category_lists(C.classify_columns(rows, X.constant_columns(rows, rows.columns)))


def _files(rows: DataFrame) -> DataFrame:
    return settle(assign_splits(file_registry(rows)))


def _inputs(spark: SparkSession, sf: str):
    """Settled features and registry, and the columns by category.

    Rows are not settled before: writing all of them costs more than the scans it saves.
    """
    rows = I.rows(spark, sf, extended=True)
    return settle(add_features(rows, I.KWP)), _files(rows), _lists(rows)


def _run(spark, sf, target=P.DETECTION, modes=("random_forest",), inputs=None,
         **options) -> P.TaskResult:
    table, files, lists = inputs or _inputs(spark, sf)
    return P.run_task(table, files, target, C.feature_set(lists, "full"), modes,
                      **{**TASK, **options})


def _aucs(result: P.TaskResult) -> DataFrame:
    spark = result.classes.sparkSession
    rows = [(result.target, mode, auc) for mode, auc in result.aucs().items()]
    return spark.createDataFrame(rows, "task string, model string, auc double")


def random_forest(spark, sf):
    return _aucs(_run(spark, sf, tabular_params={}))


def score_model(spark, sf):
    return _run(spark, sf).models["random_forest"].predictions


def deployment_model(spark, sf):
    inputs = _inputs(spark, sf)
    return _aucs(_run(spark, sf, inputs=inputs, scada=C.feature_set(inputs[2], "scada")))


def batched_forest(spark, sf):
    """A forest grown over batches of all faulted training rows.

    Nothing is thinned: healthy rows are no part of this task, so it would balance nothing.
    """
    return _aucs(_run(spark, sf, P.CLASSIFICATION, rows_per_batch=20_000, files_per_batch=60,
                      majority_thin_factor=1))


def mlp_last_step(spark, sf):
    return _aucs(_run(spark, sf, modes=("mlp",), window_size=I.WINDOW, stride=I.STRIDE))


def mlp_history(spark, sf):
    """Losses and rate of every round of the perceptron; ``best`` marks improvements on val."""
    result = _run(spark, sf, P.CLASSIFICATION, modes=("mlp",), window_size=I.WINDOW,
                  stride=I.STRIDE)
    return result.models["mlp"].history


def window_summary_classifier(spark, sf):
    return _aucs(_run(spark, sf, modes=("window_summary",), window_size=I.WINDOW,
                      stride=I.STRIDE, sequence_params={"window_summary": SMALL}))


def window_kernel_classifier(spark, sf):
    """Windows told apart by seeded convolutions, at the library's settings."""
    return _aucs(_run(spark, sf, modes=("window_kernels",), window_size=I.WINDOW,
                      stride=I.STRIDE))


def run_task(spark, sf):
    result = _run(spark, sf, P.CLASSIFICATION, ("random_forest", "window_summary"),
                  window_size=I.WINDOW, stride=I.STRIDE,
                  sequence_params={"window_summary": SMALL})
    return result.per_fault_f1()


def custom_runners(spark, sf):
    """A caller's own detector: the DC/AC ratio itself as the score."""
    def ratio_rule(train, val, test, params):
        p = F.least(F.lit(1.0), F.col("dc_ac_power_ratio").cast("double") / F.lit(5.0))
        return test.select(F.col("label").cast("int").alias("y_true"),
                           (p > 0.2).cast("int").alias("y_pred"),
                           F.array(F.lit(1.0) - p, p).alias("prob"))
    found = _aucs(_run(spark, sf, modes=("ratio_rule", "not_supported"),
                       custom_runners={"ratio_rule": ratio_rule}))
    return found.withColumn("auc", F.round("auc", 9))


def importance_top(spark, sf):
    inputs = _inputs(spark, sf)
    result = _run(spark, sf, inputs=inputs).models["random_forest"]
    groups = [(name, kind) for kind in C.FEATURE_CATEGORIES for name in inputs[2].get(kind, ())]
    return M.importance_top(P.importances(result), spark.createDataFrame(
        groups, "feature string, feature_group string"))


#: a tree of two levels: split, children by position
RULES = [("dc_ac_power_ratio", 1.1, 1, 2), ("performance_ratio", 0.5, 3, 4),
         ("power_step", 0.25, 5, 6), None, None, None, None]


def path_attribution(spark, sf):
    """Every row's attributions by a tree of two levels whose shares the rows themselves give."""
    names = ["dc_ac_power_ratio", "performance_ratio", "power_step"]
    table = I.settled_features(spark, sf)
    clean = clean_matrix(table, names, ["source_file", "event_id", "fault_active"])
    tree = A.rule_tree(clean.withColumn("label", F.col("fault_active").cast("int")), RULES, names, 2)
    found = A.attributions(clean, names, tree, ["source_file", "event_id"], 1)
    return found.select("source_file", "event_id", *[
        F.round(c, 9).alias(c) for c in ("base", "probability")], *[
        F.round(F.element_at("values", i + 1), 9).alias(n) for i, n in enumerate(names)])


def _explained(spark, sf) -> P.TaskResult:
    return _run(spark, sf, modes=("random_forest", "mlp"), window_size=I.WINDOW, stride=I.STRIDE,
                explain=True)


def model_attributions(spark, sf):
    """Rows that each model's attributions cover, and whether all of them add up."""
    parts = []
    for mode, fitted in _explained(spark, sf).models.items():
        total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
        gap = F.abs(total - (F.col("probability") - F.col("base")))
        parts.append(fitted.attribution.agg(
            F.lit(mode).alias("model"), F.count(F.lit(1)).alias("n_rows"),
            F.min(F.size("values")).alias("n_inputs"),
            (F.max(F.coalesce(gap, F.lit(1.0))) < 1e-6).alias("adds_up")))
    return reduce(DataFrame.unionByName, parts)


def attributed_features(spark, sf):
    """Mean attribution of every input of a fitted forest and a fitted perceptron."""
    return reduce(DataFrame.unionByName, [
        P.attributed_features(fitted).withColumn("model", F.lit(mode))
        for mode, fitted in _explained(spark, sf).models.items()])


def _stored(spark, sf) -> tuple[P.TaskResult, str]:
    """A fitted task, and the path of its model on storage."""
    result = _run(spark, sf)
    fitted = result.models["random_forest"]
    return result, MF.save_model(fitted.model, scratch_path(spark, "model"),
                                 fitted.feature_names, result.class_names)


def save_load_model(spark, sf):
    """Feature importances of a model after a trip through storage."""
    _, path = _stored(spark, sf)
    model, names, _ = MF.load_model(path)
    vector = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, vector)],
                                 "feature string, importance double")


def evaluate_saved(spark, sf):
    """AUC of stored models, one of them of windows, on the test files their manifest lists."""
    inputs = table, files, _ = _inputs(spark, sf)
    result = _run(spark, sf, modes=("random_forest", "mlp"), inputs=inputs, window_size=I.WINDOW,
                  stride=I.STRIDE)
    paths = {mode: MF.save_model(fitted.model, scratch_path(spark, "model"), fitted.feature_names,
                                 result.class_names, fitted.windows)
             for mode, fitted in result.models.items()}
    listing = MF.save_manifest(files, scratch_path(spark, "manifest"),
                               {P.DETECTION: paths}, {"seed": 42})
    return _aucs(ST.evaluate_saved(table, listing, P.DETECTION))


def compare_models(spark, sf):
    inputs = _inputs(spark, sf)
    return ST.compare_models([_run(spark, sf, target, inputs=inputs)
                              for target in (P.DETECTION, P.CLASSIFICATION)])


def write_metrics_csv(spark, sf):
    """Per-class rates written as CSV and read back."""
    table = Q.merge_reports(spark, sf)
    path = MF.write_metrics_csv(table, scratch_path(spark, "metrics"))
    return MF.read_metrics_csv(spark, path, ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields))


def temporal_split_study(spark, sf):
    rows = I.rows(spark, sf, extended=True)
    return ST.temporal_split_study(rows, I.KWP, _files(rows), C.feature_set(_lists(rows), "full"),
                                   **TASK)


def cross_location_study(spark, sf):
    table, files, lists = _inputs(spark, sf)
    return ST.cross_location_study(table, files, settle(I.sites(spark, sf)),
                                   I.named_sites(spark, sf), C.feature_set(lists, "full"), **TASK)


def ablation_study(spark, sf):
    table, files, lists = _inputs(spark, sf)
    return ST.ablation_study(table, files, lists, **TASK)


MODEL_QUERIES = {f.__name__: f for f in (
    random_forest, score_model, deployment_model, batched_forest, mlp_last_step, mlp_history,
    window_summary_classifier, window_kernel_classifier, run_task, custom_runners, importance_top, path_attribution,
    model_attributions, attributed_features, save_load_model, evaluate_saved, compare_models, write_metrics_csv, temporal_split_study, cross_location_study, ablation_study)}
