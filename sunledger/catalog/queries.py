"""One DataFrame per relational operator, over the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.catalog import inputs as I
from sunledger.functions import columns as C
from sunledger.functions.expressions import (
    file_stem, loc_id, parse_file_fault_type, parse_run_id)
from sunledger.operators import convolutions as V
from sunledger.operators import features as FE
from sunledger.operators import metrics as M
from sunledger.operators import registry as R
from sunledger.operators import sampling as S
from sunledger.operators import sequences as Q
from sunledger.operators import stats as X
from sunledger.session import scratch_path, settle
from sunledger.sources import config as B
from sunledger.sources import footers as FT
from sunledger.sources import manifest as MF
from sunledger.sources.telemetry import downcast, list_files, pick_schema_file, year_filter

BASE = ["source_file", "event_id"]
DIGITS = 9


def _round(df: DataFrame, *names: str, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- scans ---------------------------------------------------------------------------------

def scan_batch(spark: SparkSession, sf: str) -> DataFrame:
    wanted = [*BASE, "timestamp", "sim_year", "poa_global_wm2", "ac_power_kw", "fault_type"]
    return downcast(year_filter(I.rows(spark, sf).select(*wanted), [1, 3]))


def load_entry(spark, sf):
    return FE.add_features(year_filter(I.rows(spark, sf), [2, 3]), I.KWP).drop("unit_id")


def discover_sites(spark, sf):
    return R.discover_sites(I.rows(spark, sf))


def file_row_counts(spark, sf):
    return X.file_row_counts(I.rows(spark, sf))


def schema_file_pick(spark, sf):
    return pick_schema_file(I.rows(spark, sf).select("source_file").distinct())


def save_load_manifest(spark, sf):
    return MF.manifest_round_trip(I.registry(spark, sf), scratch_path(spark, "manifest"))


#: rows of run files that one task writes
WRITTEN_ROWS = 20_000


def _run_files(spark, sf):
    """The rows written as run files, one folder a run: the folder, its listed files, the schema.

    Opening a file costs more than its rows, so the number of writers follows the rows: small
    partitions are not put together.
    """
    path = scratch_path(spark, "runs")
    rows = I.rows(spark, sf, extended=True)
    writers = max(1, -(-rows.count() // WRITTEN_ROWS))
    rows.repartition(writers, "source_file").write.partitionBy("source_file").parquet(path)
    return path, list_files(spark, path), rows.drop("source_file").schema


def _run_rows(spark, path, schema):
    """The rows of written run files; their folders are listed once more."""
    return spark.read.schema(schema).parquet(path)


def footer_row_counts(spark, sf):
    """Rows per run file, from footers; Spark counts files that Python cannot open."""
    path, files, schema = _run_files(spark, sf)
    run = F.regexp_extract("path", "source_file=([^/]*)/", 1)
    return FT.row_counts(FT.read_footers(files), run, lambda: _run_rows(spark, path, schema))


def footer_constant_columns(spark, sf):
    """Constant columns of run files: footers first, a scan of what they leave open."""
    path, files, schema = _run_files(spark, sf)
    return FT.constant_columns(files, _run_rows(spark, path, schema), schema)


def footer_capacity(spark, sf):
    """Capacity by the largest DC power that the footers name."""
    path, files, schema = _run_files(spark, sf)
    most = FT.highest(FT.column_bounds(FT.read_footers(files), schema), "dc_power_kw")
    return X.estimate_capacity(_run_rows(spark, path, schema) if most is None else spark.range(1).select(
        F.lit(most).cast("float").alias("dc_power_kw")))


def read_batch_config(spark, sf):
    """Sites and capacity of a batch description that is written from the rows' places."""
    lat, lon = F.round("latitude", 2).alias("lat"), F.round("longitude", 2).alias("lon")
    places = I.rows(spark, sf).select(lat, lon).distinct()
    name = F.concat(F.lit("site "), F.col("lat").cast("string"), F.lit(", somewhere"))
    # a batch lists its sites in one document
    listed = F.sort_array(F.collect_list(F.struct("lat", "lon", name.alias("name"))))
    described = places.agg(
        F.struct(F.count(F.lit(1)).cast("double").alias("system_area_m2")).alias("installation_fixed"),
        F.struct(F.lit(0.25).alias("efficiency")).alias("stc_parameters"),
        F.struct(listed.alias("locations")).alias("sweep_summary"))
    path = scratch_path(spark, "config")
    described.coalesce(1).write.json(path)
    config = B.read_batch_config(spark, path)
    # one-row side
    return B.config_sites(config).crossJoin(F.broadcast(B.config_capacity(config)))


# --- projections and filters -----------------------------------------------------------------

def daytime_filter(spark, sf):
    return FE.daytime_filter(I.rows(spark, sf)).select(*BASE, "poa_global_wm2")


def year_filter_rows(spark, sf):
    years = F.when(F.col("split") == "train", F.array(F.lit(1), F.lit(2))).when(
        F.col("split") == "test", F.array(F.lit(3)))
    entries = I.registry(spark, sf).withColumn("years", years)
    return R.rows_in_years(I.rows(spark, sf), entries).select(*BASE, "sim_year", "split")


def faulted_only(spark, sf):
    return S.faulted_only(I.rows(spark, sf)).select(*BASE, "fault_type")


def drop_healthy_files(spark, sf):
    return R.drop_healthy_files(I.plain_registry(spark, sf))


def known_class_filter(spark, sf):
    faulted = S.faulted_only(I.rows(spark, sf))
    return S.known_rows(faulted, I.partial_labels(spark, sf)).select(*BASE, "fault_type")


def unseen(spark, sf):
    faulted = S.faulted_only(I.rows(spark, sf))
    return S.unseen_counts(faulted, I.partial_labels(spark, sf))


def _constants(spark, sf):
    table = I.rows(spark, sf, extended=True)
    return X.constant_columns(table, table.columns)


def constant_columns(spark, sf):
    return _constants(spark, sf)


def classify_columns(spark, sf):
    return C.classify_columns(I.rows(spark, sf, extended=True), _constants(spark, sf))


def load_columns(spark, sf):
    return C.load_columns(classify_columns(spark, sf))


def feature_set(spark, sf):
    return C.feature_set_table(I.rows(spark, sf, extended=True), _constants(spark, sf))


def estimate_capacity(spark, sf):
    return X.estimate_capacity(I.rows(spark, sf))


def batch_summary(spark, sf):
    lists = C.category_lists(classify_columns(spark, sf))
    capacity = estimate_capacity(spark, sf).first()["array_kwp"]
    return B.batch_summary(discover_sites(spark, sf), lists, F.lit(capacity))


def parse_file_fault_type_of_names(spark, sf):
    name = F.col("source_file")
    return I.rows(spark, sf).select("source_file").distinct().select(
        "source_file", parse_file_fault_type(name).alias("file_fault_type"))


def parse_run_id_of_names(spark, sf):
    name = F.col("source_file")
    return I.rows(spark, sf).select("source_file").distinct().select(
        "source_file", file_stem(name).alias("stem"), parse_run_id(name).alias("run_id"))


def loc_ids(spark, sf):
    return I.rows(spark, sf).select(
        "latitude", "longitude", loc_id(F.col("latitude"), F.col("longitude")).alias("loc_id")
    ).distinct()


def clean_matrix(spark, sf):
    # a feature that can be infinite or missing, and one that does not exist
    table = I.rows(spark, sf).withColumn(
        "spiky", F.when(F.col("event_id") % 7 == 0, F.lit(float("inf")))
        .when(F.col("event_id") % 7 == 1, F.lit(float("-inf")))
        .when(F.col("event_id") % 7 == 2, F.lit(float("nan")))
        .when(F.col("event_id") % 7 == 3, F.lit(None).cast("double"))
        .otherwise(F.col("ac_power_kw").cast("double")))
    return FE.clean_matrix(table, ["ac_power_kw", "spiky", "not_there", "dc_power_kw"], BASE)


def downcast_rows(spark, sf):
    return downcast(spark.read.parquet(f"{sf}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


# --- row features -----------------------------------------------------------------------------

def time_features(spark, sf):
    return FE.time_features(FE.daytime_filter(I.rows(spark, sf))).select(
        *BASE, "hour_sin", "hour_cos", "doy_sin", "doy_cos")


def performance_ratio(spark, sf):
    return FE.performance_ratio(FE.daytime_filter(I.rows(spark, sf)), I.KWP).select(
        *BASE, "performance_ratio")


def performance_ratio_no_capacity(spark, sf):
    return FE.performance_ratio(FE.daytime_filter(I.rows(spark, sf)), None).select(
        *BASE, "performance_ratio")


def dc_ac_power_ratio(spark, sf):
    return FE.dc_ac_power_ratio(FE.daytime_filter(I.rows(spark, sf))).select(
        *BASE, "dc_ac_power_ratio")


def pr_deviation(spark, sf):
    return I.features(spark, sf).select(*BASE, "performance_ratio", "pr_deviation")


def power_step(spark, sf):
    return I.features(spark, sf).select(*BASE, "performance_ratio", "power_step")


# --- joins --------------------------------------------------------------------------------------

def rows_with_split(spark, sf):
    return R.rows_with_split(I.rows(spark, sf), I.registry(spark, sf)).select(
        *BASE, "run_id", "file_fault_type", "split")


def encode_labels(spark, sf):
    table = I.rows(spark, sf)
    return S.encode_labels(S.faulted_only(table), S.label_table(table)).select(
        *BASE, "fault_type", "label")


def decode_labels(spark, sf):
    coded = I.classification_predictions(spark, sf).where(F.col("model") == "drift").select(
        "row_id", F.col("y_pred").alias("label"))
    return S.decode_labels(coded, S.label_table(I.rows(spark, sf))).select(
        "row_id", F.col("fault_type").alias("predicted"))


def site_name(spark, sf):
    points = I.rows(spark, sf).select("latitude", "longitude").distinct()
    return R.site_name(points, I.named_sites(spark, sf))


def feature_group(spark, sf):
    groups = C.feature_groups(classify_columns(spark, sf))
    scores = X.unpivot(I.rows(spark, sf, extended=True),
                       [*I.SCADA_COLUMNS, "voc_v", "stress_heat"]).groupBy("feature").agg(
        F.max("value").alias("score"))
    return M.feature_group(scores, groups)


def merge_reports(spark, sf):
    classes = I.fault_classes(spark, sf)
    report = M.classification_report(I.classification_predictions(spark, sf), classes)
    merged = M.merge_reports(report, classes, ["near", "drift"])
    return _round(merged, *[c for c in merged.columns if c != "fault_type"])


def fold_expand(spark, sf):
    sites = I.sites(spark, sf).select("loc_id").distinct()
    return R.fold_expand(I.plain_registry(spark, sf), sites)


# --- aggregates -----------------------------------------------------------------------------------

def fault_counts(spark, sf):
    return X.fault_counts(I.rows(spark, sf))


def fault_prevalence(spark, sf):
    return X.fault_prevalence(FE.daytime_filter(I.rows(spark, sf)))


def year_fault_rate(spark, sf):
    return X.year_fault_rate(FE.daytime_filter(I.rows(spark, sf)))


def yearly_features(spark, sf):
    """Fault rate and mean engineered features per simulation year."""
    names = ("performance_ratio", "pr_deviation", "dc_ac_power_ratio", "power_step")
    active = F.col("fault_active").cast("int")
    return I.features(spark, sf).groupBy("sim_year").agg(
        F.sum(active).alias("faulted"), F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg(active), DIGITS).alias("fault_rate"),
        *[F.round(F.avg(F.col(n).cast("double")), DIGITS).alias(f"avg_{n}") for n in names])


def feature_describe(spark, sf):
    return X.feature_describe(I.settled_features(spark, sf), FE.ENGINEERED)


def feature_histogram(spark, sf):
    table = I.settled_features(spark, sf)
    return _round(X.feature_histogram(table, FE.ENGINEERED), "bin_start", "density", digits=8)


def correlation_matrix(spark, sf):
    table = FE.daytime_filter(I.rows(spark, sf, extended=True))
    return _round(X.correlation_matrix(table, I.SCADA_COLUMNS), "correlation")


def discover_fault_types(spark, sf):
    return S.discover_fault_types(year_filter(I.rows(spark, sf), [1, 2]))


def class_counts(spark, sf):
    table = I.rows(spark, sf)
    detection = S.class_counts(table, "fault_active").withColumn("target", F.lit("fault_active"))
    kinds = S.class_counts(table, "fault_type", S.label_table(table)).withColumn(
        "target", F.lit("fault_type"))
    return detection.unionByName(kinds)


def _class_weights(spark, sf, weigh):
    table = I.rows(spark, sf)
    labels = S.label_table(table)
    wider = labels.union(labels.agg(F.lit("offline"), (F.max("label") + 1).cast("int")))
    return _round(weigh(S.class_counts(table, "fault_type", labels), wider), "weight")


def balanced_weights(spark, sf):
    return _class_weights(spark, sf, S.balanced_weights)


def sequence_weights(spark, sf):
    return _class_weights(spark, sf, S.sequence_weights)


SCALED = ("performance_ratio", "pr_deviation", "dc_ac_power_ratio", "power_step")


def fit_scaler(spark, sf):
    table = I.settled_features(spark, sf)
    scaler = Q.fit_scaler(table, table, SCALED)
    return _round(Q.scaler_table(scaler), "mean", "std")


def apply_scaler(spark, sf):
    table = I.settled_features(spark, sf)
    scaler = Q.fit_scaler(table, table, SCALED)
    scaled = Q.apply_scaler(table, scaler, BASE)
    return scaled.select(*BASE, *[F.round(F.col(n).cast("double"), 4).alias(n) for n in SCALED])


def distinct_years(spark, sf):
    return R.distinct_years(I.rows(spark, sf))


def confusion_matrix(spark, sf):
    return M.confusion_matrix(I.classification_predictions(spark, sf))


def classification_report(spark, sf):
    report = M.classification_report(I.classification_predictions(spark, sf),
                                     I.fault_classes(spark, sf))
    return _round(report, "precision", "recall", "f1")


def detection_report(spark, sf):
    report = M.classification_report(I.detection_predictions(spark, sf), I.detection_classes(spark))
    return _round(report, "precision", "recall", "f1")


def label_quality_report(spark, sf):
    """The report over the given ``labels`` table: toxicity as a call on quality."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    pairs = labels.select(F.lit("toxic").alias("model"), F.col("quality").alias("y_true"),
                          (F.lit(1) - F.col("toxic")).alias("y_pred"))
    return _round(M.classification_report(pairs, I.detection_classes(spark)),
                  "precision", "recall", "f1")


def accuracy(spark, sf):
    return _round(M.accuracy(I.detection_predictions(spark, sf)), "accuracy")


def roc_auc_binary(spark, sf):
    return _round(M.roc_auc_binary(I.detection_predictions(spark, sf)), "auc")


def roc_auc_ovr_weighted(spark, sf):
    return _round(M.roc_auc_ovr_weighted(I.classification_predictions(spark, sf)), "auc")


def per_fault_f1(spark, sf):
    table = merge_reports(spark, sf)
    return _round(table.select("fault_type", "near_f1", "drift_f1"), "near_f1", "drift_f1")


def attribution_summary(spark, sf):
    summary = M.attribution_summary(I.attribution(spark, sf, FE.ENGINEERED))
    return _round(summary, "mean_abs", "mean_signed", digits=8)


def split_counts(spark, sf):
    return R.split_counts(I.registry(spark, sf), by_type=True)


def short_run_loss(spark, sf):
    return _round(Q.short_run_loss(FE.daytime_filter(I.rows(spark, sf)), 65), "pct_rows_lost")


# --- windows -----------------------------------------------------------------------------------

def _labelled(spark, sf):
    table = FE.daytime_filter(I.rows(spark, sf))
    return table.withColumn("label", F.col("fault_active").cast("int"))


def sequence_windows(spark, sf):
    return Q.sequence_windows(_labelled(spark, sf), I.WINDOW, I.STRIDE)


def window_label(spark, sf):
    """Windows of faulted rows only, labelled with the fault type they end in."""
    table = S.faulted_only(FE.daytime_filter(I.rows(spark, sf)))
    return Q.sequence_windows(table, I.WINDOW, I.STRIDE, label="fault_type")


def window_arrays(spark, sf):
    blocks = Q.window_arrays(FE.daytime_filter(I.rows(spark, sf)),
                             ["ac_power_kw", "dc_power_kw"], I.WINDOW, I.STRIDE)
    return blocks.select("source_file", "window_id", F.posexplode("block").alias("step", "_x")
                         ).select("source_file", "window_id", "step",
                                  F.element_at("_x", 1).alias("ac_power_kw"),
                                  F.element_at("_x", 2).alias("dc_power_kw"))


def window_summary(spark, sf):
    names = ["ac_power_kw", "dc_power_kw"]
    table = Q.window_summary(_labelled(spark, sf), names, I.WINDOW, I.STRIDE)
    stats = [c for c in table.columns if c.endswith(("_mean", "_std", "_slope"))]
    return _round(table, *stats, digits=6)


def window_convolution(spark, sf):
    """Curvature of the power over five rows, every second one, pooled over each window."""
    curve = V.Kernel(np.array([[1.0], [-2.0], [1.0]]), dilation=2)
    table = V.window_kernels(_labelled(spark, sf), ["ac_power_kw"], I.WINDOW, I.STRIDE, [curve])
    return _round(table.withColumn("label", F.col("label").cast("int")),
                  "kernel_0_max", "kernel_0_above")


def last_step(spark, sf):
    return Q.last_step(_labelled(spark, sf), ["ac_power_kw"], I.WINDOW, I.STRIDE)


def val_fallback(spark, sf):
    windows = R.rows_with_split(sequence_windows(spark, sf), I.registry(spark, sf))
    # runs that are too short for any validation window
    return Q.val_fallback(windows.where(F.col("split") != "val")).select(
        "source_file", "window_id", "split")


def assign_splits(spark, sf):
    return I.registry(spark, sf)


def limit_runs(spark, sf):
    return R.limit_runs(I.plain_registry(spark, sf), I.MAX_RUNS)


def thin_majority(spark, sf):
    return S.thin_majority(I.rows(spark, sf), I.THIN).select(*BASE, "fault_active")


def stratified_subsample(spark, sf):
    return S.stratified_subsample(I.rows(spark, sf), I.CAP, "fault_type").select(
        *BASE, "fault_type")


def stratified_orders(spark, sf):
    """The same quota sampling over the given ``orders`` table."""
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("event_id"), "o_orderpriority", "o_orderstatus")
    return S.stratified_subsample(orders, I.CAP, "o_orderpriority")


def load_split(spark, sf):
    train = I.registry(spark, sf).where(F.col("split") == "train")
    table = S.load_split(I.features(spark, sf), train, 1000, I.THIN)
    return table.select(*BASE, "fault_type", "performance_ratio", "pr_deviation", "power_step")


def class_balanced_batches(spark, sf):
    return R.class_balanced_batches(I.plain_registry(spark, sf), I.FILES_PER_BATCH)


def head_tail_sample(spark, sf):
    table = I.schema_rows(spark, sf).select(*BASE, "timestamp")
    return X.head_tail_sample(table, ["timestamp", "event_id"], 20)


def nth_row_day(spark, sf):
    return X.nth_row_day(FE.daytime_filter(I.rows(spark, sf))).select(*BASE, "sim_day")


def fault_spans(spark, sf):
    return X.fault_spans(FE.daytime_filter(I.rows(spark, sf)))


# --- sorts and sets --------------------------------------------------------------------------------

def sample_series(spark, sf):
    return X.sample_series(I.features(spark, sf))


def sort_run(spark, sf):
    return Q.sort_run(S.faulted_only(I.rows(spark, sf))).select(*BASE, "timestamp", "rn")


def rank_models(spark, sf):
    results = M.roc_auc_binary(I.detection_predictions(spark, sf)).union(
        M.roc_auc_ovr_weighted(I.classification_predictions(spark, sf)))
    return _round(M.rank_models(results), "auc")


def top_features(spark, sf):
    summary = M.attribution_summary(I.attribution(spark, sf, FE.ENGINEERED))
    return _round(M.top_features(summary.select("feature", "mean_abs"), "mean_abs", 3),
                  "mean_abs", digits=8)


def first_row_per_file(spark, sf):
    return R.first_row_per_file(I.rows(spark, sf), "latitude", "longitude", "timestamp")


def union_files(spark, sf):
    table = I.rows(spark, sf)
    columns = [*BASE, "fault_type"]
    odd = table.where(F.col("unit_id") % 2 == 1).select(*columns, "ac_power_kw")
    even = table.where(F.col("unit_id") % 2 == 0).select(*columns)
    return even.unionByName(odd, allowMissingColumns=True)


def column_sets(spark, sf):
    lists = C.category_lists(classify_columns(spark, sf))
    wide, narrow = C.feature_set(lists, "full"), C.feature_set(lists, "scada")
    sets = C.column_sets(wide, narrow, spark)
    return sets.select(*[F.concat_ws(",", F.sort_array(c)).alias(c) for c in sets.columns])


def train_years(spark, sf):
    return R.train_years(I.rows(spark, sf))


def missing_classes(spark, sf):
    table = I.rows(spark, sf)
    partial = S.known_rows(table, I.partial_labels(spark, sf))
    return S.missing_classes(S.label_table(table), partial)


# --- task set-up -----------------------------------------------------------------------------------

def resolve_entries(spark, sf):
    return R.resolve_entries(I.registry(spark, sf), "fault_type")


def label_table(spark, sf):
    train = I.registry(spark, sf).where(F.col("split").isin("train", "val"))
    return S.label_table(R.rows_with_split(I.rows(spark, sf), train))


def refold(spark, sf):
    pool = I.registry(spark, sf).where(F.col("split").isin("train", "val"))
    return R.refold(settle(pool))


def temporal_folds(spark, sf):
    folds = R.temporal_folds(I.rows(spark, sf), settle(I.registry(spark, sf)))
    return folds.withColumn("years", F.concat_ws(",", F.transform(
        "years", lambda y: y.cast("string"))))


def location_folds(spark, sf):
    return R.location_folds(settle(I.registry(spark, sf)), I.sites(spark, sf))


def split_leak_check(spark, sf):
    splits = I.registry(spark, sf)
    leaks = R.split_leaks(splits).agg(F.count(F.lit(1)).alias("n_leaks"))
    return splits.agg(F.count(F.lit(1)).alias("n_files")).crossJoin(F.broadcast(leaks))


QUERIES = {f.__name__: f for f in (
    scan_batch, load_entry, discover_sites, file_row_counts, footer_row_counts,
    footer_constant_columns, footer_capacity, read_batch_config, save_load_manifest, schema_file_pick,
    daytime_filter, faulted_only, drop_healthy_files, known_class_filter, unseen,
    constant_columns, classify_columns, load_columns, feature_set, estimate_capacity,
    batch_summary, clean_matrix, time_features, performance_ratio,
    performance_ratio_no_capacity, dc_ac_power_ratio, pr_deviation, power_step,
    rows_with_split, encode_labels, decode_labels, site_name, feature_group, merge_reports,
    fold_expand, fault_counts, fault_prevalence, year_fault_rate, yearly_features,
    feature_describe, feature_histogram, correlation_matrix, discover_fault_types,
    class_counts, balanced_weights, sequence_weights, fit_scaler, apply_scaler,
    distinct_years, confusion_matrix, classification_report, detection_report,
    label_quality_report, accuracy, roc_auc_binary, roc_auc_ovr_weighted, per_fault_f1,
    attribution_summary, split_counts, short_run_loss, sequence_windows, window_label,
    window_arrays, window_summary, window_convolution, last_step, val_fallback, assign_splits,
    limit_runs, thin_majority, stratified_subsample, stratified_orders, load_split,
    class_balanced_batches, head_tail_sample, nth_row_day, fault_spans, sample_series,
    sort_run, rank_models, top_features, first_row_per_file, union_files, column_sets,
    train_years, missing_classes, resolve_entries, label_table, refold, temporal_folds,
    location_folds, split_leak_check)}
QUERIES["year_filter"] = year_filter_rows
QUERIES["loc_id"] = loc_ids
QUERIES["parse_file_fault_type"] = parse_file_fault_type_of_names
QUERIES["parse_run_id"] = parse_run_id_of_names
QUERIES["downcast"] = downcast_rows
