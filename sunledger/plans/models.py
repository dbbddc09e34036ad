"""Fitting, scoring and the task runner, on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sunledger.functions.expressions import seeded_digest
from sunledger.operators import convolutions as V
from sunledger.operators import metrics as M
from sunledger.operators import registry as R
from sunledger.operators import sampling as S
from sunledger.operators import sequences as Q
from sunledger.operators.features import clean_matrix, feature_columns
from sunledger.operators.skew import broadcast_checked, hash_ordinal
from sunledger.plans import attributions as A
from sunledger.plans import networks as N
from sunledger.session import settle
from sunledger.sources.telemetry import row_key

DETECTION, CLASSIFICATION = "fault_active", "fault_type"
DETECTION_CLASSES = ("Healthy", "Faulted")
HIDDEN = (64, 64, 64)
SEED = 42
COPY_BLOCK = 1000


# --- estimators ----------------------------------------------------------------------------

def random_forest(**params) -> RandomForestClassifier:
    """200 trees of depth 15 with leaves of at least 20 rows, weighted by class."""
    settings = dict(numTrees=200, maxDepth=15, minInstancesPerNode=20,
                    featureSubsetStrategy="sqrt", seed=SEED, weightCol="weight")
    return RandomForestClassifier(labelCol="label", featuresCol="features",
                                  **{**settings, **params})


def linear(**params) -> LogisticRegression:
    """Multinomial logistic regression over standardised inputs, weighted by class."""
    settings = dict(regParam=1e-3, maxIter=100, weightCol="weight")
    return LogisticRegression(labelCol="label", featuresCol="features", **{**settings, **params})


TABULAR: dict[str, Callable[..., Estimator]] = {"random_forest": random_forest, "linear": linear}
#: sequence modes: what describes a window, and the estimator over it unless another is named
SEQUENCE = {"mlp": (Q.last_step, "network"), "window_summary": (Q.window_summary, "random_forest"),
            "window_kernels": (V.window_kernels, "linear")}


def build_model(mode: str, **params) -> Estimator:
    """The estimator of a tabular mode."""
    if mode not in TABULAR:
        raise ValueError(f"Unknown model mode {mode!r}; known: {sorted(TABULAR)}")
    return TABULAR[mode](**params)


# --- data preparation ------------------------------------------------------------------------

@dataclass
class Task:
    """What is predicted: the label column, its classes and their names."""

    target: str
    labels: DataFrame
    class_names: list[str]

    @property
    def n_classes(self) -> int:
        return len(self.class_names)

    def classes(self) -> DataFrame:
        rows = list(enumerate(self.class_names))
        return self.labels.sparkSession.createDataFrame(rows, "label int, class_name string")

    def label_rows(self, rows: DataFrame) -> DataFrame:
        """Rows the task looks at, with a numeric label that carries the class names."""
        if self.target == DETECTION:
            coded = rows.withColumn("label", F.col("fault_active").cast("int"))
        else:
            coded = S.encode_labels(S.faulted_only(rows), self.labels)
        meta = {"ml_attr": {"type": "nominal", "name": "label", "vals": self.class_names}}
        return coded.withColumn("label", F.col("label").cast("double").alias("label", metadata=meta))


def open_task(seen: DataFrame, target: str) -> Task | None:
    """The shared label encoder, from the faulted rows of train and val files."""
    spark = seen.sparkSession
    if target == DETECTION:
        return Task(target, S.detection_labels(spark), list(DETECTION_CLASSES))
    names = sorted(r["fault_type"] for r in S.discover_fault_types(seen).collect())  # vocabulary
    labels = spark.createDataFrame(list(zip(names, range(len(names)))),
                                   "fault_type string, label int")
    return Task(target, labels, names) if names else None


def weigh(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Attach each class's weight to its rows."""
    table = weights.select(F.col("label").cast("double").alias("_label"), "weight")
    return (rows.join(broadcast_checked(table), F.col("label") == F.col("_label"))
            .drop("_label"))


def balance(rows: DataFrame, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Repeat rows so that every class reaches the size of the largest.

    Whole copies plus a fraction decided by the row's hash; no class is cut.
    """
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    ratio = sizes.crossJoin(F.broadcast(sizes.agg(F.max("_n").alias("_top")))).select(
        F.col("label").alias("_label"), (F.col("_top") / F.col("_n")).alias("_copies"))
    part = hash_ordinal("_digest") < F.col("_copies") - F.floor("_copies")
    n = F.floor("_copies") + part.cast("long")
    # in two steps, so that a very rare class needs no array of its many copies
    blocks = F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPY_BLOCK}"))
    left = F.least(F.col("_n") - F.col("_block") * COPY_BLOCK, F.lit(COPY_BLOCK)).cast("int")
    return (rows.withColumn("_digest", seeded_digest(seed, *key))
            .join(broadcast_checked(ratio), F.col("label") == F.col("_label"))
            .withColumn("_n", n).withColumn("_block", F.explode(blocks))
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), left)))
            .drop("_copy", "_block", "_n", "_digest", "_label", "_copies"))


def assembler(names: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="error")


def score(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """``(model, y_true, y_pred, prob)`` of every row."""
    return model.transform(rows).select(
        F.lit(name).alias("model"), F.col("label").cast("int").alias("y_true"),
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability").alias("prob"))


# --- results -----------------------------------------------------------------------------------

@dataclass
class WindowSpec:
    """How a sequence model cuts rows: its kind, window size and stride, and fitted scaler.

    ``scaler`` is one row of ``mean_<f>`` and ``std_<f>`` of the features it was fitted on.
    """

    mode: str
    size: int
    stride: int
    scaler: DataFrame

    @property
    def names(self) -> list[str]:
        return [c[5:] for c in self.scaler.columns if c.startswith("mean_")]

    def cut(self, rows: DataFrame) -> DataFrame:
        """The windows of labelled rows, by the stored scaler."""
        scaled = _scaled(rows, self.scaler, "label", "timestamp", "event_id", "row_index")
        describe, _ = SEQUENCE[self.mode]
        return describe(scaled, self.names, self.size, self.stride)


@dataclass
class ModelResult:
    """Settled predictions of one model; report and AUC are computed when asked for."""

    mode: str
    feature_names: list[str]
    predictions: DataFrame
    task: Task
    model: PipelineModel | None = None
    windows: WindowSpec | None = None
    history: DataFrame | None = None
    attribution: DataFrame | None = None

    @cached_property
    def report(self) -> DataFrame:
        return M.classification_report(self.predictions, self.task.classes())

    @cached_property
    def auc(self) -> float | None:
        """None when the test data does not hold every class."""
        binary = self.task.n_classes == 2
        table = (M.roc_auc_binary if binary else M.roc_auc_ovr_weighted)(self.predictions)
        row = table.first()
        return row["auc"] if row else None


def _result(mode: str, names: list[str], predictions: DataFrame, task: Task,
            model: PipelineModel | None) -> ModelResult:
    return ModelResult(mode, names, settle(predictions), task, model)


# --- tabular -----------------------------------------------------------------------------------

def task_matrix(rows: DataFrame, names: Sequence[str], *keep: str) -> DataFrame:
    return clean_matrix(rows, names, ["label", *[k for k in keep if k in rows.columns]])


def fit_tabular(mode: str, train: DataFrame, names: Sequence[str], task: Task,
                **params) -> PipelineModel:
    """Fit one estimator on labelled rows, weighted by class."""
    counts = train.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    weighted = weigh(task_matrix(train, names), S.balanced_weights(
        counts, task.classes().select("label")))
    model = build_model(mode, **params).fit(assembler(names).transform(weighted))
    return PipelineModel(stages=[assembler(names), model])


def run_tabular(mode: str, train: DataFrame, test: DataFrame, names: Sequence[str], task: Task,
                label: str | None = None, **params) -> ModelResult:
    present, _ = feature_columns(train, names)
    model = fit_tabular(mode, train, present, task, **params)
    return _result(mode, present, score(model, task_matrix(test, present), label or mode), task, model)


def deployment_model(mode: str, train: DataFrame, test: DataFrame, names: Sequence[str],
                     scada: Sequence[str], task: Task, **params) -> ModelResult:
    """The same estimator on the features a monitoring system can measure."""
    allowed = set(scada)
    return run_tabular(mode, train, test, [n for n in names if n in allowed], task,
                       label=f"{mode}_deployment", **params)


def join_forests(forests: Sequence[RandomForestClassificationModel]
                 ) -> RandomForestClassificationModel:
    """One forest of all trees: its probabilities are the forests' means weighted by trees."""
    sc = SparkSession.active().sparkContext
    kinds = sc._jvm.org.apache.spark.ml.classification
    trees = [tree for f in forests for tree in f._java_obj.trees()]
    listed = sc._gateway.new_array(kinds.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        listed[i] = tree
    first = forests[0]._java_obj
    joined = first.copyValues(kinds.RandomForestClassificationModel(
        first.uid(), listed, first.numFeatures(), first.numClasses()), first.extractParamMap())
    joined.set(joined.numTrees().w(len(trees)))
    model = RandomForestClassificationModel(joined)
    model._transfer_params_from_java()
    return model


def _pieces(train: DataFrame, listed: DataFrame, rows_per_batch: int | None) -> DataFrame:
    """``(batch, _pieces, _first)``: into how many pieces of at most about ``rows_per_batch``
    rows a batch is cut, and how many pieces stand before it."""
    sizes = train.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n"))
    held = listed.join(sizes, "source_file", "left").groupBy("batch").agg(
        F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("_n"))
    wanted = F.ceil(F.col("_n") / rows_per_batch) if rows_per_batch else F.lit(1)
    cut = held.withColumn("_pieces", F.greatest(F.lit(1), wanted).cast("long"))
    # one row per batch
    before = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select("batch", "_pieces", F.coalesce(
        F.sum("_pieces").over(before), F.lit(0).cast("long")).alias("_first"))


def batched_forest(train: DataFrame, test: DataFrame, entries: DataFrame, names: Sequence[str],
                   task: Task, files_per_batch: int = 10, rows_per_batch: int | None = None,
                   num_trees: int = 200, label: str = "batched_forest",
                   **params) -> ModelResult | None:
    """A forest grown over class-balanced file batches, from every row of the training files.

    The trees are shared out evenly, one more to the first batches if they don't divide; class
    weights are fixed once over all training rows; the batches' trees make one forest.  A batch
    of more than ``rows_per_batch`` rows is dealt out to several by the rows' hash.
    """
    present, _ = feature_columns(train, names)
    batches = settle(R.class_balanced_batches(entries, files_per_batch))
    n_batches = (batches.agg(F.max("batch")).first()[0] or 0) + 1 if batches.count() else 0
    if not n_batches or num_trees < 1:
        return None
    # a cycled file may fill several slots of a batch: once per slot, as listed
    listed = batches.select("source_file", "batch")
    # short types take slots again, so a long type may have files without one: they come on top
    unlisted = entries.join(listed, "source_file", "left_anti").select("source_file").distinct()
    listed = settle(listed.unionByName(unlisted.withColumn(
        "batch", F.pmod(F.xxhash64("source_file"), F.lit(n_batches)))))
    pieces = settle(_pieces(train, listed, rows_per_batch))
    n_pieces = pieces.agg(F.sum("_pieces")).first()[0]
    # with more pieces than trees the pieces are dealt out to the trees, so every row counts
    n_parts = min(n_pieces, num_trees)
    least, spare = divmod(num_trees, n_parts)
    counts = train.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    weights = settle(S.balanced_weights(counts, task.classes().select("label")))

    placed = train.join(broadcast_checked(listed.join(pieces, "batch")), "source_file")
    share = hash_ordinal("_digest") * F.col("_pieces")
    parts = settle(placed.withColumn("_digest", seeded_digest(SEED, *row_key(train)))
                   .withColumn("batch", (F.col("_first") + F.floor(share)) % n_parts)
                   .drop("_digest", "_first", "_pieces"), by="batch")
    models = []
    for number in range(n_parts):
        trees = least + (number < spare)
        part = weigh(task_matrix(parts.where(F.col("batch") == number), present), weights)
        if not part.isEmpty():
            fitted = random_forest(numTrees=trees, **params).fit(
                assembler(present).transform(part))
            models.append(fitted)
    if not models:
        return None
    model = PipelineModel(stages=[assembler(present), join_forests(models)])
    return _result(label, present, score(model, task_matrix(test, present), label), task, model)


# --- sequences -----------------------------------------------------------------------------------

def _scaled(rows: DataFrame, scaler: DataFrame, *keep: str) -> DataFrame:
    carried = ["source_file", *[k for k in keep if k in rows.columns]]
    return Q.apply_scaler(rows, scaler, carried)


def run_sequence(mode: str, rows: dict[str, DataFrame], names: Sequence[str], task: Task,
                 window_size: int, stride: int, estimator: str | None = None,
                 **params) -> ModelResult | None:
    """Classify windows by their last step (``mlp``), by statistics of their rows
    (``window_summary``) or by convolutions that see their order (``window_kernels``).

    ``rows`` has the labelled rows of train, val and test.  The scaler is fitted on train
    files; there is no result when train or test has no window.  ``estimator`` is ``network``
    (the default of ``mlp``), which is watched on the windows of val, or of train where val has
    none, or a tabular mode (by default the forest over statistics, a linear one over convolutions).
    """
    present, _ = feature_columns(rows["train"], names)
    spec = WindowSpec(mode, window_size, stride,
                      settle(Q.fit_scaler(rows["train"], rows["train"], present)))
    windows = {s: settle(spec.cut(rows[s])) for s in ("train", "test")}
    if any(w.isEmpty() for w in windows.values()):
        return None
    inputs = [c for c in windows["train"].columns
              if c not in ("source_file", "window_id", "label", "n_rows")]
    history = None
    estimator = estimator or SEQUENCE[mode][1]
    if estimator == "network":
        windows["val"] = settle(spec.cut(rows["val"]))
        fitted, history = fit_network(windows["train"], windows["val"], inputs, task, **params)
        model = PipelineModel(stages=[assembler(inputs), fitted])
    else:
        model = fit_tabular(estimator, _with_classes(windows["train"], task),
                            inputs, task, **params)
    predictions = _score_cut(model, windows["test"], task, mode)
    result = _result(mode, inputs, predictions, task, model)
    result.windows, result.history = spec, history
    return result


def fit_network(train: DataFrame, val: DataFrame, inputs: Sequence[str], task: Task,
                hidden: Sequence[int] = HIDDEN, path: str | None = None, **schedule):
    """A perceptron on the train windows, weighted by class, with its rounds on val windows.

    Windows of val are weighted like those of train.
    """
    counts = train.groupBy(F.col("label").cast("int").alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    weights = settle(S.balanced_weights(counts, task.classes().select("label")))
    alone = val.isEmpty()
    sides = train.withColumns({"for_train": F.lit(True), "for_val": F.lit(alone)})
    if not alone:
        sides = sides.unionByName(
            val.withColumns({"for_train": F.lit(False), "for_val": F.lit(True)}))
    # a val label that train does not have has no output to be held against
    clean = task_matrix(weigh(sides, weights), inputs, "weight", "for_train", "for_val")
    layers = [len(inputs), *hidden, task.n_classes]
    rows = settle(clean.where(F.col("label").between(0, task.n_classes - 1)).select(
        F.array(*[F.col(c).cast("double") for c in inputs]).alias("features"),
        F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight"),
        "for_train", "for_val"))
    found, history = N.fit(rows, layers, N.Schedule(**schedule), path)
    return N.as_model(found, layers, train.sparkSession), history


def score_windows(model: PipelineModel, rows: DataFrame, windows: WindowSpec, task: Task,
                  name: str) -> DataFrame:
    """``score`` of the windows that a stored model cuts from labelled rows."""
    return _score_cut(model, settle(windows.cut(rows)), task, name)


def _score_cut(model: PipelineModel, cut: DataFrame, task: Task, name: str) -> DataFrame:
    inputs = model.stages[0].getInputCols()
    return score(model, task_matrix(_with_classes(cut, task), inputs), name)


def _with_classes(windows: DataFrame, task: Task) -> DataFrame:
    """Put the class names back on a label that went through an aggregate."""
    meta = {"ml_attr": {"type": "nominal", "name": "label", "vals": task.class_names}}
    return windows.withColumn("label", F.col("label").cast("double").alias("label", metadata=meta))


# --- importance ----------------------------------------------------------------------------------

def importances(result: ModelResult) -> DataFrame:
    """``(feature, importance)`` of a fitted tree model; one row per feature."""
    vector = result.model.stages[-1].featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(result.feature_names, vector)]
    return result.predictions.sparkSession.createDataFrame(
        rows, "feature string, importance double")


def attribution(result: ModelResult, rows: DataFrame, of: str | int | None = "label") -> DataFrame:
    """What moved the model's probability in every row that its task looks at, or window of them.

    ``rows`` are feature rows, not scaled.  ``of`` is the class explained: ``label`` (the true
    one), a class number, or None for the predicted one.  Keys are kept next to ``target``,
    ``base``, ``probability`` and ``values``, one per input of the model.
    """
    table, names = result.task.label_rows(rows), result.model.stages[0].getInputCols()
    if result.windows:
        table = _with_classes(settle(result.windows.cut(table)), result.task)
    keys = [c for c in ("source_file", "event_id", "window_id") if c in table.columns]
    clean = task_matrix(table, names, *keys)
    return A.attributions(clean, names, A.explained(result.model), keys, of)


def attributed_features(result: ModelResult, table: DataFrame | None = None) -> DataFrame:
    """Mean absolute and mean attribution of every input, strongest first."""
    table = result.attribution if table is None else table
    return M.attribution_summary(A.by_feature(table, result.model.stages[0].getInputCols()))


# --- the task runner -------------------------------------------------------------------------------

@dataclass
class TaskResult:
    target: str
    class_names: list[str] = field(default_factory=list)
    models: dict[str, ModelResult] = field(default_factory=dict)
    classes: DataFrame | None = None

    def aucs(self) -> dict[str, float | None]:
        return {mode: result.auc for mode, result in self.models.items()}

    def reports(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [r.report for r in self.models.values()])

    def per_fault_f1(self) -> DataFrame:
        """One row per class with every model's rates side by side."""
        return M.merge_reports(self.reports(), self.classes,
                               [r.report.first()["model"] for r in self.models.values()])


def run_task(features: DataFrame, registry: DataFrame, target: str, names: Sequence[str],
             modes: Sequence[str] = ("random_forest",), *, window_size: int | None = None,
             stride: int | None = None, max_train_rows: int | None = None,
             majority_thin_factor: int = 1, rows_per_batch: int | None = None, files_per_batch: int = 10,
             scada: Sequence[str] | None = None, tabular_params: dict[str, dict] | None = None,
             sequence_params: dict[str, dict] | None = None,
             custom_runners: dict[str, Callable] | None = None,
             explain: bool = False) -> TaskResult:
    """Train and evaluate every mode of one task on the registry's splits.

    ``features`` is read by several jobs: pass a settled table.  ``registry`` may carry a
    ``years`` column that restricts each entry's rows.  Caps are off by default; Spark
    trains on all rows.  With ``explain`` each fitted model gets the attributions of all test
    rows: of the class ``Faulted`` in detection, of the true class in classification.
    """
    if any(m in SEQUENCE for m in modes) and not (window_size and stride):
        raise ValueError("Sequence modes require these parameters: window_size, stride")
    result = TaskResult(target)
    entries = broadcast_checked(R.resolve_entries(registry, target))
    placed = place_rows(features, entries)
    sides = {s: placed.where(F.col("split") == s).select(*features.columns)
             for s in ("train", "val", "test")}
    task = open_task(placed.where(F.col("split").isin("train", "val")), target)
    if task is None:
        return result
    result.class_names, result.classes = task.class_names, task.classes()

    tabular = [m for m in modes if m in TABULAR]
    params = tabular_params or {}
    if tabular:
        test = task.label_rows(sides["test"])
        train_rows = S.thin_majority(sides["train"], majority_thin_factor)
        if not rows_per_batch:
            train_rows = cap_rows(train_rows, max_train_rows)
        train = task.label_rows(train_rows)
        if majority_thin_factor > 1 or max_train_rows:
            train = settle(train)  # the fit reads it several times
        if not (test.isEmpty() or train.isEmpty()):
            for mode in tabular:
                settings = params.get(mode, {})
                if rows_per_batch and mode == "random_forest":
                    kinds = {mode: ("batched_forest", names)}
                    if scada is not None:
                        kinds[f"{mode}_deployment"] = (
                            "batched_forest_deployment", [n for n in names if n in set(scada)])
                    for kind, (label, chosen) in kinds.items():
                        grown = batched_forest(
                            train, test, entries.where("split = 'train'"), chosen, task,
                            files_per_batch, rows_per_batch, settings.get("numTrees", 200), label,
                            **{k: v for k, v in settings.items() if k != "numTrees"})
                        if grown:
                            result.models[kind] = grown
                    continue
                result.models[mode] = run_tabular(mode, train, test, names, task, **settings)
                if scada is not None:
                    deployed = deployment_model(mode, train, test, names, scada, task, **settings)
                    result.models[f"{mode}_deployment"] = deployed

    for mode in (m for m in modes if m in SEQUENCE):
        labelled = {s: task.label_rows(rows) for s, rows in sides.items()}
        fitted = run_sequence(mode, labelled, names, task, window_size, stride,
                              **(sequence_params or {}).get(mode, {}))
        if fitted:
            result.models[mode] = fitted

    known = {*TABULAR, *SEQUENCE}
    for mode in (m for m in modes if m not in known):
        runner = (custom_runners or {}).get(mode)
        if runner is None:
            continue  # an unsupported mode is skipped
        labelled = {s: task.label_rows(rows) for s, rows in sides.items()}
        predictions = runner(labelled["train"], labelled["val"], labelled["test"],
                             {"target": target, "feature_names": list(names),
                              "class_names": task.class_names})
        result.models[mode] = _result(mode, list(names), predictions.withColumn(
            "model", F.lit(mode)), task, None)
    for fitted in result.models.values():
        if explain and fitted.model is not None and A.explains(fitted.model):
            of = 1 if target == DETECTION else "label"
            fitted.attribution = settle(attribution(fitted, sides["test"], of))
    return result


def place_rows(features: DataFrame, entries: DataFrame) -> DataFrame:
    """Feature rows with their file's split, restricted to each entry's years where given."""
    keep = [c for c in ("source_file", "split", "years") if c in entries.columns]
    placed = features.join(entries.select(*keep), "source_file")
    if "years" in keep:
        placed = placed.where(F.col("years").isNull() | F.array_contains(
            "years", F.col("sim_year")))
    return placed.select(*features.columns, "split")


def split_rows(features: DataFrame, entries: DataFrame, split: str) -> DataFrame:
    """Feature rows of one split."""
    files = broadcast_checked(entries.where(F.col("split") == split))
    return place_rows(features, files).select(*features.columns)


def cap_rows(rows: DataFrame, cap: int | None) -> DataFrame:
    return S.stratified_subsample(rows, cap, "fault_type") if cap else rows
