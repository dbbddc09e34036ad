import pytest
from pyspark.sql import functions as F

from sunledger.catalog import inputs as I
from sunledger.catalog import model_queries as MQ
from sunledger.catalog import queries as Q
from sunledger.functions import columns as C
from sunledger.operators import registry as R
from sunledger.plans import models as P
from sunledger.plans import studies as ST
from sunledger.session import scratch_path, settle
from sunledger.sources import manifest as MF

NAMES = ["performance_ratio", "pr_deviation", "dc_ac_power_ratio", "power_step", "hour_sin"]
SMALL = {"numTrees": 8, "maxDepth": 5, "minInstancesPerNode": 2}
FOREST = {"tabular_params": {"random_forest": SMALL}}


@pytest.fixture(scope="module")
def data(spark, sf):
    return I.settled_features(spark, sf, extended=True), settle(I.registry(spark, sf))


@pytest.mark.parametrize("target", [P.DETECTION, P.CLASSIFICATION])
def test_forest_finds_the_planted_signal(data, target):
    result = P.run_task(*data, target, NAMES, **FOREST)
    assert result.aucs()["random_forest"] > 0.95
    report = {r["class_name"]: r for r in result.reports().collect()}
    rows = result.models["random_forest"].predictions.count()
    assert report["weighted avg"]["support"] == rows
    assert set(result.class_names) < set(report)


def test_shuffled_labels_give_no_skill(data):
    table, files = data
    noise = table.withColumn("fault_active", F.crc32(F.col("event_id").cast("string")) % 2 == 0)
    auc = P.run_task(noise, files, P.DETECTION, ["performance_ratio", "hour_sin"], **FOREST).aucs()
    assert 0.35 < auc["random_forest"] < 0.65


def test_unscored_rows_are_never_thinned(data):
    table, files = data
    one, two = (P.run_task(table, files, P.DETECTION, NAMES, majority_thin_factor=k, **FOREST)
                for k in (1, 4))
    assert (one.models["random_forest"].predictions.count()
            == two.models["random_forest"].predictions.count()
            == P.split_rows(table, files, "test").count())


def test_modes_and_runners(spark, data):
    with pytest.raises(ValueError):
        P.build_model("perceptron_of_doom")
    with pytest.raises(ValueError):
        P.run_task(*data, P.DETECTION, NAMES, ["mlp"])
    assert P.random_forest(numTrees=3).getNumTrees() == 3
    assert P.random_forest().getNumTrees() == 200

    def rule(train, val, test, params):
        assert params["class_names"] == ["Healthy", "Faulted"]
        p = F.col("dc_ac_power_ratio").cast("double") / 5.0
        return test.select(F.col("label").cast("int").alias("y_true"),
                           (p > 0.2).cast("int").alias("y_pred"),
                           F.array(1 - p, p).alias("prob"))
    result = P.run_task(*data, P.DETECTION, NAMES, ["rule", "unknown"],
                        custom_runners={"rule": rule})
    assert list(result.models) == ["rule"] and result.aucs()["rule"] > 0.95


def test_no_test_files_give_no_models(data):
    table, files = data
    assert P.run_task(table, files.where("split = 'train'"), P.DETECTION, NAMES).models == {}


def test_sequence_models(data):
    result = P.run_task(*data, P.CLASSIFICATION, NAMES, ["mlp", "window_summary"],
                        window_size=6, stride=2, sequence_params={
                            "window_summary": SMALL, "mlp": {"rounds": 60}})
    assert set(result.models) == {"mlp", "window_summary"}
    assert all(auc is None or auc > 0.75 for auc in result.aucs().values()), result.aucs()
    rounds = result.models["mlp"].history.collect()
    assert [r["round"] for r in rounds] == list(range(1, len(rounds) + 1)) and len(rounds) <= 60
    assert rounds[-1]["train_loss"] < rounds[0]["train_loss"]
    assert result.models["window_summary"].history is None
    table = result.per_fault_f1()
    assert {"mlp_f1", "window_summary_recall"} <= set(table.columns)
    too_long = P.run_task(*data, P.DETECTION, NAMES, ["mlp"], window_size=5000, stride=10)
    assert too_long.models == {}


def test_batched_forest_splits_its_trees(data):
    table, files = data
    result = P.run_task(table, files, P.CLASSIFICATION, NAMES, rows_per_batch=300,
                        files_per_batch=3, **FOREST)
    forest = result.models["random_forest"]
    prob = forest.predictions.select(F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)).first()[0]
    assert abs(prob - 1) < 1e-9
    assert forest.predictions.where(F.size("prob") != len(result.class_names)).count() == 0


def test_batched_forest_keeps_its_model_and_its_deployment_twin(spark, data):
    table, files = data
    scada = ["dc_ac_power_ratio", "power_step", "hour_sin"]
    result = P.run_task(table, files, P.CLASSIFICATION, NAMES, rows_per_batch=300,
                        files_per_batch=3, scada=scada, **FOREST)
    assert set(result.models) == {"random_forest", "random_forest_deployment"}
    assert result.models["random_forest_deployment"].feature_names == [
        n for n in NAMES if n in scada]
    paths = {}
    for mode, fitted in result.models.items():
        assert fitted.model.stages[-1].getNumTrees == SMALL["numTrees"]
        assert P.importances(fitted).count() == len(fitted.feature_names)
        paths[mode] = MF.save_model(fitted.model, scratch_path(spark, "model"),
                                    fitted.feature_names, result.class_names)
    listing = MF.save_manifest(files, scratch_path(spark, "manifest"), {P.CLASSIFICATION: paths})
    assert ST.evaluate_saved(table, listing, P.CLASSIFICATION).aucs() == result.aucs()


class _Watched:
    """A forest estimator that notes the rows and trees of every fit."""

    def __init__(self, seen, make, params):
        self.seen, self.trees, self.made = seen, params["numTrees"], make(**params)

    def fit(self, rows):
        self.seen.append((self.trees, sorted(int(r[0][0]) for r in rows.select("features").collect())))
        return self.made.fit(rows)


def _batch_fits(spark, monkeypatch, sizes, n_rows, trees=6, **options):
    """Fits of a batched forest over files of ``n_rows`` faulted rows; feature 0 numbers the rows."""
    seen, make = [], P.random_forest
    monkeypatch.setattr(P, "random_forest", lambda **params: _Watched(seen, make, params))
    files = [(f"{kind}{i:02d}", kind) for kind, n in sizes.items() for i in range(n)]
    rows = [(name, n_rows * at + i, 1.0 * (n_rows * at + i), kind, True)
            for at, (name, kind) in enumerate(files) for i in range(n_rows)]
    table = spark.createDataFrame(
        rows, "source_file string, event_id long, a float, fault_type string, fault_active boolean")
    entries = spark.createDataFrame(files, "source_file string, file_fault_type string")
    task = P.open_task(table, P.CLASSIFICATION)
    train = task.label_rows(table)
    forest = P.batched_forest(train, train, entries, ["a"], task, num_trees=trees, maxDepth=2,
                              minInstancesPerNode=1, **options)
    return list(seen), len(rows), forest


def test_batched_forest_fits_every_row_of_a_batch_above_the_limit(spark, monkeypatch):
    fits, n_rows, forest = _batch_fits(spark, monkeypatch, {"x": 4, "y": 4}, 50,
                                       files_per_batch=4, rows_per_batch=90)
    assert sorted(i for _, rows in fits for i in rows) == list(range(n_rows))
    # two batches of 200 rows, each dealt out to three pieces
    assert [n for n, _ in fits] == [1] * 6 and all(30 < len(rows) < 110 for _, rows in fits)
    assert forest.model.stages[-1].getNumTrees == 6
    whole, _, _ = _batch_fits(spark, monkeypatch, {"x": 4, "y": 4}, 50, files_per_batch=4)
    assert [(n, len(rows)) for n, rows in whole] == [(3, 200), (3, 200)]
    few, _, _ = _batch_fits(spark, monkeypatch, {"x": 4, "y": 4}, 50, trees=2, files_per_batch=4,
                            rows_per_batch=10)
    assert len(few) == 2 and sorted(i for _, rows in few for i in rows) == list(range(n_rows))


def test_batched_forest_fits_files_that_the_round_robin_leaves_out(spark, monkeypatch):
    sizes = {"x": 9, "y": 1}
    listed = R.class_balanced_batches(spark.createDataFrame(
        [(f"{k}{i:02d}", k) for k, n in sizes.items() for i in range(n)],
        "source_file string, file_fault_type string"), 5)
    assert listed.select("source_file").distinct().count() < 10
    fits, n_rows, _ = _batch_fits(spark, monkeypatch, sizes, 3, files_per_batch=5)
    assert {i for _, rows in fits for i in rows} == set(range(n_rows))


def test_batched_forest_query_trains_on_all_faulted_rows(spark, sf, monkeypatch):
    table, files, _ = MQ._inputs(spark, sf)
    held = files.where("split = 'train' and file_fault_type <> 'none'").select("source_file")
    want = {r[0] for r in table.join(held, "source_file").where("fault_active")
            .select("event_id").collect()}
    got, grow = [], P.batched_forest

    def noted(train, *args, **options):
        got.extend(r[0] for r in train.select("event_id").collect())
        return grow(train, *args, **options)
    monkeypatch.setattr(P, "batched_forest", noted)
    assert MQ.batched_forest(spark, sf).count() == 1
    assert len(got) == len(want) and set(got) == want


def test_joined_forests_average_by_trees(spark):
    rows = spark.range(400).select((F.col("id") % 7 > 3).cast("double").alias("label"),
                                   (F.col("id") % 7).cast("double").alias("a"),
                                   (F.col("id") % 5).cast("double").alias("b"),
                                   F.lit(1.0).alias("weight"))
    rows = P.assembler(["a", "b"]).transform(rows)
    forests = [P.random_forest(numTrees=n, maxDepth=2, seed=n).fit(rows.sample(0.3, seed=n))
               for n in (1, 4)]
    assert P.join_forests(forests).getNumTrees == 5
    prob = [[r[0].toArray() for r in f.transform(rows).select("probability").collect()]
            for f in (*forests, P.join_forests(forests))]
    assert all(abs(j - (a + 4 * b) / 5).max() < 1e-12 for a, b, j in zip(*prob))


def test_balance_levels_the_classes(spark):
    rows = spark.range(1311).select("id", F.when(F.col("id") < 1000, 0.0).when(
        F.col("id") < 1010, 1.0).when(F.col("id") == 1010, 2.0).otherwise(3.0).alias("label"))
    got = {r[0]: r[1] for r in P.balance(rows, ["id"]).groupBy("label").count().collect()}
    assert got[0.0] == got[1.0] == got[2.0] == 1000 and 900 <= got[3.0] <= 1100


def test_saved_models_score_the_manifest_files(spark, data):
    table, files = data
    result = P.run_task(table, files, P.CLASSIFICATION, NAMES, **FOREST)
    fitted = result.models["random_forest"]
    path = MF.save_model(fitted.model, scratch_path(spark, "model"), fitted.feature_names,
                         result.class_names)
    listing = MF.save_manifest(files, scratch_path(spark, "manifest"),
                               {P.CLASSIFICATION: {"random_forest": path}})
    again = ST.evaluate_saved(table, listing, P.CLASSIFICATION)
    assert again.aucs() == result.aucs() and again.class_names == result.class_names
    ranked = ST.compare_models([result, again]).collect()
    assert len(ranked) == 2


def test_saved_window_models_cut_and_score_as_before(spark, data):
    table, files = data
    result = P.run_task(table, files, P.DETECTION, NAMES, ["mlp", "window_summary"],
                        window_size=6, stride=2, sequence_params={
                            "mlp": {"rounds": 8}, "window_summary": SMALL})
    paths = {mode: MF.save_model(fitted.model, scratch_path(spark, "model"), fitted.feature_names,
                                 result.class_names, fitted.windows)
             for mode, fitted in result.models.items()}
    listing = MF.save_manifest(files, scratch_path(spark, "manifest"), {P.DETECTION: paths})
    again = ST.evaluate_saved(table, listing, P.DETECTION)
    assert set(again.models) == {"mlp", "window_summary"}
    for mode, fitted in again.models.items():
        before, now = (m.predictions.select("y_true", "y_pred", "prob")
                       for m in (result.models[mode], fitted))
        assert before.count() == now.count() > 0
        assert before.exceptAll(now).count() == 0
        assert (fitted.windows.size, fitted.windows.stride) == (6, 2)


def test_saved_kernel_models_score_as_before(spark, data):
    table, files = data
    result = P.run_task(table, files, P.DETECTION, NAMES, ["window_kernels"], window_size=6,
                        stride=2)
    fitted = result.models["window_kernels"]
    path = MF.save_model(fitted.model, scratch_path(spark, "model"), fitted.feature_names,
                         result.class_names, fitted.windows)
    listing = MF.save_manifest(files, scratch_path(spark, "manifest"),
                               {P.DETECTION: {"window_kernels": path}})
    again = ST.evaluate_saved(table, listing, P.DETECTION).models["window_kernels"]
    before, now = (m.predictions.select("y_true", "y_pred", "prob") for m in (fitted, again))
    assert before.count() == now.count() > 0 and before.exceptAll(now).count() == 0
    assert not P.A.explains(fitted.model)  # a linear model has no attributions here


def test_temporal_features_equal_separate_features(spark, sf):
    rows = I.rows(spark, sf)
    last = rows.where("sim_year = 3")
    apart = I.add_features(last, I.KWP).select("event_id", "pr_deviation", "power_step")
    files = rows.select("source_file").distinct().withColumn("split", F.lit("train"))
    joint = ST.temporal_features(rows, I.KWP, files).where("sim_year = 3").select(apart.columns)
    # a later year that only a test file reaches does not move the restart
    later = rows.where("sim_year = 3").limit(1).withColumns(
        {"source_file": F.lit("late"), "sim_year": F.lit(4), "event_id": F.lit(-1)})
    pool = files.union(later.select("source_file", F.lit("test")))
    moved = ST.temporal_features(rows.unionByName(later), I.KWP, pool).where(
        "sim_year = 3").select(apart.columns)
    assert moved.exceptAll(apart).count() == 0 and moved.count() == apart.count()
    assert joint.exceptAll(apart).count() == 0 and joint.count() == apart.count()


def test_studies(spark, sf, data):
    table, files = data
    temporal = ST.temporal_split_study(I.rows(spark, sf), I.KWP, files, NAMES, **FOREST).first()
    assert temporal["detection_auc"] > 0.9
    sites = settle(I.sites(spark, sf))
    folds = R.location_folds(files, sites).select("test_loc_id").distinct().count()
    cross = ST.cross_location_study(table, files, sites, I.named_sites(spark, sf), NAMES, **FOREST)
    assert cross.count() == folds and cross.where("test_location is null").count() == 0
    lists = C.category_lists(Q.classify_columns(spark, sf))
    ablation = {r["feature_set"]: r for r in ST.ablation_study(
        table, files, lists, **FOREST).collect()}
    assert set(ablation) == set(C.ABLATION_SETS)
    assert ablation["Full"]["n_features"] > ablation["SCADA only"]["n_features"]


def test_model_queries_are_all_registered():
    import __spark_entry__ as entry
    assert set(MQ.MODEL_QUERIES) <= set(entry.queries())


def test_random_forest_query_runs_the_library_settings(spark, sf, monkeypatch):
    monkeypatch.setattr(MQ, "_inputs", lambda *args: (None, None, None))
    monkeypatch.setattr(MQ.C, "feature_set", lambda *args: [])
    monkeypatch.setattr(MQ.P, "run_task", lambda *args, **options: options)
    monkeypatch.setattr(MQ, "_aucs", lambda options: options["tabular_params"])
    forest = P.random_forest(**MQ.random_forest(spark, sf).get("random_forest", {}))
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (
        200, 15, 20)


def test_registry_parses_each_file_name_once(spark, sf):
    from sunledger.catalog import inputs
    from sunledger.operators.registry import assign_splits
    plan = assign_splits(inputs.plain_registry(spark, sf))._jdf.queryExecution()
    assert "events.parquet" not in plan.optimizedPlan().toString()
    assert "regexp_replace" not in plan.optimizedPlan().toString()


def test_queries_of_several_runs_share_their_inputs(spark, sf, monkeypatch):
    made, given = [], []
    monkeypatch.setattr(MQ, "_inputs", lambda *args: made.append(1) or (
        "table", "files", {"scada": ["a"], "stress": ["b"]}))
    monkeypatch.setattr(MQ.P, "run_task", lambda table, *args, **kw: given.append(table))
    monkeypatch.setattr(MQ.ST, "compare_models", list)
    monkeypatch.setattr(MQ, "_aucs", lambda result: result)
    MQ.compare_models(spark, sf)
    assert made == [1] and given == ["table", "table"]
    MQ.deployment_model(spark, sf)
    assert made == [1, 1]
