import numpy as np
import pytest
from helpers import brute_auc, close
from pyspark.sql import functions as F

from sunledger.operators import metrics as M

SCHEMA = "model string, y_true int, y_pred int, prob array<double>"


def binary(spark, scores, truth, model="m"):
    rows = [(model, int(t), int(s >= 0.5), [1 - float(s), float(s)])
            for s, t in zip(scores, truth)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("limit", [None, 12])
def test_auc_equals_all_pairs(spark, limit):
    rng = np.random.default_rng(5)
    smooth, truth = rng.random(200), rng.random(200) < 0.3
    ties = np.round(smooth, 1)
    table = binary(spark, smooth, truth, "smooth").union(binary(spark, ties, truth, "ties")).union(
        binary(spark, 1 - smooth, truth, "flipped"))
    got = {r["model"]: r["auc"] for r in M.roc_auc_binary(table, limit).collect()}
    assert close(got["smooth"], brute_auc(smooth, truth))
    assert close(got["ties"], brute_auc(ties, truth))
    assert close(got["flipped"], 1 - got["smooth"])


def test_auc_of_one_class_is_null(spark):
    table = binary(spark, [0.1, 0.9], [1, 1])
    assert M.roc_auc_binary(table).first()["auc"] is None


def multi(spark, n=150, k=3, drop=None, seed=1):
    rng = np.random.default_rng(seed)
    prob = rng.dirichlet(np.ones(k), n)
    truth = np.array([rng.choice(k, p=p) for p in prob])
    keep = truth != drop if drop is not None else np.ones(n, bool)
    prob, truth = prob[keep], truth[keep]
    rows = [("m", int(t), int(p.argmax()), [float(v) for v in p]) for p, t in zip(prob, truth)]
    return spark.createDataFrame(rows, SCHEMA), prob, truth


@pytest.mark.parametrize("limit", [None, 20])
def test_weighted_one_vs_rest(spark, limit):
    table, prob, truth = multi(spark)
    want = sum(brute_auc(prob[:, c], truth == c) * (truth == c).sum() for c in range(3)) / len(truth)
    assert close(M.roc_auc_ovr_weighted(table, limit).first()["auc"], want)


def test_one_vs_rest_with_an_absent_class_is_null(spark):
    table, _, _ = multi(spark, drop=2)
    assert M.roc_auc_ovr_weighted(table).first()["auc"] is None


def test_report_keeps_absent_classes_and_matches_the_confusion(spark):
    table, _, truth = multi(spark)
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "gone")],
                                    "label int, class_name string")
    report = {r["class_name"]: r for r in M.classification_report(table, classes).collect()}
    assert report["gone"]["support"] == 0 and report["gone"]["f1"] == 0
    pairs = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(table).collect()}
    assert len(pairs) == 9
    for label, name in enumerate("abc"):
        support = sum(n for (t, _), n in pairs.items() if t == label)
        said = sum(n for (_, p), n in pairs.items() if p == label)
        assert report[name]["support"] == support
        assert close(report[name]["recall"], pairs[label, label] / support)
        assert close(report[name]["precision"], pairs[label, label] / said)
    hit = sum(n for (t, p), n in pairs.items() if t == p)
    assert close(report["accuracy"]["f1"], hit / len(truth))
    assert close(M.accuracy(table).first()["accuracy"], hit / len(truth))
    four = [report[n]["f1"] for n in ("a", "b", "c", "gone")]
    assert close(report["macro avg"]["f1"], sum(four) / 4)
    assert report["weighted avg"]["support"] == len(truth)


def test_confusion_keeps_zero_cells_of_present_labels(spark):
    table = spark.createDataFrame([("m", 0, 2, [1.0]), ("m", 0, 0, [1.0])], SCHEMA)
    got = {(r[1], r[2]): r[3] for r in M.confusion_matrix(table).collect()}
    assert got == {(0, 0): 1, (0, 2): 1, (2, 0): 0, (2, 2): 0}


def test_merged_reports(spark):
    table, _, _ = multi(spark)
    both = table.union(table.withColumn("model", F.lit("n")))
    classes = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "label int, class_name string")
    merged = M.merge_reports(M.classification_report(both, classes), classes, ["m", "n"])
    assert set(merged.columns) == {"fault_type", *[f"{m}_{v}" for m in "mn"
                                                   for v in ("f1", "precision", "recall")]}
    assert merged.where("m_f1 <> n_f1").count() == 0 and merged.count() == 3


def test_ranking_puts_undefined_last(spark):
    table = spark.createDataFrame([("a", None), ("b", 0.5), ("c", 0.9)], "model string, auc double")
    assert [r[0] for r in M.rank_models(table).collect()] == ["c", "b", "a"]


def test_attribution_and_importance(spark):
    rows = [(i, f, v) for i, (f, v) in enumerate(
        [("x", 1.0), ("x", -3.0), ("y", 0.5), ("stress_a", 0.1)])]
    table = spark.createDataFrame(rows, "sample_id long, feature string, value double")
    top = M.attribution_summary(table, 2).collect()
    assert [(r["feature"], r["mean_abs"], r["direction"]) for r in top] == [
        ("x", 2.0, "healthy"), ("y", 0.5, "fault")]
    groups = spark.createDataFrame([("stress_a", "stress")], "feature string, feature_group string")
    scores = spark.createDataFrame([("x", 0.2), ("stress_a", 0.8)], "feature string, importance double")
    assert [(r["feature"], r["feature_group"]) for r in M.importance_top(scores, groups).collect()
            ] == [("stress_a", "stress"), ("x", "scada")]
