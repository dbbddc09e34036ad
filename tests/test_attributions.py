"""Attributions of fitted models against the models themselves and plain Python."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sunledger.catalog import inputs as I
from sunledger.plans import attributions as A
from sunledger.plans import models as P
from sunledger.plans import networks as N
from sunledger.session import settle

NAMES = ["a", "b", "c"]


def points(spark, n=400, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] > 0.3, 2, (x[:, 1] * x[:, 2] > 0).astype(int))
    rows = [(i, *map(float, r), float(k)) for i, (r, k) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, c double, label double")


def forest(table, **params):
    weighted = table.withColumn("weight", F.lit(1.0))
    tools = VectorAssembler(inputCols=NAMES, outputCol="features")
    fitted = P.random_forest(numTrees=7, maxDepth=5, minInstancesPerNode=3, **params).fit(
        tools.transform(weighted))
    return PipelineModel(stages=[tools, fitted])


def plain_path(tree, x, target):
    """One row down one tree, step by step."""
    at, out = tree.roots[0], np.zeros(len(x))
    while tree.feature[at] >= 0:
        f = tree.feature[at]
        there = tree.left[at] if x[f] <= tree.threshold[at] else tree.right[at]
        out[f] += tree.shares[there, target] - tree.shares[at, target]
        at = there
    return out


def test_forest_arrays_score_like_the_forest_and_add_up(spark):
    x, y, table = points(spark)
    model = forest(table)
    trees = A.explained(model)
    theirs = np.array([r[0].toArray() for r in model.transform(table).orderBy("id").select(
        "probability").collect()])
    assert len(trees.roots) == 7
    assert np.abs(trees.probabilities(x) - theirs).max() < 1e-12
    for of in ("label", 1, None):
        found = A.attributions(table.repartition(5), NAMES, trees, ["id"], of).orderBy("id").collect()
        values = np.array([r["values"] for r in found])
        goal = np.array([r["probability"] - r["base"] for r in found])
        assert np.abs(values.sum(axis=1) - goal).max() < 1e-12
        target = np.array([r["target"] for r in found])
        assert (target == (y if of == "label" else 1 if of == 1 else theirs.argmax(1))).all()
        assert np.abs(np.array([r["probability"] for r in found])
                      - theirs[np.arange(len(y)), target]).max() < 1e-12


def test_every_tree_is_credited_step_by_step(spark):
    x, y, table = points(spark, 60)
    trees = A.explained(forest(table))
    ones = [A.Forest(trees.feature, trees.threshold, trees.left, trees.right, trees.shares,
                     np.array([r])) for r in trees.roots]
    plain = np.array([np.mean([plain_path(t, row, k) for t in ones], axis=0)
                      for row, k in zip(x, y)])
    assert np.abs(trees.attribute(x, y) - plain).max() < 1e-12


def test_joined_forests_are_explained_as_one(spark):
    x, _, table = points(spark)
    one, two = forest(table), forest(table.where("id % 2 = 0"), subsamplingRate=0.7)
    joined = PipelineModel(stages=[one.stages[0], P.join_forests([one.stages[1], two.stages[1]])])
    trees = A.explained(joined)
    theirs = np.array([r[0].toArray() for r in joined.transform(table).orderBy("id").select(
        "probability").collect()])
    assert len(trees.roots) == 14 and np.abs(trees.probabilities(x) - theirs).max() < 1e-12


def test_path_gradients_add_up_and_follow_the_slope(spark):
    x, y, table = points(spark)
    layers = (3, 6, 5, 3)
    weights = N.start_weights(layers, 3) * 12  # steep: the way must be cut finer for some rows
    slope = N.input_gradient(weights, layers, x[:20], y[:20])
    for f in range(3):
        step = np.zeros(3)
        step[f] = 1e-6
        up, down = (N.probabilities(weights, layers, x[:20] + s)[-1][np.arange(20), y[:20]]
                    for s in (step, -step))
        assert np.abs((up - down) / 2e-6 - slope[:, f]).max() < 1e-6
    tool = A.Network(weights, layers, np.zeros(3))
    assert np.abs(tool._along(x, y, 1).sum(1) - tool.probabilities(x)[np.arange(400), y]
                  + tool.base()[y]).max() > A.TOLERANCE
    rows = A.attributions(table.repartition(3), NAMES, tool, ["id"], "label").collect()
    gap = [abs(sum(r["values"]) - r["probability"] + r["base"]) for r in rows]
    assert len(rows) == 400 and max(gap) < 1e-6


def test_unknown_classes_empty_tables_and_flat_inputs(spark):
    _, _, table = points(spark, 40)
    trees = A.explained(forest(table))
    odd = table.withColumn("label", F.when(F.col("id") == 0, 9.0).when(F.col("id") > 1, F.col("label")))
    rows = {r["id"]: r for r in A.attributions(odd, NAMES, trees, ["id"], "label").collect()}
    assert len(rows) == 40
    for i in (0, 1):  # a class beyond the model's, and NULL
        assert rows[i]["values"] is None and rows[i]["target"] is None and rows[i]["base"] is None
    assert A.attributions(table.limit(0), NAMES, trees, ["id"]).collect() == []
    assert A.by_feature(A.attributions(odd, NAMES, trees, ["id"], "label"), NAMES).count() == 38 * 3
    single = PipelineModel(stages=[None, None])
    with pytest.raises(ValueError):
        A.explained(single)


def test_rule_tree_counts_its_shares(spark):
    x, y, table = points(spark)
    rules = [("a", 0.3, 1, 2), ("b", 0.0, 3, 4), None, None, None]
    tree = A.rule_tree(table, rules, NAMES, 3)
    low = x[:, 0] <= 0.3
    for node, part in ((0, low | ~low), (1, low), (2, ~low), (3, low & (x[:, 1] <= 0)),
                       (4, low & (x[:, 1] > 0))):
        assert np.allclose(tree.shares[node], np.bincount(y[part], minlength=3) / part.sum())


def test_run_task_explains_rows_and_windows(spark, sf):
    names = ["performance_ratio", "pr_deviation", "dc_ac_power_ratio", "hour_sin"]
    table, files = I.settled_features(spark, sf, extended=True), settle(I.registry(spark, sf))
    result = P.run_task(table, files, P.DETECTION, names, ["random_forest", "mlp"],
                        window_size=6, stride=2, explain=True,
                        tabular_params={"random_forest": {"numTrees": 6, "maxDepth": 5}},
                        sequence_params={"mlp": {"rounds": 30}})
    for mode, fitted in result.models.items():
        rows = fitted.attribution.collect()
        assert len(rows) == fitted.predictions.count() and {r["target"] for r in rows} == {1}
        assert max(abs(sum(r["values"]) - r["probability"] + r["base"]) for r in rows) < 1e-6
        found = P.attributed_features(fitted).collect()
        assert {r["feature"] for r in found} == set(names)
    # the planted signal is a gain of DC over AC power
    strongest = P.attributed_features(result.models["random_forest"]).first()
    assert strongest["feature"] == "dc_ac_power_ratio"
