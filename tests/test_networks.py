"""The distributed perceptron against plain numpy."""

import numpy as np
import pytest

from sunledger.plans import networks as N
from sunledger.session import scratch_path, settle

LAYERS = [3, 4, 3]
SCHEMA = ("features array<double>, label int, weight double, for_train boolean, "
          "for_val boolean")


def points(n=240, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] * x[:, 1] > 0, 2, (x[:, 2] > 0).astype(int))
    return x, y, np.array([0.5, 1.0, 2.0])[y], np.arange(n) % 4 > 0


def frame(spark, x, y, w, train):
    rows = [(list(map(float, a)), int(b), float(c), bool(t), not t)
            for a, b, c, t in zip(x, y, w, train)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_fit(x, y, w, train, schedule):
    """The same rounds over whole arrays."""
    state, history = N.start_weights(LAYERS, schedule.seed), []
    m, v, rate, stale = np.zeros_like(state), np.zeros_like(state), schedule.rate, 0
    best, least = None, np.inf
    for t in range(1, schedule.rounds + 1):
        loss, slope = N.loss_and_gradient(state, LAYERS, x[train], y[train], w[train])
        p = N.probabilities(state, LAYERS, x[~train])[-1]
        val = np.average(-np.log(p[np.arange(len(p)), y[~train]]), weights=w[~train])
        better = val < least - schedule.least_gain
        stale = 0 if better else stale + 1
        if better:
            best, least = state, val
        elif stale % (schedule.halve_after + 1) == 0:
            rate /= 2
        history.append((loss / w[train].sum(), val, (p.argmax(1) == y[~train]).mean(), rate))
        slope = slope / w[train].sum() + schedule.decay * state
        slope *= min(1.0, schedule.clip / np.linalg.norm(slope))
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        state = state - rate * min(1.0, t / schedule.warm_up) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        if stale >= schedule.patience:
            break
    return best, np.array(history)


def test_gradient_equals_differences():
    x, y, w, _ = points(20)
    at = N.start_weights(LAYERS, 3) + 0.1
    _, slope = N.loss_and_gradient(at, LAYERS, x, y, w)
    for i in range(len(at)):
        step = np.zeros_like(at)
        step[i] = 1e-6
        ends = [N.loss_and_gradient(at + s, LAYERS, x, y, w)[0] for s in (step, -step)]
        assert abs((ends[0] - ends[1]) / 2e-6 - slope[i]) < 1e-5


@pytest.mark.parametrize("parts, schedule", [
    (1, N.Schedule(rounds=12)), (5, N.Schedule(rounds=25, rate=1.5, patience=3, halve_after=1))])
def test_rounds_equal_a_run_in_one_process(spark, parts, schedule):
    data = points()
    found, history = N.fit(settle(frame(spark, *data).repartition(parts)), LAYERS, schedule)
    best, rounds = plain_fit(*data, schedule)
    got = np.array([tuple(r) for r in history.select(
        "train_loss", "val_loss", "val_accuracy", "rate").collect()])
    assert got.shape == rounds.shape and np.abs(got - rounds).max() < 1e-7
    assert np.abs(found - best).max() < 1e-7
    if parts > 1:  # the large rate makes the fit stop early, with a halved rate
        assert len(got) < schedule.rounds and got[-1, 3] < schedule.rate


def test_a_stopped_fit_goes_on_from_its_last_round(spark):
    rows = settle(frame(spark, *points()))
    whole, history = N.fit(rows, LAYERS, N.Schedule(rounds=6))
    path = scratch_path(spark, "rounds")
    N.fit(rows, LAYERS, N.Schedule(rounds=2), path)
    resumed, again = N.fit(rows, LAYERS, N.Schedule(rounds=6), path)
    assert np.abs(whole - resumed).max() < 1e-9
    assert [r["round"] for r in again.collect()] == [r["round"] for r in history.collect()]
    done, _ = N.fit(rows, LAYERS, N.Schedule(rounds=6), path)
    assert np.abs(done - resumed).max() < 1e-12


def test_sums_of_many_tasks_are_added_up_on_executors(spark, monkeypatch):
    rows = settle(frame(spark, *points()).repartition(7))
    weights = N.start_weights(LAYERS, 2)
    direct = N.sums(rows, weights, LAYERS, 7)
    monkeypatch.setattr(N, "ADDERS", 3)
    added = N.sums(rows, weights, LAYERS, 7)
    for name, value in direct.items():
        assert np.allclose(value, added[name], atol=1e-9)


def test_spark_scores_with_the_same_probabilities(spark):
    from pyspark.ml.feature import VectorAssembler
    x, *_ = points(30)
    weights = N.start_weights(LAYERS, 8)
    table = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"))
    got = [r[0].toArray() for r in
           N.as_model(weights, LAYERS, spark).transform(table).select("probability").collect()]
    assert np.abs(np.array(got) - N.probabilities(weights, LAYERS, x)[-1]).max() < 1e-12
