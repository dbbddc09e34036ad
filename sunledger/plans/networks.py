"""A perceptron fitted over all rows at once and watched on validation rows.

Every round is one Spark job: each task adds up the weighted cross-entropy of its rows, the
gradient and the validation counts, the sums are added up on executors, and the driver takes
one Adam step.  The driver sees sums of the network's size only.  A round's state is written
before the next one starts, so that a fit goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.session import scratch_path

#: tasks whose partial sums the driver adds up itself; those of more tasks are added up first
ADDERS = 64
_STATE = ("round int, train_loss double, val_loss double, val_accuracy double, rate double, "
          "stale int, best boolean, weights array<double>, first array<double>, "
          "second array<double>")
_SUMS = "train double, weight double, val double, val_weight double, right double, rows double, gradient array<double>"
_BLOCK = 4096


@dataclass(frozen=True)
class Schedule:
    """At most ``rounds`` steps; the rate rises over the first ``warm_up`` rounds, is halved when the validation loss has not improved
    for more than ``halve_after`` rounds, and after ``patience`` rounds the fit ends."""

    rounds: int = 100
    rate: float = 0.02
    warm_up: int = 10
    patience: int = 7
    halve_after: int = 3
    least_gain: float = 1e-5
    decay: float = 1e-5
    clip: float = 1.0
    seed: int = 42


def n_weights(layers: Sequence[int]) -> int:
    return sum(a * b + b for a, b in zip(layers, layers[1:]))


def start_weights(layers: Sequence[int], seed: int) -> np.ndarray:
    """Uniform draws scaled by a layer's width, zero offsets; laid out as Spark's perceptron."""
    rng, parts = np.random.default_rng(seed), []
    for a, b in zip(layers, layers[1:]):
        reach = np.sqrt(6.0 / (a + b))
        parts += [rng.uniform(-reach, reach, a * b), np.zeros(b)]
    return np.concatenate(parts)


def _layers(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(layers, layers[1:]):
        out.append((weights[at:at + a * b].reshape(a, b), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def probabilities(weights: np.ndarray, layers: Sequence[int], x: np.ndarray) -> list[np.ndarray]:
    """The output of every layer: logistic hidden ones, then the class probabilities."""
    outs, parts = [x], _layers(weights, layers)
    for i, (w, offset) in enumerate(parts):
        z = outs[-1] @ w + offset
        if i + 1 < len(parts):
            outs.append(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))
        else:
            z = np.exp(z - z.max(axis=1, keepdims=True))
            outs.append(z / z.sum(axis=1, keepdims=True))
    return outs


def loss_and_gradient(weights: np.ndarray, layers: Sequence[int], x: np.ndarray, y: np.ndarray,
                      importance: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums over rows of the weighted cross-entropy and of its gradient."""
    outs = probabilities(weights, layers, x)
    rows = np.arange(len(y))
    loss = -(importance * np.log(np.maximum(outs[-1][rows, y], 1e-300))).sum()
    delta = outs[-1].copy()
    delta[rows, y] -= 1.0
    delta *= importance[:, None]
    parts, gradient = _layers(weights, layers), []
    for i in range(len(parts) - 1, -1, -1):
        gradient = [(outs[i].T @ delta).ravel(), delta.sum(axis=0), *gradient]
        if i:
            delta = (delta @ parts[i][0].T) * outs[i] * (1.0 - outs[i])
    return float(loss), np.concatenate(gradient)


def input_gradient(weights: np.ndarray, layers: Sequence[int], x: np.ndarray,
                   target: np.ndarray) -> np.ndarray:
    """Gradient of every row's probability of its target class by the inputs."""
    outs = probabilities(weights, layers, x)
    rows = np.arange(len(x))
    found = outs[-1][rows, target]
    delta = -found[:, None] * outs[-1]
    delta[rows, target] += found
    parts = _layers(weights, layers)
    for i in range(len(parts) - 1, -1, -1):
        delta = delta @ parts[i][0].T
        if i:
            delta = delta * outs[i] * (1.0 - outs[i])
    return delta


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def sums(rows: DataFrame, weights: np.ndarray, layers: Sequence[int],
         n_tasks: int | None = None) -> dict:
    """Train loss and gradient, validation loss and hits, over ``(features, label, weight,
    for_train, for_val)``; a row may serve both."""
    size = n_weights(layers)

    def total(pieces: Iterator[tuple]) -> pa.RecordBatch:
        added, gradient = np.zeros(6), np.zeros(size)
        for numbers, part in pieces:
            added += numbers
            if part is not None:
                gradient += part
        return pa.RecordBatch.from_arrays(
            [*[pa.array([v]) for v in added], pa.array([gradient.tolist()])],
            ["train", "weight", "val", "val_weight", "right", "rows", "gradient"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for batch in batches:
                for at in range(0, batch.num_rows, _BLOCK):
                    part = batch.slice(at, _BLOCK)
                    x, y = _matrix(part["features"], layers[0]), np.asarray(part["label"], int)
                    w = np.asarray(part["weight"], float)
                    for_train, for_val = (np.asarray(part[c].to_numpy(zero_copy_only=False), bool)
                                          for c in ("for_train", "for_val"))
                    numbers, gradient = np.zeros(6), None
                    if for_train.any():
                        numbers[0], gradient = loss_and_gradient(
                            weights, layers, x[for_train], y[for_train], w[for_train])
                        numbers[1] = w[for_train].sum()
                    if for_val.any():
                        found = probabilities(weights, layers, x[for_val])[-1]
                        hit, vw = y[for_val], w[for_val]
                        numbers[2] = -(vw * np.log(np.maximum(
                            found[np.arange(len(hit)), hit], 1e-300))).sum()
                        numbers[3:] = vw.sum(), (found.argmax(axis=1) == hit).sum(), len(hit)
                    yield numbers, gradient
        yield total(pieces())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield total((np.array([batch[c][i].as_py() for c in batch.schema.names[:6]]),
                     np.asarray(batch["gradient"][i].values))
                    for batch in batches for i in range(batch.num_rows))

    partial = rows.mapInArrow(measure, _SUMS)
    if (n_tasks or rows.rdd.getNumPartitions()) > ADDERS:
        partial = partial.repartition(ADDERS).mapInArrow(add, _SUMS)
    few = partial.collect()  # at most ADDERS rows
    out = {name: sum(r[name] for r in few) for name in ("train", "weight", "val", "val_weight",
                                                        "right", "rows")}
    out["gradient"] = np.sum([r["gradient"] for r in few], axis=0)
    return out


def fit(rows: DataFrame, layers: Sequence[int], schedule: Schedule = Schedule(),
        path: str | None = None) -> tuple[np.ndarray, DataFrame]:
    """The weights with the lowest validation loss, and one row per round.

    ``rows`` is read once a round, so it should be settled.  Rounds are written below ``path``;
    a path that holds rounds is gone on with from its last one.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, "rounds")
    past, n_tasks = _read(spark, path), rows.rdd.getNumPartitions()
    best, best_loss = None, np.inf
    weights = start_weights(layers, schedule.seed)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    rate, stale, number = schedule.rate, 0, 0
    if past is not None:
        top = past.where("best").orderBy("val_loss", "round").first()
        if top is not None:
            best, best_loss = np.array(top["weights"]), top["val_loss"]
        last = past.orderBy(F.desc("round")).first()
        number, rate, stale = last["round"], last["rate"], last["stale"]
        first, second = np.array(last["first"]), np.array(last["second"])
        weights = np.array(last["weights"])
        # the step that followed the last written round
        found = sums(rows, weights, layers, n_tasks)
        weights, first, second = _step(weights, first, second, found, number, rate, schedule)
    while number < schedule.rounds and stale < schedule.patience:
        number += 1
        found = sums(rows, weights, layers, n_tasks)
        train = found["train"] / max(found["weight"], 1e-300)
        val = found["val"] / max(found["val_weight"], 1e-300)
        better = val < best_loss - schedule.least_gain
        if better:
            best, best_loss, stale = weights, val, 0
        else:
            stale += 1
            if stale % (schedule.halve_after + 1) == 0:
                rate /= 2
        state = (number, train, val, found["right"] / max(found["rows"], 1.0), rate, stale, better,
                 weights.tolist(), first.tolist(), second.tolist())
        spark.createDataFrame([state], _STATE).coalesce(1).write.mode("append").parquet(path)
        weights, first, second = _step(weights, first, second, found, number, rate, schedule)
    history = spark.read.schema(_STATE).parquet(path)
    return (weights if best is None else best), history.select(
        "round", "train_loss", "val_loss", "val_accuracy", "rate", "best").orderBy("round")


def _step(weights, first, second, found: dict, number: int, rate: float, schedule: Schedule):
    """One Adam step on the clipped mean gradient with weight decay."""
    gradient = found["gradient"] / max(found["weight"], 1e-300) + schedule.decay * weights
    norm = np.linalg.norm(gradient)
    if norm > schedule.clip:
        gradient = gradient * (schedule.clip / norm)
    first = 0.9 * first + 0.1 * gradient
    second = 0.999 * second + 0.001 * gradient ** 2
    mean, spread = first / (1 - 0.9 ** number), second / (1 - 0.999 ** number)
    rate *= min(1.0, number / max(schedule.warm_up, 1))
    return weights - rate * mean / (np.sqrt(spread) + 1e-8), first, second


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return None
    past = spark.read.schema(_STATE).parquet(path)
    return None if past.isEmpty() else past


def as_model(weights: np.ndarray, layers: Sequence[int],
             spark: SparkSession) -> MultilayerPerceptronClassificationModel:
    """The weights as Spark's own perceptron, which scores rows and is stored like any model."""
    jvm = spark._jvm
    kind = jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel
    values = spark.sparkContext._gateway.new_array(jvm.double, len(weights))
    for i, value in enumerate(weights):
        values[i] = float(value)
    java = kind(f"mlpc_{abs(hash(tuple(layers))) % 10 ** 8}",
                jvm.org.apache.spark.ml.linalg.Vectors.dense(values))
    widths = spark.sparkContext._gateway.new_array(jvm.int, len(layers))
    for i, width in enumerate(layers):
        widths[i] = int(width)
    java.set("layers", widths)
    model = MultilayerPerceptronClassificationModel(java)
    model._resetUid(java.uid())
    model._transfer_params_from_java()
    return model
