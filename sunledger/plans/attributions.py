"""How far each feature moves the probability of a class, row by row.

A forest credits every split on a row's way down with the change of the class share from the
node to its child.  A perceptron credits each input with the gradient of the probability along
the straight way from a baseline to the row.  In both, a row's values add up to its probability
less the base value.  Rows are worked through in Arrow batches where they lie; what is sent to
the executors is the model, as for scoring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    MultilayerPerceptronClassificationModel, RandomForestClassificationModel)
from pyspark.sql import DataFrame, SparkSession, functions as F

from sunledger.plans import networks as N
from sunledger.session import scratch_path

_BLOCK = 512
#: points on one piece of the way from the baseline, and the most pieces it is cut into
POINTS, PIECES = 32, 256
TOLERANCE = 1e-7


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in arrays; a leaf has feature -1, ``shares`` is (nodes, classes)."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    shares: np.ndarray
    roots: np.ndarray

    @property
    def n_classes(self) -> int:
        return self.shares.shape[1]

    def base(self) -> np.ndarray:
        """Every class's mean share at the roots."""
        return self.shares[self.roots].mean(axis=0)

    def _walk(self, x: np.ndarray) -> Iterator[tuple]:
        """Steps ``(rows, nodes, children)`` down all trees, and ``(None, leaves, None)`` of each."""
        for root in self.roots:
            at, live = np.full(len(x), root), np.arange(len(x))
            while True:
                live = live[self.feature[at[live]] >= 0]
                if not len(live):
                    break
                here = at[live]
                goes_left = x[live, self.feature[here]] <= self.threshold[here]
                there = np.where(goes_left, self.left[here], self.right[here])
                yield live, here, there
                at[live] = there
            yield None, at, None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.n_classes))
        for rows, at, _ in self._walk(x):
            if rows is None:
                out += self.shares[at]
        return out / len(self.roots)

    def attribute(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        values = np.zeros(x.shape)
        for rows, here, there in self._walk(x):
            if rows is not None:  # a row takes one step at a time, so no place is added to twice
                of = target[rows]
                values[rows, self.feature[here]] += self.shares[there, of] - self.shares[here, of]
        return values / len(self.roots)


@dataclass(frozen=True)
class Network:
    """A perceptron and the input its attributions start from."""

    weights: np.ndarray
    layers: tuple[int, ...]
    baseline: np.ndarray

    @property
    def n_classes(self) -> int:
        return self.layers[-1]

    def base(self) -> np.ndarray:
        return self.probabilities(self.baseline[None, :])[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return N.probabilities(self.weights, self.layers, x)[-1]

    def attribute(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The way is cut finer for the rows whose values do not add up yet."""
        rows = np.arange(len(x))
        goal = self.probabilities(x)[rows, target] - self.base()[target]
        values, left, pieces = np.zeros(x.shape), rows, 1
        while len(left) and pieces <= PIECES:
            for at in range(0, len(left), max(1, _BLOCK // pieces)):
                some = left[at:at + max(1, _BLOCK // pieces)]
                values[some] = self._along(x[some], target[some], pieces)
            left = left[np.abs(values[left].sum(axis=1) - goal[left]) > TOLERANCE]
            pieces *= 4
        return values

    def _along(self, x: np.ndarray, target: np.ndarray, pieces: int) -> np.ndarray:
        nodes, shares = np.polynomial.legendre.leggauss(POINTS)
        steps = ((nodes + 1) / 2 + np.arange(pieces)[:, None]).ravel() / pieces
        shares = np.tile(shares / (2 * pieces), pieces)
        way = x - self.baseline
        points = (self.baseline + steps[None, :, None] * way[:, None, :]).reshape(-1, x.shape[1])
        slopes = N.input_gradient(self.weights, self.layers, points, np.repeat(target, len(steps)))
        return way * np.einsum("s,nsf->nf", shares, slopes.reshape(len(x), len(steps), -1))


# --- explained models ---------------------------------------------------------------------

def forest_of(model: RandomForestClassificationModel) -> Forest:
    """The trees of a fitted forest, from its stored form.

    As many nodes as the model has reach the driver: a bound set by trees and depth, not by rows.
    """
    spark = SparkSession.active()
    path = scratch_path(spark, "forest")
    model.write().save(path)
    split = F.col("nodeData.split")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"), F.col("nodeData.id").cast("int").alias("id"),
        F.col("nodeData.leftChild").cast("int").alias("left"),
        F.col("nodeData.rightChild").cast("int").alias("right"),
        split["featureIndex"].cast("int").alias("feature"),
        F.element_at(F.when(F.size(split["leftCategoriesOrThreshold"]) > 0,
                            split["leftCategoriesOrThreshold"]), 1).alias("threshold"),
        (split["numCategories"] > -1).alias("by_category"),
        F.col("nodeData.impurityStats").alias("stats")).orderBy("tree", "id").toArrow()
    get = {c: nodes[c].combine_chunks().to_numpy(zero_copy_only=False)
           for c in ("tree", "id", "left", "right", "feature", "threshold", "by_category")}
    inner = get["left"] >= 0
    if (get["by_category"].astype(bool) & inner).any():
        raise ValueError("attributions need numeric splits")
    stats = _matrix(nodes["stats"].combine_chunks(), model.numClasses)
    roots = np.flatnonzero(get["id"] == 0)  # node ids of a tree count up from 0
    offset = roots[np.searchsorted(roots, np.arange(len(inner)), side="right") - 1]
    total = np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)
    return Forest(np.where(inner, get["feature"], -1).astype(np.int32),
                  np.nan_to_num(get["threshold"].astype(float)),
                  np.where(inner, get["left"] + offset, 0).astype(np.int64),
                  np.where(inner, get["right"] + offset, 0).astype(np.int64),
                  stats / total, roots)


def rule_tree(rows: DataFrame, rules: Sequence[tuple], names: Sequence[str], n_classes: int,
              label: str = "label") -> Forest:
    """A tree of given splits whose shares are counted from rows, in one aggregation.

    ``rules`` lists nodes in an order that puts parents first: ``(feature, threshold, left,
    right)`` for a split, ``None`` for a leaf.
    """
    reached = {0: F.lit(True)}
    for i, rule in enumerate(rules):
        if rule is not None:
            name, threshold, left, right = rule
            below = F.col(name).cast("double") <= F.lit(float(threshold))
            reached[left], reached[right] = reached[i] & below, reached[i] & ~below
    counts = rows.agg(*[F.count_if(reached[i] & (F.col(label).cast("int") == k)).alias(f"n{i}_{k}")
                        for i in range(len(rules)) for k in range(n_classes)]).first()
    stats = np.array([[counts[f"n{i}_{k}"] for k in range(n_classes)]
                      for i in range(len(rules))], float)
    parts = [r or (None, 0.0, 0, 0) for r in rules]
    feature = [names.index(p[0]) if p[0] is not None else -1 for p in parts]
    return Forest(np.array(feature, np.int32), np.array([p[1] for p in parts], float),
                  np.array([p[2] for p in parts]), np.array([p[3] for p in parts]),
                  stats / np.maximum(stats.sum(axis=1, keepdims=True), 1.0), np.zeros(1, int))


def explains(model: PipelineModel) -> bool:
    return isinstance(model.stages[-1], (RandomForestClassificationModel,
                                         MultilayerPerceptronClassificationModel))


def explained(model: PipelineModel) -> Forest | Network:
    """What attributions of a stored or fitted pipeline are computed from."""
    last = model.stages[-1]
    if isinstance(last, RandomForestClassificationModel):
        return forest_of(last)
    if isinstance(last, MultilayerPerceptronClassificationModel):
        layers = tuple(last.getLayers())
        return Network(last.weights.toArray(), layers, np.zeros(layers[0]))
    raise ValueError(f"no attributions for {type(last).__name__}")


# --- rows -----------------------------------------------------------------------------------

def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def attributions(rows: DataFrame, names: Sequence[str], explainer: Forest | Network,
                 keep: Sequence[str] = (), of: str | int | None = None) -> DataFrame:
    """``keep`` with ``target``, ``base``, ``probability`` and ``values`` (one per name).

    ``names`` are clean numbers in the model's order.  ``of`` is the class that is explained: a
    column, a number, or None for the class the model predicts.  A row whose class the model does
    not know keeps NULL in the other columns.
    """
    wanted = F.col(of) if isinstance(of, str) else F.lit(-1 if of is None else of)
    table = rows.select(*keep, F.array(*[F.col(n).cast("double") for n in names]).alias("_x"),
                        wanted.cast("int").alias("_of"))
    sent = rows.sparkSession.sparkContext.broadcast(explainer)
    width, predicted = len(names), of is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = sent.value
        base = tool.base()
        for batch in batches:
            for at in range(0, batch.num_rows, 8 * _BLOCK):
                part = batch.slice(at, 8 * _BLOCK)
                x = _matrix(part["_x"], width)
                chance = tool.probabilities(x)
                of = (chance.argmax(axis=1) if predicted else np.array(
                    [-1 if v is None else v for v in part["_of"].to_pylist()], int))
                known = (of >= 0) & (of < tool.n_classes)
                target = np.where(known, of, 0)
                values = tool.attribute(x, target)
                found = chance[np.arange(len(x)), target]
                blocks = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1, dtype=np.int32) * width),
                    pa.array(values.ravel()), mask=pa.array(~known))
                yield pa.RecordBatch.from_arrays(
                    [*[part[c] for c in keep], pa.array(of, pa.int32(), mask=~known),
                     pa.array(base[target], mask=~known), pa.array(found, mask=~known), blocks],
                    names=[*keep, "target", "base", "probability", "values"])

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return table.mapInArrow(
        run, f"{kinds}target int, base double, probability double, values array<double>")


def by_feature(table: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per row and feature: ``keep``, ``feature`` and ``value``."""
    listed = F.array(*[F.lit(n) for n in names])
    return (table.where(F.col("values").isNotNull())
            .select(*keep, F.posexplode("values").alias("_i", "value"))
            .select(*keep, F.get(listed, F.col("_i")).alias("feature"), "value"))
