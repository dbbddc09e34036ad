"""Quality scores by positive-unlabelled learning with a non-negative risk.

Trusted positives (rows marked 1) and unlabelled web text train a linear classifier that
minimises ``pi R_p(+) + max(0, R_u(-) - pi R_p(-))``.  Marks of 0 are never used: such rows
count as unlabelled.  The class prior ``pi`` is the smallest ratio of unlabelled to positive
mass above any score of a first classifier.  Every training row takes part in both fits and in
the prior: features are written once, and each job adds up losses, slopes and curvature over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sunledger.llm import linear
from sunledger.llm.common import slices, string_bytes, word_bounds, word_hashes
from sunledger.session import settle

#: tasks whose sums the driver adds up itself; the sums of more are added up on executors first
ADDERS = 64
#: Newton steps at most, and the fall of the risk that ends them
ROUNDS, TOLERANCE = 25, 1e-7
#: bins of a first classifier's scores, from which the class prior is read
BINS = 4096
#: how far from zero the negative part of the risk is rounded off
EDGE = 1e-3
_BLOCK = 2048
_ASCII = 128
N_FEATURES = _ASCII + 10


def features(column: pa.Array) -> np.ndarray:
    """Character shares and shape statistics of every text; NULL and empty texts have zeros."""
    data, offsets = string_bytes(column)
    n, lengths = len(column), np.diff(offsets).astype(np.float64)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    plain = np.minimum(data, _ASCII)
    counts = np.bincount(rows * (_ASCII + 1) + plain, minlength=n * (_ASCII + 1)).reshape(
        n, _ASCII + 1).astype(np.float64)
    size = np.maximum(lengths, 1.0)[:, None]
    out = np.zeros((n, N_FEATURES))
    out[:, :_ASCII] = np.sqrt(counts[:, :_ASCII] / size)
    hashes, owner = word_hashes(data, offsets)
    starts, ends = word_bounds(data, offsets)
    words = np.bincount(owner, minlength=n).astype(np.float64)
    some = np.maximum(words, 1.0)
    mean_length = np.bincount(owner, ends - starts, n) / some
    upper = (data[starts] >= 65) & (data[starts] <= 90)
    order = np.lexsort((hashes, owner))
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    repeated = np.bincount(owner[order], same, n)
    caps = counts[:, 65:91].sum(1)
    marks = counts[:, 33:48].sum(1) + counts[:, 58:65].sum(1) + counts[:, 91:97].sum(1) \
        + counts[:, 123:127].sum(1)
    tail = np.column_stack([
        np.log1p(lengths), np.log1p(words), mean_length / 8.0, repeated / some,
        np.bincount(owner, upper, n) / some, caps / size[:, 0], marks / size[:, 0],
        marks / some, counts[:, 10] / some, counts[:, _ASCII] / size[:, 0]])
    out[:, _ASCII:] = np.where(words[:, None] > 0, tail, 0.0)
    return out


# --- the training rows ----------------------------------------------------------------------

def training_rows(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id",
                  text: str = "text", label: str = "quality") -> DataFrame:
    """``(f, p)``: the features of every text where ``train`` holds, and whether it is a positive.

    Every row is unlabelled text; a trusted positive is a positive besides.  NULL texts are left
    out.  Features are joined with the marks, texts do not travel.
    """
    marked = labels.where(F.col(label) == 1).select(F.col(key).alias("_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                rows = features(piece["_text"]).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [piece["_key"], pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["_key", "f"])
    pool = docs.where(train).where(F.col(text).isNotNull()).select(
        F.col(key).alias("_key"), F.col(text).alias("_text"))
    seen = pool.mapInArrow(run, f"_key {docs.schema[key].dataType.simpleString()}, f binary")
    return settle(seen.join(marked, F.col("_key") == F.col("_id"), "left").select(
        "f", F.col("_id").isNotNull().alias("p")))


def _matrix(column: pa.Array) -> np.ndarray:
    width = 4 * N_FEATURES
    data = column.buffers()[2]
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    if data is None or not len(column):
        return np.zeros((0, N_FEATURES))
    rows = np.frombuffer(data, np.uint8)[first:first + len(column) * width]
    return rows.view(np.float32).reshape(-1, N_FEATURES).astype(np.float64)


def _added(rows: DataFrame, measure, size: int) -> np.ndarray:
    """The sum over all rows of ``measure(x, p)``, a vector; tasks add up, then a few adders."""
    def total(vectors: Iterator[np.ndarray]) -> pa.RecordBatch:
        out = np.zeros(size)
        for vector in vectors:
            out += vector
        return pa.RecordBatch.from_arrays([pa.array([out], pa.list_(pa.float64()))], names=["v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield total(measure(_matrix(part["f"]), np.asarray(part["p"].to_numpy(zero_copy_only=False),
                                                           bool))
                    for batch in batches for part in (batch.slice(at, _BLOCK) for at in range(
                        0, batch.num_rows, _BLOCK)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield total(np.asarray(v.values) for batch in batches for v in batch["v"])

    parts = rows.mapInArrow(run, "v array<double>")
    if rows.rdd.getNumPartitions() > ADDERS:
        parts = parts.repartition(ADDERS).mapInArrow(add, "v array<double>")
    return np.sum([r["v"] for r in parts.collect()], axis=0)  # at most ADDERS rows


# --- risk ---------------------------------------------------------------------------------

class Sums:
    """What a risk and its derivatives are made of, summed over rows at the weights ``w``.

    ``p_up``, ``p_down`` and ``u_down`` are logistic losses of positives taken for positive,
    positives taken for negative and unlabelled rows taken for negative; ``p_curve`` and
    ``u_curve`` the second derivatives of the last two.
    """

    def __init__(self, vector: np.ndarray, width: int) -> None:
        self.p_up, self.p_down, self.u_down = vector[:3]
        self.p_lean, self.p_sum, self.u_lean = vector[3:3 + 3 * width].reshape(3, width)
        self.p_curve, self.u_curve = vector[3 + 3 * width:].reshape(2, width, width)

    @staticmethod
    def of(z: np.ndarray, p: np.ndarray, w: np.ndarray) -> np.ndarray:
        """``z`` ends in a column of ones."""
        margin = z @ w
        up, down = linear.sigmoid(margin), np.logaddexp(0.0, margin)
        bent = z * np.sqrt(up * (1 - up))[:, None]
        return np.concatenate([
            [(down - margin)[p].sum(), down[p].sum(), down.sum()],
            up[p] @ z[p], z[p].sum(axis=0), up @ z,
            (bent[p].T @ bent[p]).ravel(), (bent.T @ bent).ravel()])


def ranking_risk(s: Sums, n_p: float, n_u: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Even weights for positives and unlabelled rows: a classifier that only ranks."""
    return ((s.p_up / n_p + s.u_down / n_u) / 2,
            ((s.p_lean - s.p_sum) / n_p + s.u_lean / n_u) / 2,
            (s.p_curve / n_p + s.u_curve / n_u) / 2)


def nnpu_risk(s: Sums, n_p: float, n_u: float,
              prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk with its first and second derivatives.

    The negative part ``x`` counts as ``EDGE log(1 + exp(x / EDGE))``: itself above zero, nothing
    below, and smooth in between, so that the fit can move along the edge.
    """
    x = s.u_down / n_u - prior * s.p_down / n_p
    slope = s.u_lean / n_u - prior * s.p_lean / n_p
    open_ = linear.sigmoid(x / EDGE)
    value = prior * s.p_up / n_p + EDGE * np.logaddexp(0.0, x / EDGE)
    curve = open_ * s.u_curve / n_u + (1 - open_) * prior * s.p_curve / n_p \
        + open_ * (1 - open_) / EDGE * np.outer(slope, slope)
    return value, prior * (s.p_lean - s.p_sum) / n_p + open_ * slope, curve


def _minimise(rows: DataFrame, frame: linear.Linear, risk, start: np.ndarray) -> np.ndarray:
    """Newton steps, halved until the risk falls; one job a try."""
    width = N_FEATURES + 1
    ridge = np.append(np.full(N_FEATURES, linear.RIDGE), 0.0)

    def at(w: np.ndarray):
        def measure(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            z = np.column_stack([frame.scaled(x), np.ones(len(x))])
            return Sums.of(z, p, w)
        found = _added(rows, measure, 3 + 3 * width + 2 * width * width)
        value, slope, curve = risk(Sums(found, width))
        return value + ridge @ w ** 2 / 2, slope + ridge * w, curve + np.diag(ridge + 1e-9)

    w, (value, slope, curve) = start, at(start)
    for _ in range(ROUNDS):
        step = np.linalg.solve(curve, slope)
        if step @ slope < TOLERANCE:
            break
        for length in 0.5 ** np.arange(8):
            found = at(w - length * step)
            if found[0] < value:
                break
        else:
            break
        w, (value, slope, curve) = w - length * step, found
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Ratio of unlabelled to positive mass above the threshold that bounds it best.

    Both are counts by score, in bins of rising scores; thresholds lie at the deciles (and ten
    times finer) of the positives.
    """
    n_p, n_u = positive.sum(), unlabelled.sum()
    noise = np.sqrt(0.7 / n_p) + np.sqrt(0.7 / n_u)
    above_p = np.cumsum(positive[::-1])[::-1] / n_p
    above_u = np.cumsum(unlabelled[::-1])[::-1] / n_u
    best, bound = 1.0, np.inf
    for level in np.linspace(0.0, 0.9, 91):
        # the last bin from which at least this share of the positives follows
        t = np.flatnonzero(above_p >= 1 - level - 1e-12)[-1]
        # the threshold is chosen by an upper bound, the ratio there is the estimate
        if (above_u[t] + noise) / above_p[t] < bound:
            best, bound = above_u[t] / above_p[t], (above_u[t] + noise) / above_p[t]
    return float(np.clip(best, 0.05, 0.98))


def fit(rows: DataFrame) -> linear.Linear | None:
    """The classifier of all training rows; None without positives or without rows."""
    def moments(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.concatenate([[p.sum(), len(p)], x.sum(axis=0), (x ** 2).sum(axis=0)])
    found = _added(rows, moments, 2 + 2 * N_FEATURES)
    n_p, n_u = found[:2]
    if not n_p or not n_u:
        return None
    mean = found[2:2 + N_FEATURES] / n_u
    spread = np.sqrt(np.maximum(found[2 + N_FEATURES:] / n_u - mean ** 2, 0.0))
    frame = linear.frame(mean, np.where(spread > 1e-6, spread, 0.0))
    first = _minimise(rows, frame, lambda s: ranking_risk(s, n_p, n_u),
                      np.zeros(N_FEATURES + 1))
    ranker = linear.Linear(frame.mean, frame.scale, first[:-1], float(first[-1]))

    def histogram(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        place = np.minimum((ranker.scores(x) * BINS).astype(int), BINS - 1)
        return np.concatenate([np.bincount(place[p], minlength=BINS),
                               np.bincount(place, minlength=BINS)]).astype(float)
    counts = _added(rows, histogram, 2 * BINS)
    prior = class_prior(counts[:BINS], counts[BINS:])
    start = np.zeros(N_FEATURES + 1)
    start[-1] = np.log(prior / (1 - prior))
    w = _minimise(rows, frame, lambda s: nnpu_risk(s, n_p, n_u, prior), start)
    model = linear.Linear(frame.mean, frame.scale, w[:-1], float(w[-1]))
    model.prior = prior
    return model


def learn(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id",
          text: str = "text", label: str = "quality") -> linear.Linear | None:
    """Train on trusted positives and unlabelled text, all the rows where ``train`` holds.

    Returns None if there are no positives or no unlabelled rows.
    """
    return fit(training_rows(docs, labels, train, key, text, label))


def score(docs: DataFrame, model: linear.Linear | None, keep: list[str],
          text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1) of every row.

    Without a model every score is 0.5.  NULL counts as the empty text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                s = np.full(piece.num_rows, 0.5) if model is None else model.scores(
                    features(piece["_text"]))
                yield pa.RecordBatch.from_arrays([*[piece[c] for c in keep], pa.array(s)],
                                                 names=[*keep, "score"])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, score double")
