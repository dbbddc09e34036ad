"""Toxicity by weak supervision.

Voters look at a text: lexicons (a short general one and shards of a lexicon of words that
labelled toxic documents use far more often), how many lexicon words there are, and patterns.
A generative label model estimates, over the votes of all documents, how accurate each voter
is and which voters move together beyond what the label explains; correlated voters share one
weight.  Its posterior labels train a linear classifier on words and votes, over all patterns of
words and votes that occur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from sunledger.llm import linear
from sunledger.llm.common import slices
from sunledger.session import settle

#: fixed values: a short general lexicon of insults
SEED_WORDS = ("bastard", "clown", "disgusting", "idiot", "idiots", "imbecile", "loser", "losers",
              "moron", "morons", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
#: bounds of the fit: labelled documents read for the lexicon (of each class), lexicon words
LEXICON_DOCS, LEXICON_WORDS = 20_000, 256
#: words of more bytes stand in the lexicon by their digest, so that it stays small
LONG_WORD = 48
#: patterns in one task of the classifier's fit, about 100 MB as vectors
TASK_PATTERNS = 20_000
SHARDS = 5
N_VOTERS = SHARDS + 5

_FLAT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32
              for c in range(256))
_SECOND = re.compile(rb" (?:you|they|he|she) (?:are|is) (?:an? |such )*([a-z\x80-\xff]+)")


def words_of(text: str | None) -> bytes:
    """Letters in ASCII lower case; everything else is a blank."""
    return (text or "").encode().translate(_FLAT)


def word_keys(words: set[bytes]) -> set[bytes]:
    """Words as the lexicon names them: one over ``LONG_WORD`` bytes by its digest."""
    long = {w for w in words if len(w) > LONG_WORD}
    return (words - long) | {b"#" + hashlib.md5(w).hexdigest().encode() for w in long}


def evidence(a: Column, b: Column, n_a: float, n_b: float) -> Column:
    """Log-likelihood ratio of a word in a of n_a toxic and b of n_b other documents."""
    def share(k: Column, n: float) -> Column:
        return F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), k / F.lit(n)))

    def part(k: Column, n: float, p: Column) -> Column:
        return k * F.ln(p) + (F.lit(n) - k) * F.ln(1 - p)

    p = share(a + b, n_a + n_b)
    return 2 * (part(a, n_a, share(a, n_a)) + part(b, n_b, share(b, n_b))
                - part(a, n_a, p) - part(b, n_b, p))


def lexicon(docs: DataFrame, labels: DataFrame, train: Column, key: str, text: str,
            label: str) -> list[str]:
    """Words that labelled toxic documents use far more often than other labelled ones.

    Read from at most ``LEXICON_DOCS`` training documents of each class, by hash of the id; all
    their words are tested.
    """
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("_id")).agg(
        F.max(label).alias("_y"))
    bounded = [marks.where((F.col("_y") == y)).join(
        docs.where(train).select(F.col(key).alias("_id")).distinct(), "_id").orderBy(
        F.xxhash64("_id")).limit(LEXICON_DOCS) for y in (0, 1)]
    chosen = bounded[0].union(bounded[1])
    pool = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(
        F.broadcast(chosen), "_id")  # at most 2 * LEXICON_DOCS ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                y, words = [], []
                for t, mark in zip(piece["_text"].to_pylist(), piece["_y"].to_pylist()):
                    own = word_keys(set(words_of(t).split()))
                    words += [w.decode("utf-8", "replace") for w in own] + [""]
                    y += [mark] * (len(own) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array(y, pa.int32())], names=["w", "y"])
    counts = settle(pool.select("_text", F.col("_y").cast("int").alias("_y"))
              .mapInArrow(run, "w string, y int").groupBy("w")
              .agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b")))
    total = counts.where("w = ''").first()
    if total is None or not total["a"] or not total["b"]:
        return []
    n_a, n_b = float(total["a"]), float(total["b"])
    # a word must be several times as frequent in toxic documents; few words pass
    tested = counts.where((F.col("w") != "") & (F.col("a") >= 3))
    n_tested = max(2, tested.count())
    likely = tested.where(F.col("a") / n_a > 4 * F.col("b") / n_b).withColumn(
        "s", evidence(F.col("a").cast("double"), F.col("b").cast("double"), n_a, n_b))
    # about as much evidence as the best of so many words would show by chance
    strong = likely.where(F.col("s") >= 2 * float(np.log(n_tested)))
    return [r["w"] for r in strong.orderBy(F.desc("s"), F.desc("w")).limit(LEXICON_WORDS).collect()]


class Voters:
    """Votes and word features of a text under one lexicon."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.index = {w.encode(): i for i, w in enumerate(words)}
        self.seeds = {w.encode() for w in SEED_WORDS}
        self.n_features = len(words) + N_VOTERS + 2

    def hits(self, text: str | None) -> tuple[list[int], list[int]]:
        """Lexicon words of the text, and the votes: 1 toxic, -1 clean, 0 no opinion."""
        flat = words_of(text)
        present = word_keys(set(flat.split()))
        found = sorted(self.index[w] for w in present & self.index.keys())
        seeds = len(present & self.seeds)
        votes = [0] * N_VOTERS
        for i in found:
            votes[i % SHARDS] = 1
        n = len(found)
        votes[SHARDS] = 1 if seeds else 0
        votes[SHARDS + 1] = 1 if n >= 2 else -1
        votes[SHARDS + 2] = -1 if not n and not seeds else 0
        votes[SHARDS + 3] = 1 if n >= 3 else 0
        named = set(_SECOND.findall(b" " + flat)) if (
            b" are " in flat or b" is " in flat) else set()
        votes[SHARDS + 4] = 1 if word_keys(named) & (self.seeds | self.index.keys()) else 0
        return found, votes

    def vector(self, found: list[int], votes: list[int]) -> np.ndarray:
        x = np.zeros(self.n_features)
        x[found] = 1.0
        x[len(self.words):len(self.words) + N_VOTERS] = votes
        x[-2], x[-1] = len(found), min(len(found), 3)
        return x


class LabelModel:
    """Class prior, vote probabilities given the class, and weights of correlated voters."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, prior: float = 0.1,
                 rounds: int = 60) -> None:
        self.prior = prior
        m = votes.shape[1]
        shown = np.stack([(votes == v) for v in (-1, 0, 1)], axis=2).astype(float)
        # start: a vote is right four times out of five
        self.table = np.empty((2, m, 3))
        self.table[1] = [0.1, 0.5, 0.4]
        self.table[0] = [0.4, 0.55, 0.05]
        self.weight = np.ones(m)
        for step in range(rounds):
            q = self._posterior(shown)
            for y, share in ((0, 1 - q), (1, q)):
                mass = np.einsum("n,nmv->mv", share * counts, shown) + 0.5
                self.table[y] = mass / mass.sum(1, keepdims=True)
            self.prior = float(np.clip((q * counts).sum() / counts.sum(), 1e-4, 0.5))
            if step in (10, 30):
                self.weight = 1.0 / self._correlated(votes, counts, self._posterior(shown)).sum(1)

    def _posterior(self, shown: np.ndarray) -> np.ndarray:
        logs = [np.log(p) + np.einsum("nmv,mv->n", shown, np.log(t) * self.weight[:, None])
                for p, t in ((1 - self.prior, self.table[0]), (self.prior, self.table[1]))]
        return linear.sigmoid(logs[1] - logs[0])

    @staticmethod
    def _correlated(votes: np.ndarray, counts: np.ndarray, q: np.ndarray,
                    limit: float = 0.4) -> np.ndarray:
        """Which pairs of voters move together within the classes (the diagonal holds)."""
        v, total = votes.astype(float), counts.sum()
        cov = np.zeros((v.shape[1], v.shape[1]))
        for share in (q * counts, (1 - q) * counts):
            if share.sum() > 0:
                d = v - (share @ v) / share.sum()
                cov += (d * share[:, None]).T @ d / total
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        together = np.abs(cov / np.outer(spread, spread)) > limit
        np.fill_diagonal(together, True)
        return together

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self._posterior(np.stack([(votes == v) for v in (-1, 0, 1)], axis=2).astype(float))


def vote(docs: DataFrame, voters: Voters, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``found`` (lexicon words) and ``votes`` of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                seen = [voters.hits(t) for t in piece["_text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[piece[c] for c in keep],
                     pa.array([f for f, _ in seen], pa.list_(pa.int16())),
                     pa.array([v for _, v in seen], pa.list_(pa.int8()))],
                    names=[*keep, "found", "votes"])
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(
        run, f"{kinds}found array<smallint>, votes array<tinyint>")


def _vectors(patterns: DataFrame, voters: Voters, model: LabelModel,
             frame: linear.Linear | None = None) -> DataFrame:
    """Features, weight and posterior of every pattern; features as ``frame`` scales them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024).to_pydict()
                x = np.array([voters.vector(f, v) for f, v in zip(rows["found"], rows["votes"])])
                target = model.posterior(np.array(rows["votes"], np.int8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(frame.scaled(x) if frame else x), pa.list_(pa.float64())),
                     pa.array(np.sqrt(np.array(rows["n"], float))), pa.array(target)],
                    names=["x", "share", "target"])
    return patterns.select("votes", "found", "n").mapInArrow(
        run, "x array<double>, share double, target double").select(
        array_to_vector("x").alias("x"), "share", "target")


def fit(patterns: DataFrame, voters: Voters, model: LabelModel) -> linear.Linear:
    """The final classifier over all patterns, each with the square root of its count as weight.

    The loss is that of ``linear.fit``; its gradient is summed up on the executors.
    """
    n = patterns.count()
    spread = patterns.repartition(1 + n // TASK_PATTERNS)
    seen = _vectors(spread, voters, model).agg(
        Summarizer.metrics("mean", "variance").summary(F.col("x")).alias("s")).first()["s"]
    # the population's deviation
    frame = linear.frame(seen["mean"].toArray(), np.sqrt(
        np.maximum(seen["variance"].toArray(), 0.0) * (n - 1) / n))
    # a posterior label is one row of either class, weighted by its probability
    sides = F.explode(F.array(*[
        F.struct(F.lit(y).alias("label"), (F.col("share") * part).alias("weight"))
        for y, part in ((0.0, 1 - F.col("target")), (1.0, F.col("target")))]))
    rows = _vectors(spread, voters, model, frame).select(F.col("x").alias("features"),
                                                         sides.alias("_s"))
    fitted = LogisticRegression(weightCol="weight", regParam=linear.RIDGE, standardization=False,
                                maxIter=200, tol=1e-9).fit(rows.select("features", "_s.*"))
    return linear.Linear(frame.mean, frame.scale, fitted.coefficients.toArray(),
                         float(fitted.intercept))


def learn(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id",
          text: str = "text", label: str = "toxic") -> tuple[Voters, linear.Linear | None]:
    """Lexicon, label model over the votes of all documents, and the final classifier.

    Returns no classifier if no vote is ever cast for toxic.
    """
    voters = Voters(lexicon(docs, labels, train, key, text, label))
    cast = vote(docs, voters, [], text)
    # vote patterns number at most 3 ** N_VOTERS; the distinct rows of features stay distributed
    patterns = cast.groupBy("votes", "found").agg(F.count(F.lit(1)).alias("n"))
    patterns = settle(patterns)
    by_votes = patterns.groupBy("votes").agg(F.sum("n").alias("n")).collect()
    votes = np.array([list(r["votes"]) for r in by_votes], np.int8).reshape(-1, N_VOTERS)
    if not (votes == 1).any():
        return voters, None
    model = LabelModel(votes, np.array([float(r["n"]) for r in by_votes]))
    return voters, fit(patterns, voters, model)


def scorer(voters: Voters, model: linear.Linear | None):
    """Scores of a list of texts; without a classifier every score is 0."""
    def scores(texts: list) -> np.ndarray:
        if model is None or not texts:
            return np.zeros(len(texts))
        return model.scores(np.array([voters.vector(*voters.hits(t)) for t in texts]))
    return scores


def score(docs: DataFrame, voters: Voters, model: linear.Linear | None, keep: list[str],
          text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1) of every row; NULL counts as empty."""
    fn = scorer(voters, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(
                    [*[piece[c] for c in keep], pa.array(fn(piece["_text"].to_pylist()))],
                    names=[*keep, "score"])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, score double")


def drop_toxic(docs: DataFrame, voters: Voters, model: linear.Linear | None, limit: float,
               text: str = "text") -> DataFrame:
    """The rows that score below ``limit``, with all their columns."""
    fn = scorer(voters, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                yield piece.filter(pa.array(fn(piece[text].to_pylist()) < limit))
    return docs.mapInArrow(run, docs.schema)
