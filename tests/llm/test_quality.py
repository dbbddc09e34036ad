"""The positive-unlabelled risk against numbers and plain numpy."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from sunledger.llm import linear, quality as Q


def planted(n=300, seed=2):
    rng = np.random.default_rng(seed)
    z = np.column_stack([rng.normal(size=(n, 4)), np.ones(n)])
    return z, rng.random(n) < 0.3, rng.normal(size=5)


def measured(z, p, w, risk):
    return risk(Q.Sums(Q.Sums.of(z, p, w), 5))


def test_slopes_and_curvature_equal_differences():
    z, p, w = planted()
    n_p, n_u = p.sum(), len(p)
    for risk in (lambda s: Q.ranking_risk(s, n_p, n_u), lambda s: Q.nnpu_risk(s, n_p, n_u, 0.2),
                 lambda s: Q.nnpu_risk(s, n_p, n_u, 5.0)):  # the last has a clamped negative part
        slope = measured(z, p, w, risk)[1]
        for i in range(5):
            step = np.zeros(5)
            step[i] = 1e-6
            up, down = (measured(z, p, w + s, risk)[0] for s in (step, -step))
            assert abs((up - down) / 2e-6 - slope[i]) < 1e-6
    # the curvature of the ranking risk, and of the unclamped one
    for risk in (lambda s: Q.ranking_risk(s, n_p, n_u), lambda s: Q.nnpu_risk(s, n_p, n_u, 0.2)):
        for i in range(5):
            step = np.zeros(5)
            step[i] = 1e-5
            ends = [measured(z, p, w + s, risk)[1] for s in (step, -step)]
            assert np.abs((ends[0] - ends[1]) / 2e-5 - measured(z, p, w, risk)[2][i]).max() < 1e-6


def test_risk_by_hand():
    z, p, w = planted(50)
    margin = z @ w
    lost = lambda m: np.log1p(np.exp(-m))
    positive, below = 0.2 * lost(margin[p]).mean(), lost(-margin).mean() - 0.2 * lost(-margin[p]).mean()
    value = measured(z, p, w, lambda s: Q.nnpu_risk(s, p.sum(), 50, 0.2))[0]
    assert abs(value - positive - max(0.0, below)) < 1e-12
    over = lost(-margin).mean() - 5 * lost(-margin[p]).mean()
    assert over < 0
    value = measured(z, p, w, lambda s: Q.nnpu_risk(s, p.sum(), 50, 5.0))[0]
    assert abs(value - 5 * lost(margin[p]).mean()) < 1e-12


def test_prior_of_a_planted_mixture():
    rng = np.random.default_rng(6)
    for share in (0.1, 0.4, 0.8):
        p = np.histogram(rng.beta(6, 2, 40_000), 4096, (0, 1))[0]
        u = np.histogram(np.concatenate([rng.beta(6, 2, int(40_000 * share)),
                                         rng.beta(2, 8, int(40_000 * (1 - share)))]), 4096, (0, 1))[0]
        assert abs(Q.class_prior(p, u) - share) < 0.04


def documents(spark, n=3000):
    """Every third text is good; what else varies does not depend on the mark."""
    rng = np.random.default_rng(9)
    words = ["the quiet river runs past old stone houses", "BUY!!! $$$ now >>> click %% win 999"]
    rows = [(i, f"{words[i % 3 > 0]} {'x' * int(rng.integers(7))} {int(rng.integers(10_000))}",
             int(i % 3 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_sums_cover_every_row_on_any_partitioning(spark, monkeypatch):
    docs = documents(spark)
    rows = Q.training_rows(docs.repartition(7), docs.select("doc_id", "quality"), F.lit(True))
    assert rows.count() == 3000 and rows.where("p").count() == 1000
    x = Q.features(docs.toArrow()["text"].combine_chunks()).astype(np.float32).astype(float)
    monkeypatch.setattr(Q, "ADDERS", 2)
    found = Q._added(rows.repartition(5), lambda x, p: np.append(x.sum(axis=0), p.sum()), Q.N_FEATURES + 1)
    assert np.abs(found[:-1] - x.sum(axis=0)).max() < 1e-6 * np.abs(x).sum() and found[-1] == 1000


def test_fit_is_a_minimum_over_all_rows(spark):
    docs = documents(spark)
    # about half of the good texts are marked, whatever they say
    marks = docs.where("crc32(cast(doc_id as string)) % 2 = 0").select("doc_id", "quality")
    rows = Q.training_rows(docs, marks, F.lit(True))
    model = Q.fit(rows)
    assert abs(model.prior - 1 / 3) < 0.08
    x = Q.features(docs.toArrow()["text"].combine_chunks()).astype(np.float32).astype(float)
    p = np.array([r["doc_id"] % 3 == 0 and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
                  for r in docs.select("doc_id").collect()])
    z = np.column_stack([model.scaled(x), np.ones(len(x))])
    w = np.append(model.w, model.b)
    ridge = np.append(np.full(Q.N_FEATURES, linear.RIDGE), 0.0)

    def total(w):
        s = Q.Sums(Q.Sums.of(z, p, w), len(w))
        return Q.nnpu_risk(s, p.sum(), len(p), model.prior)[0] + ridge @ w ** 2 / 2
    rng = np.random.default_rng(0)
    least = total(w)
    assert all(total(w + rng.normal(scale=0.03, size=len(w))) > least - 1e-6 for _ in range(50))
    scores = {r["doc_id"]: r["score"] for r in Q.score(docs, model, ["doc_id"]).collect()}
    assert min(v for k, v in scores.items() if k % 3 == 0) > max(
        v for k, v in scores.items() if k % 3)


def test_no_rows_or_no_positives(spark):
    docs = documents(spark, 12)
    none = docs.select("doc_id", F.lit(0).alias("quality"))
    assert Q.learn(docs, none, F.lit(True)) is None
    assert Q.learn(docs.limit(0), docs.select("doc_id", "quality"), F.lit(True)) is None
    assert Q.learn(docs.withColumn("text", F.lit(None).cast("string")), none, F.lit(True)) is None
