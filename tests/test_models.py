"""Models against brute force on small data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions.special import digamma
from starloom.operators import bayes, bias, factors, neighbours
from starloom.operators.boosting import Booster
from starloom.operators.embeddings import nearest


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(5)
    u, v = rng.normal(size=(30, 2)), rng.normal(size=(20, 2))
    rows = []
    for a in range(30):
        for b in rng.choice(20, 8, replace=False):
            rows.append((f"u{a:02d}", f"i{b:02d}", float(np.clip(np.round(3 + u[a] @ v[b]), 1, 5))))
    return spark.createDataFrame(rows, "user string, item string, rating double").cache()


def matrix(ratings):
    p = ratings.toPandas().pivot(index="user", columns="item", values="rating")
    return p.sort_index().sort_index(axis=1)


def test_digamma(spark):
    x = spark.createDataFrame([(0.05,), (0.5,), (1.0,), (7.3,), (120.0,)], "x double").select(digamma(F.col("x")).alias("d")).collect()
    slope = lambda v, h=1e-5: (math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h)
    assert np.allclose([r["d"] for r in x], [slope(v) for v in (0.05, 0.5, 1.0, 7.3, 120.0)], rtol=1e-5)


def test_bias_svd_is_the_truncated_decomposition(spark, ratings):
    model = factors.BiasSVDModel(rank=3, steps=12).fit(ratings)
    m = matrix(ratings)
    g = np.nanmean(m.to_numpy())
    bu, bi = m.mean(axis=1) - g, m.mean(axis=0) - g
    residual = (m.sub(g).sub(bu, axis=0).sub(bi, axis=1)).fillna(0.0).to_numpy()
    a, s, b = np.linalg.svd(residual, full_matrices=False)
    low = (a[:, :3] * s[:3]) @ b[:3]
    want = np.clip(g + bu.to_numpy()[:, None] + bi.to_numpy()[None, :] + low, 1, 5)
    got = model.predict(ratings).collect()
    rows, cols = list(m.index), list(m.columns)
    assert np.allclose([r["prediction"] for r in got], [want[rows.index(r["user"]), cols.index(r["item"])] for r in got], atol=1e-3)


def test_variational_steps_match_numpy(spark, ratings):
    model = bayes.BayesianNonNegativeMF(rank=3, steps=2)
    r = ratings.withColumn("rating", F.col("rating"))
    users, items = model._start(r, "user", ["gamma"], model.alpha), model._start(r, "item", ["plus", "minus"], model.beta)
    gamma = {x["user"]: np.array(x["gamma"]) for x in users.collect()}
    plus = {x["item"]: np.array(x["plus"]) for x in items.collect()}
    minus = {x["item"]: np.array(x["minus"]) for x in items.collect()}
    eps = 1e-6

    def dg(x):  # central difference of log-gamma
        from math import lgamma

        return np.array([(lgamma(v + eps) - lgamma(v - eps)) / (2 * eps) for v in x])

    for _ in range(2):
        new_g = {k: np.full(3, model.alpha) for k in gamma}
        new_p, new_m = {k: np.full(3, model.beta) for k in plus}, {k: np.full(3, model.beta) for k in plus}
        for x in ratings.collect():
            u, i, y = x["user"], x["item"], x["rating"]
            s = dg(plus[i] + minus[i])
            log = dg(gamma[u]) + y * (dg(plus[i]) - s) + (5 - y) * (dg(minus[i]) - s)
            lam = np.exp(log - log.max())
            lam /= lam.sum()
            new_g[u] += lam
            new_p[i] += lam * y
            new_m[i] += lam * (5 - y)
        gamma, plus, minus = new_g, new_p, new_m
    fitted = model.fit(ratings)
    for x in fitted.users.collect():
        assert np.allclose(x["a"], gamma[x["user"]] / gamma[x["user"]].sum(), atol=1e-5)
    for x in fitted.items.collect():
        assert np.allclose(x["b"], plus[x["item"]] / (plus[x["item"]] + minus[x["item"]]), atol=1e-5)
    assert fitted.trace.count() == 2
    cold = spark.createDataFrame([("new", "new")], "user string, item string")
    assert 0 <= fitted.predict(cold).first()["prediction"] <= 5


def test_gibbs_sampling_learns_and_repeats(spark, ratings):
    fit = lambda: bayes.BayesianPMF(rank=2, sweeps=8, burn_in=4, keep_samples=True).fit(ratings)
    a = fit()
    error = a.predict(ratings).agg(F.avg(F.abs(F.col("rating") - F.col("prediction")))).first()[0]
    base = bias.MeanModel().fit(ratings).predict(ratings).agg(F.avg(F.abs(F.col("rating") - F.col("prediction")))).first()[0]
    assert error < base
    spread = a.predict_with_spread(ratings)
    assert spread.count() == ratings.count() and spread.agg(F.avg("prediction_std")).first()[0] > 0.01
    again = fit().predict(ratings).orderBy("user", "item").collect()
    assert np.allclose([r["prediction"] for r in again], [r["prediction"] for r in a.predict(ratings).orderBy("user", "item").collect()])
    unknown = spark.createDataFrame([("new", "new"), ("u00", "new"), ("new", "i00")], "user string, item string")
    got = {(r["user"], r["item"]): r["prediction"] for r in a.predict(unknown).collect()}
    assert np.isclose(got["new", "new"], a.g) and all(1 <= p <= 5 for p in got.values())


def test_gibbs_half_sweep_statistics(spark):
    """With almost no noise and a flat prior the draw is the least-squares solution."""
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "item string, factors array<double>")
    rows = spark.createDataFrame([("u", "a", 2.0), ("u", "b", -1.0), ("u", "c", 1.0)], "user string, item string, _y double")
    model = bayes.BayesianPMF(rank=2, rating_std=1e-4)
    drawn = model._half_sweep(rows, v, "user", "item", np.zeros(2), np.eye(2) * 1e-6, 3).first()
    assert np.allclose(drawn["factors"], [2.0, -1.0], atol=1e-2)


def test_knn_ranks_items_without_common_raters(spark):
    rows = [("u1", "a", 5.0), ("u1", "b", 5.0), ("u2", "c", 1.0), ("u3", "d", 4.0), ("u3", "a", 1.0)]
    df = spark.createDataFrame(rows, "user string, item string, rating double")
    m = matrix(df).fillna(0.0)
    for metric in ("euclidean", "manhattan"):
        model = neighbours.ItemKNN(2, metric).fit(df)
        got = {}
        for r in model.neighbours.collect():
            got.setdefault(r["a"], []).append((round(r["distance"], 9), r["b"]))
        for item in m.columns:
            order = 2 if metric == "euclidean" else 1
            want = sorted((round(float(np.linalg.norm(m[item] - m[o], order)), 9), o) for o in m.columns if o != item)[:2]
            assert sorted(got[item]) == want


def test_recommend_skips_seen_items(spark, ratings):
    scores = ratings.groupBy("item").agg(F.avg("rating").alias("score"))
    users = spark.createDataFrame([("u00",), ("stranger",)], "user string")
    top = bias.recommend_by_item_score(users, scores, ratings, 5).collect()
    seen = {r["item"] for r in ratings.filter("user = 'u00'").collect()}
    ranked = [r["item"] for r in scores.orderBy(F.col("score").desc(), "item").collect()]
    mine = [r["item"] for r in sorted(top, key=lambda r: r["rank"]) if r["user"] == "u00"]
    assert mine == [i for i in ranked if i not in seen][:5]
    assert [r["item"] for r in sorted(top, key=lambda r: r["rank"]) if r["user"] == "stranger"] == ranked[:5]


def test_factor_fallbacks(spark, ratings):
    model = factors.BiasedFactorModel(rank=2, iterations=2).fit(ratings)
    df = spark.createDataFrame([("new", "new"), ("u00", "new"), ("new", "i00")], "user string, item string")
    got = {(r["user"], r["item"]): r["prediction"] for r in model.predict(df).collect()}
    b = {r["user"]: r["user_bias"] for r in model.users.collect()}
    assert np.isclose(got["new", "new"], model.g)
    assert np.isclose(got["u00", "new"], np.clip(model.g + b["u00"], 1, 5))


def test_unknown_policy_of_baseline_knn(spark, ratings):
    df = spark.createDataFrame([("new", "i00")], "user string, item string")
    for unknown, want in (("global_mean", None), ("2.5", 2.5), ("nan", "null")):
        model = neighbours.BaselineKNN(unknown=unknown).fit(ratings)
        got = model.predict(df).first()["prediction"]
        assert got is None if want == "null" else np.isclose(got, model.baseline.g if want is None else want)


def test_booster_stops_and_refits(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 2))
    df = spark.createDataFrame([(str(i), float(a), float(b), float(1 + 4 * (a > 0.5))) for i, (a, b) in enumerate(x)], "review_id string, a double, b double, rating double")
    model = Booster(["a", "b"], rounds=8, maxDepth=2).fit(df.filter("review_id < '5'"), df.filter("review_id >= '5'"))
    assert 1 <= model.best_rounds <= 8
    model.refit(df)
    assert model.predict(df).agg(F.avg(F.abs(F.col("rating") - F.col("prediction")))).first()[0] < 0.3
    assert model.importance().first()["feature"] == "a"


def test_nearest_in_blocks(spark, monkeypatch):
    from starloom.operators import embeddings

    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(f"v{i:02d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, embedding array<double>")
    monkeypatch.setattr(embeddings, "MAX_QUERY_ROWS", 25)
    got = {(r["anchor"], r["rank"]): r["neighbour"] for r in nearest(df, df, "id", 3).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    np.fill_diagonal(cos, -9)
    for i in range(60):
        assert [got[(f"v{i:02d}", k)] for k in (1, 2, 3)] == [f"v{j:02d}" for j in np.argsort(-cos[i])[:3]]
