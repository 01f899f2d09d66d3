"""Saved models and runs predict what they predicted before."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import bayes, bias, factors, neighbours
from starloom.operators.boosting import Booster, Ridge
from starloom.sources import persistence


@pytest.fixture(scope="module")
def train(spark):
    rng = np.random.default_rng(2)
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 12, 120), rng.integers(0, 15, 120))})
    return spark.createDataFrame([(f"r{a}-{b}", f"u{a}", f"i{b}", float(1 + (a * b) % 5)) for a, b in pairs], "review_id string, user string, item string, rating double")


MODELS = {
    "mean": bias.MeanModel,
    "bias": bias.BiasModel,
    "regularized": lambda: bias.RegularizedBiasModel(epochs=2),
    "factors": lambda: factors.BiasedFactorModel(rank=2, iterations=2, seeds=(1, 2)),
    "nonnegative": lambda: factors.NonNegativeModel(rank=2, iterations=2),
    "svd": lambda: factors.BiasSVDModel(rank=2, steps=2),
    "ridge on factors": lambda: factors.FactorRegressor(factors.BiasedFactorModel(rank=2, iterations=2), "ridge"),
    "forest on factors": lambda: factors.FactorRegressor(factors.BiasedFactorModel(rank=2, iterations=2), "forest"),
    "bayes": lambda: bayes.BayesianPMF(rank=2, sweeps=2, burn_in=0, biases=True),
    "variational": lambda: bayes.BayesianNonNegativeMF(rank=2, steps=2),
    "item neighbours": lambda: neighbours.ItemKNN(k=3),
    "baseline neighbours": lambda: neighbours.BaselineKNN(k=3),
}


@pytest.mark.parametrize("name", MODELS)
def test_models_predict_the_same_after_loading(spark, train, tmp_path, name):
    model = MODELS[name]().fit(train)
    asked = train.select("user", "item").union(spark.createDataFrame([("new", "i1"), ("u1", "new"), ("new", "new")], "user string, item string"))
    before = sorted(map(tuple, model.predict(asked).collect()))
    persistence.save(model, str(tmp_path / "m"), spark)
    loaded = persistence.load(spark, str(tmp_path / "m"))
    assert type(loaded) is type(model)
    after = sorted(map(tuple, loaded.predict(asked).collect()))
    assert [r[:2] for r in after] == [r[:2] for r in before] and np.allclose([r[2] for r in after], [r[2] for r in before])


def features(spark, n=300):
    rng = np.random.default_rng(5)
    rows = [(f"r{i}", float(rng.random()), f"c{rng.integers(0, 8)}", f"w{rng.integers(0, 150)}") for i in range(n)]
    return spark.createDataFrame([(*r, float(1 + int(r[2][1]) % 5)) for r in rows], "review_id string, a double, city string, place string, rating double")


def test_boosters_and_ridge(spark, tmp_path):
    df = features(spark)
    booster = Booster(["a"], rounds=4, patience=2, stage=2, categorical=["city", "place"], maxDepth=3).fit(df.where("a < 0.7"), df.where("a >= 0.7"))
    for model in (booster, Ridge(["a"]).fit(df)):
        path = str(tmp_path / type(model).__name__)
        persistence.save(model, path, spark)
        before, after = (sorted(map(tuple, m.score(df, ["review_id"]).collect())) for m in (model, persistence.load(spark, path)))
        assert before == after


def test_router_run(spark, tmp_path):
    from starloom.plans import training
    from starloom.sources import derived

    sf = "/root/testdata/sf0.001"
    tr, te, users, biz = derived.train_reviews(spark, sf), derived.test_reviews(spark, sf), derived.users(spark, sf), derived.businesses(spark, sf)
    run = training.train_router(tr, te, users, biz, rounds=2, n_archetypes=3)
    persistence.save(run, str(tmp_path), spark)
    loaded = persistence.load(spark, str(tmp_path))
    asked = te.drop("stars")
    before, after = (sorted(map(tuple, training.predict_router(r, asked, users, biz).collect())) for r in (run, loaded))
    assert before == after
    whole = training.refit_router(run, tr.unionByName(te), users, biz, n_archetypes=3)
    assert whole.known.best_rounds == run.known.best_rounds and training.predict_router(whole, asked, users, biz).count() == asked.count()


def test_versions_and_unfinished_saves(spark, train, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(FileNotFoundError):
        persistence.load(spark, path)
    assert persistence.save(bias.BiasModel().fit(train), path, spark) == 1
    train.write.parquet(f"{path}/v2/table-0001")  # a save that died before its manifest
    assert persistence.load(spark, path).g == pytest.approx(train.agg(F.avg("rating")).first()[0])
    assert persistence.save(bias.BiasModel().fit(train.where("rating > 2")), path, spark) == 3
    assert persistence.versions(spark, path) == [1, 3]
    assert persistence.load(spark, path).g > persistence.load(spark, path, 1).g
    with pytest.raises(TypeError):
        persistence.save({"x": object()}, path, spark)
