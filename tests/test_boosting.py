"""Stages, early stopping, refits and text columns of the boosters."""

import pathlib

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from starloom.operators import boosting
from starloom.operators.boosting import Booster
from starloom.session import shared_folder


def noisy(spark, n=500, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    y = np.clip(3 + 2 * np.sin(6 * x[:, 0]) * x[:, 1] + rng.normal(0, 0.8, n), 1, 5)
    return spark.createDataFrame([(f"r{i:03d}", *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "review_id string, a double, b double, c double, rating double")


def test_best_round_is_that_of_a_plain_loop(spark):
    df = noisy(spark)
    train, held = df.where("review_id < 'r300'"), df.where("review_id >= 'r300'")
    names, rounds = ["a", "b", "c"], 12
    assembled = VectorAssembler(inputCols=names, outputCol="f")
    errors = []
    for m in range(1, rounds + 1):
        model = GBTRegressor(featuresCol="f", labelCol="rating", predictionCol="p", lossType="absolute", maxIter=m, seed=42, maxDepth=3, maxBins=62).fit(assembled.transform(train))
        errors.append(model.transform(assembled.transform(held)).agg(F.avg(F.abs(F.col("p") - F.col("rating")))).first()[0])
    booster = Booster(names, rounds=rounds, patience=rounds, stage=rounds, maxDepth=3).fit(train, held)
    assert np.allclose(booster.errors, errors) and booster.best_rounds == int(np.argmin(errors)) + 1
    got = booster._scored(held).agg(F.avg(F.abs(F.col("_total") - F.col("rating")))).first()[0]
    assert np.isclose(got, min(errors))


def test_stops_after_rounds_without_gain_and_refits_as_many(spark):
    df = noisy(spark, 300, 3)
    train, held = df.where("review_id < 'r150'"), df.where("review_id >= 'r150'")
    booster = Booster(["a", "b", "c"], rounds=40, patience=4, stage=4, maxDepth=4).fit(train, held)
    best = int(np.argmin(booster.errors)) + 1
    assert booster.best_rounds == best and len(booster.errors) < 40 and len(booster.errors) - best >= 4
    assert all(len(booster.errors[:i]) - (int(np.argmin(booster.errors[:i])) + 1) < 4 for i in range(4, len(booster.errors), 4))
    assert sum(m.getNumTrees for m in booster.models) == best
    assert sum(m.getNumTrees for m in booster.refit(df).models) == best
    assert np.isclose(booster.importance().agg(F.sum("importance")).first()[0], 1.0)


def test_only_a_text_column_explains_the_rating(spark, monkeypatch):
    rng = np.random.default_rng(7)
    for levels in (12, 200):  # as sets of levels, and as damped means
        of = rng.integers(1, 6, levels)
        rows = [(f"r{i}", float(rng.random()), f"c{k}" if k else None, float(of[k])) for i, k in enumerate(rng.integers(0, levels, 4000))]
        df = spark.createDataFrame(rows, "review_id string, a double, city string, rating double")
        train, held = df.where("a < 0.8"), df.where("a >= 0.8")
        booster = Booster(["a"], rounds=10, categorical=["city"], maxDepth=5).fit(train, held)
        assert booster.importance().first()["feature"] == "city"
        error = booster.predict(held).agg(F.avg(F.abs(F.col("prediction") - F.col("rating")))).first()[0]
        plain = Booster(["a"], rounds=3, maxDepth=4).fit(train, held).predict(held).agg(F.avg(F.abs(F.col("prediction") - F.col("rating")))).first()[0]
        assert error < 0.45 < plain
        new = spark.createDataFrame([("x", 0.5, "never seen"), ("y", 0.5, None)], "review_id string, a double, city string")
        assert all(1 <= r["prediction"] <= 5 for r in booster.predict(new).collect())


def test_no_row_sees_its_own_label(spark):
    """Every level once: the fit's rows get the overall mean, whatever their label."""
    rows = [(f"r{i}", f"c{i}", float(1 + i % 5)) for i in range(boosting.MAX_LEVELS * 2)]
    df = spark.createDataFrame(rows, "review_id string, city string, rating double")
    categories = boosting.Categories(["city"], "rating").fit(df, ["review_id"])
    assert {round(r["_cat_city"], 6) for r in categories.apply(df, fitting=True).collect()} == {3.0}
    assert len({round(r["_cat_city"], 6) for r in categories.apply(df).collect()}) == 5


def stored_bytes(spark):
    return sum(p.stat().st_size for p in pathlib.Path(shared_folder(spark, "x").removeprefix("file:")).parent.rglob("*") if p.is_file())


def test_a_fit_leaves_nothing_on_disk(spark):
    df = noisy(spark, 400, 5)
    train, held = df.where("review_id < 'r200'"), df.where("review_id >= 'r200'")
    before = stored_bytes(spark)
    booster = Booster(["a", "b", "c"], rounds=6, patience=6, stage=2, maxDepth=2).fit(train, held)
    booster.refit(df)
    assert len(booster.errors) == 6 and stored_bytes(spark) == before


def test_stored_predictions_change_no_round(spark, monkeypatch):
    df = noisy(spark, 400, 6)
    train, held = df.where("review_id < 'r200'"), df.where("review_id >= 'r200'")
    fits = []
    for stages in (1, 100):
        monkeypatch.setattr(boosting, "STAGES_READ", stages)
        fits.append(Booster(["a", "b", "c"], rounds=9, patience=9, stage=2, maxDepth=3).fit(train, held))
    assert np.allclose(fits[0].errors, fits[1].errors) and fits[0].best_rounds == fits[1].best_rounds
    totals = [[r[0] for r in b._scored(held).orderBy("review_id").select("_total").collect()] for b in fits]
    assert np.allclose(*totals)
