"""Data past the sizes at which rows used to be dropped, refused or treated differently."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import boosting, embeddings, graph, history, skew, splits
from starloom.plans import stackers, training


def many_ratings(spark, n=400):
    rng = np.random.default_rng(3)
    rows = [(f"u{i % 3}", f"i{i % 7}", float(rng.random() * 4 + 1), i * 3600, f"r{i:04d}") for i in range(n)]
    df = spark.createDataFrame(rows, "user string, item string, rating double, s bigint, review_id string").withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    facets = {"business_stars": F.lit(3.0), "business_city_top": F.col("item"), "business_state": F.lit("s"), "business_primary_category_family": F.lit("c"), "business_is_open": F.lit(1)}
    return df.withColumns(facets)


def test_medians_of_many_distinct_ratings(spark):
    df = many_ratings(spark)
    rows = df.orderBy("timestamp").toPandas()
    got = {r["review_id"]: r["m"] for r in history.prefix_statistics(df, 3.0).select("review_id", F.col("tabular_history_median").alias("m")).collect()}
    for user, part in rows.groupby("user"):
        seen = []
        for r in part.itertuples():
            assert got[r.review_id] == pytest.approx(np.median(seen) if seen else 3.0)
            seen.append(r.rating)
    target = df.filter("rating < 1.3")
    context = df.filter("rating >= 1.3")
    medians = context.toPandas().groupby("user")["rating"].median()
    for r in history.context_statistics(target, context, 3.0).collect():
        assert r["tabular_history_median"] == pytest.approx(medians[r["user"]])


def test_many_ratings_of_divided_histories(spark, tiny_tasks):
    df = many_ratings(spark)
    columns = ["review_id", "tabular_history_median", "tabular_history_mean", "tabular_history_same_city_count"]
    divided = sorted(map(tuple, history.prefix_statistics(df, 3.0).select(*columns).collect()))
    spark.conf.set("spark.starloom.rowsPerTask", "1000000")
    whole = sorted(map(tuple, history.prefix_statistics(df, 3.0).select(*columns).collect()))
    assert [r[0] for r in divided] == [r[0] for r in whole]
    assert np.allclose([r[1:] for r in divided], [r[1:] for r in whole])


def test_more_than_a_thousand_centroids(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CENTROID_BLOCK", 500)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1200, 3))
    df = spark.createDataFrame([(f"c{i}", [float(x) for x in v]) for i, v in enumerate(vectors)], "category string, embedding array<double>")
    got = embeddings.centroid_similarity(df, "category")
    assert got.count() == 1200 * 1200 and got.select("first").distinct().count() == 1200
    few = embeddings.centroid_similarity(df, "category", ["c1", "c2"]).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    assert sorted((r["first"], r["second"], round(r["cosine"], 9)) for r in few) == sorted((f"c{i}", f"c{j}", round(float(unit[i] @ unit[j]), 9)) for i in (1, 2) for j in (1, 2))


def test_ridge_keeps_rows_with_missing_features(spark):
    rows = [(i, float(i % 7), None if i == 3 else float(i % 5), float(i % 7) * 0.3 + 1.5) for i in range(50)] + [(50, float("nan"), 1.0, 2.0)]
    df = spark.createDataFrame(rows, "review_id int, a double, b double, rating double")
    scored = boosting.Ridge(["a", "b"]).fit(df).score(df, ["review_id"])
    assert scored.count() == 51 and scored.filter(F.col("prediction").isNull()).count() == 0


def test_weights_of_short_histories(spark):
    bands = ["0", "1", "2-5", "6-20", ">20"]
    df = spark.createDataFrame([(b,) for b in bands], "b string").select("b", boosting.band_weight(F.col("b")).alias("w"))
    assert {r["b"]: r["w"] for r in df.collect()} == {"0": 1.0, "1": 1.5, "2-5": 1.2, "6-20": 1.0, ">20": 1.0}


def test_features_of_experts():
    columns = ["stars", "prefix_user_mean", "prefix_same_city_mean"]
    assert training.expert_features(columns, "0") == ["stars"]
    assert training.expert_features(columns, "1") == ["stars", "prefix_user_mean"]
    assert training.expert_features(columns, "2-20") == training.expert_features(columns, ">20") == columns


def test_features_of_stackers():
    assert stackers.STACK_FEATURES["v1"] == ["cf_prediction", "cb_prediction_raw", "history_band_enc", "history_count", "history_rating_std", "cf_cb_diff"]
    assert len(stackers.STACK_FEATURES["v2"]) == 9 and "cf_prediction" not in stackers.STACK_FEATURES["v3"]
    assert "business_bayesian_prior" in stackers.STACK_FEATURES["v6_known"] and len(stackers.STACK_FEATURES["v6_cold"]) == 7


def test_every_edge_with_a_free_stranger_is_matched(spark):
    """The anchor befriends all but one of a stratum; the one left is found however late its number comes."""
    others = [f"u{i:03d}" for i in range(120)]
    edges = spark.createDataFrame([("anchor", o) for o in others[:-1]] + [("x", "y")], "user_id string, friend_id string")
    strata = spark.createDataFrame([(o, "s") for o in others] + [("anchor", "t"), ("y", "alone"), ("x", "t")], "user_id string, stratum string")
    got = graph.matched_strangers(edges, strata).collect()
    assert len(got) == 119 and {r["matched_non_friend"] for r in got} == {others[-1]}


def test_samples_have_fine_steps(spark):
    keys = spark.range(20000)
    numbers = keys.select(splits.hash_number(F.col("id"), 42).alias("h"))
    row = numbers.agg(F.countDistinct("h").alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).first()
    assert row["n"] == 20000 and 0 <= row["a"] and row["b"] < 1 << 60
    assert 0.18 < splits.sample_fraction(keys, F.col("id"), 0.2).count() / 20000 < 0.22


def test_many_long_keys_are_all_divided(spark, tiny_tasks):
    df = spark.range(200 * 60).select((F.col("id") % 200).alias("k"), "id", F.lit(1).alias("one"))
    rest, stored = skew.divide_long_groups(df, ["k"], ["id"])
    assert rest.isEmpty() and stored.groupBy("k").agg(F.countDistinct("_chunk").alias("c")).count() == 200
    run = skew.before_each_row(df, ["k"], ["id"], {"n": ("sum", "one")}).select("id", F.coalesce("n", F.lit(0)).alias("n"))
    assert run.filter(F.col("n") != F.floor(F.col("id") / 200)).isEmpty()


def test_chained_windows_read_the_input_once_each(spark, tiny_tasks):
    """Stored pieces keep the plan from doubling with every divided window."""
    df = many_ratings(spark).withColumn("one", F.lit(1))
    scans = []
    for _ in range(3):
        df = skew.before_each_row(df, ["user"], ["timestamp", "review_id"], {f"n{len(scans)}": ("sum", "one")})
        scans.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
    assert scans[2] - scans[1] <= scans[1] - scans[0] + 1


def test_factor_queries_fit_whole_models(monkeypatch):
    """Ranks and iterations of the registered factor models are those of the reference."""
    from starloom.catalog import models, registry

    made = {}

    def seen(model, name):
        made[name] = (model.rank, model.iterations)
        raise StopIteration

    names = ["md_biased_factors", "md_factors_without_bias", "md_factors_seed_ensemble", "md_factor_explanation", "md_nonnegative_factors", "md_factor_regressor", "md_factor_ridge"]
    monkeypatch.setattr(models, "train", lambda spark, sf: None)
    for name in names:
        for kind in (models.factors.BiasedFactorModel, models.factors.NonNegativeModel):
            monkeypatch.setattr(kind, "fit", lambda self, *_, name=name: seen(self, name))
        monkeypatch.setattr(models.factors.FactorRegressor, "fit", lambda self, *_, name=name: seen(self.base, name))
        with pytest.raises(StopIteration):
            registry.QUERIES[name](None, None)
    assert made == dict.fromkeys(names[:3], (150, 30)) | {"md_factor_explanation": (20, 20), "md_nonnegative_factors": (15, 50), "md_factor_regressor": (20, 20), "md_factor_ridge": (20, 20)}
