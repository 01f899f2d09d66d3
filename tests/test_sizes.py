"""Work and memory that must not grow faster than the input."""

import tracemalloc

import numpy as np
import pandas as pd

from starloom.operators import embeddings


def test_a_block_of_neighbours_holds_a_small_matrix_and_equals_a_full_sort():
    rng = np.random.default_rng(5)
    items, queries = np.round(rng.normal(size=(9_000, 3)), 1), np.round(rng.normal(size=(1_100, 3)), 1)  # many ties
    items[17], queries[4] = np.nan, np.nan
    frame = lambda name, x: pd.DataFrame({"id": [f"{name}{n:05d}" for n in range(len(x))], "u": list(x)})
    tracemalloc.start()
    got = embeddings._nearest_in_block(4)(None, frame("q", queries), frame("i", items).sample(frac=1, random_state=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    cos = queries @ items.T
    top = np.argsort(-np.round(cos, 12), axis=1, kind="stable")[:, :5]
    assert got["neighbour"].tolist() == [f"i{n:05d}" for n in top.ravel()]
    assert np.allclose(got["cosine"], np.take_along_axis(cos, top, axis=1).ravel(), equal_nan=True)
    assert peak < 60 << 20  # a matrix of 1,000 queries and all items alone has 72 MB


def test_pair_features_leave_the_vectors_behind(spark):
    from starloom.plans import pair_features
    from starloom.plans.profiles import dense_profiles

    items = spark.createDataFrame([("i1", [3.0, 4.0]), ("i2", [1.0, 0.0]), ("i3", None)], "business_id string, embedding array<double>")
    log = [("r1", "a", "i1", 5.0), ("r2", "a", "i2", 3.0), ("r3", "a", "i9", 1.0), ("r4", "b", "i9", 2.0), ("r5", "c", "i3", 4.0), ("r6", None, "i1", 4.0)]
    reviews = spark.createDataFrame(log, "review_id string, user string, item string, rating double").selectExpr("*", "timestamp_seconds(0) as timestamp")
    users = dense_profiles(reviews, items, 2, "centered").where("user_id is not null")
    assert {r["user_id"]: [round(x, 6) for x in r["embedding"]] for r in users.collect()} == {"a": [3.0, 4.0]}  # weights 2 and 0 by the mean of all three
    rows = pair_features.pair_feature_rows(pair_features.rows_with_both_vectors(reviews, users, items, reviews))
    assert not {"user_vector", "item_vector"} & set(rows.columns)
    assert {(r["review_id"], round(r["dot"], 6), round(r["cosine"], 6), r["history_count"]) for r in rows.collect()} == {("r1", 25.0, 1.0, 3), ("r2", 3.0, 0.6, 3)}


def test_a_replaced_result_leaves_the_disk(spark):
    import os

    from starloom.session import Stored

    first = Stored(spark.range(9))
    second = first.replaced_by(first.rows.selectExpr("id + 1 as id"))
    assert not os.path.exists(first.folder.removeprefix("file:")) and os.path.exists(second.folder.removeprefix("file:"))
    assert sorted(r["id"] for r in second.rows.collect()) == list(range(1, 10))
    second.delete()


def test_fits_leave_no_state_of_their_steps(spark, tmp_path, monkeypatch):
    import itertools

    from starloom import session
    from starloom.operators import factors
    from starloom.operators.descent import BlockDescent

    rows = [(f"u{n % 7}", f"i{n % 5}", float(1 + n % 4)) for n in range(35)]
    log = spark.createDataFrame(rows, "user string, item string, rating double")
    number = itertools.count()
    monkeypatch.setattr(session, "shared_folder", lambda _, name: f"{tmp_path}/{name}-{next(number)}")
    fitted = BlockDescent(2, 3, 0.02, 0.02, blocks=2).fit(log)
    svd = factors.BiasSVDModel(rank=2, steps=3, extra=1).fit(log)
    assert next(number) > 4 and not list(tmp_path.iterdir())
    assert fitted.users.count() == 7 and svd.raw(log, "p").count() == 35
