"""Gradient descent in strata against a plain loop over the ratings."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import descent, factors


def planted(seed=3, users=40, items=30, n=900):
    rng = np.random.default_rng(seed)
    p, q = rng.normal(size=(users, 2)), rng.normal(size=(items, 2))
    pairs = sorted({(int(u), int(i)) for u, i in zip(rng.integers(0, users, n), rng.integers(0, items, n))})
    return [(f"u{u:02d}", f"i{i:02d}", float(3 + 0.8 * p[u] @ q[i] + 0.3 * (u % 3 - 1))) for u, i in pairs]


def plain_loop(rows, rank, epochs, rate, reg, bias, seed):
    """Rating by rating, in an order drawn anew each epoch."""
    rng = np.random.default_rng(seed)
    users, items = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    p, q = rng.normal(0, 0.1, (len(users), rank)), rng.normal(0, 0.1, (len(items), rank))
    bu, bi = np.zeros(len(users)), np.zeros(len(items))
    mean = np.mean([r[2] for r in rows]) if bias else 0.0
    at = [(users.index(u), items.index(i), r) for u, i, r in rows]
    for _ in range(epochs):
        for k in rng.permutation(len(at)):
            u, i, r = at[k]
            e = r - mean - bu[u] - bi[i] - p[u] @ q[i]
            if bias:
                bu[u] += rate * (e - reg * bu[u])
                bi[i] += rate * (e - reg * bi[i])
            p[u], q[i] = p[u] + rate * (e * q[i] - reg * p[u]), q[i] + rate * (e * p[u] - reg * q[i])
    return np.sqrt(np.mean([(r - mean - bu[u] - bi[i] - p[u] @ q[i]) ** 2 for u, i, r in at]))


def rmse(model, df):
    return model.raw(df, "p").agg(F.sqrt(F.avg((F.col("p") - F.col("rating")) ** 2))).first()[0]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(planted(), "user string, item string, rating double")


def test_batches_have_no_user_or_item_twice():
    rng = np.random.default_rng(1)
    u, i = rng.integers(0, 9, 300), rng.integers(0, 200, 300)
    u[:100] = 0
    batches = descent.deal_into_batches(u, i)
    for b in range(batches.max() + 1):
        mine = batches == b
        assert mine.any() and len(set(u[mine])) == mine.sum() == len(set(i[mine]))
    assert batches.max() + 1 <= np.bincount(u).max() + np.bincount(i).max()


@pytest.mark.parametrize("bias", [True, False])
def test_a_batch_is_one_rating_after_the_other(bias):
    rng = np.random.default_rng(2)
    rows = np.empty(60, descent.RATING)
    rows["user"], rows["item"], rows["rating"] = rng.integers(0, 8, 60), rng.integers(0, 8, 60), rng.uniform(1, 5, 60)
    rows["batch"] = descent.deal_into_batches(rows["user"], rows["item"])
    rows = rows[np.argsort(rows["batch"], kind="stable")]
    p, q = rng.normal(size=(8, 5)).astype(np.float32), rng.normal(size=(8, 5)).astype(np.float32)
    if bias:
        p[:, -1] = q[:, -2] = 1
    a, b = p.astype(float), q.astype(float)
    order = rng.permutation(rows["batch"].max() + 1)
    for batch in order:
        for _, u, i, r in rows[rows["batch"] == batch]:
            e = r - 3.0 - a[u] @ b[i]
            a[u], b[i] = a[u] + 0.05 * (e * b[i] - 0.1 * a[u]), b[i] + 0.05 * (e * a[u] - 0.1 * b[i])
            if bias:
                a[u, -1] = b[i, -2] = 1
    descent.descend(p, q, rows, order, 3.0, 0.05, 0.1, bias)
    assert np.allclose(p, a, atol=1e-4) and np.allclose(q, b, atol=1e-4)


@pytest.mark.parametrize("blocks", [1, 3])
@pytest.mark.parametrize("bias", [True, False])
def test_fits_as_well_as_the_plain_loop(log, blocks, bias):
    options = {"rank": 4, "epochs": 30, "rate": 0.03, "reg": 0.02, "bias": bias}
    fitted = descent.BlockDescent(**options, seeds=(7,), blocks=blocks).fit(log)
    model = factors.BiasedFactorModel(rank=4, use_bias=bias, seeds=(7,))
    model.users, model.items, model.g = fitted.users, fitted.items, fitted.mean
    ours, loop = rmse(model, log), [plain_loop(planted(), **options, seed=s) for s in range(4)]
    assert min(loop) * 0.7 < ours < max(loop) * 1.3


def test_same_vectors_however_the_rows_lie(log):
    def of(df):
        fitted = descent.BlockDescent(3, 2, 0.02, 0.02, seeds=(1, 2), blocks=2).fit(df)
        return {r["user"]: (round(r["user_bias"], 5), [round(x, 5) for x in r["factors"]]) for r in fitted.users.collect()}

    first = of(log.repartition(1))
    assert first == of(log.repartition(7)) and all(len(f) == 6 for _, f in first.values())


def test_seeds_side_by_side_are_their_own_models(log):
    both = factors.BiasedFactorModel(rank=3, iterations=3, seeds=(1, 2)).fit(log).raw(log, "p")
    single = [factors.BiasedFactorModel(rank=3, iterations=3, seeds=(s,)).fit(log).raw(log, f"p{s}").drop("rating") for s in (1, 2)]
    rows = both.join(single[0], ["user", "item"]).join(single[1], ["user", "item"])
    assert rows.where(F.abs(F.col("p") - (F.col("p1") + F.col("p2")) / 2) > 1e-4).isEmpty() and rows.count() == log.count()


def test_a_user_with_a_third_of_all_rows_is_split(spark):
    """Copies of a long user lie in several blocks and end as one vector; the fit is about as good."""
    rng = np.random.default_rng(4)
    rows = planted() + [("hot", f"x{i:03d}", float(2 + i % 3 + rng.normal() / 10)) for i in range(450)] + [(f"u{u:02d}", f"x{i:03d}", float(2 + i % 3)) for u in range(3) for i in range(0, 450, 3)]
    df = spark.createDataFrame(rows, "user string, item string, rating double")
    scores = []
    for limit in ("1000000", "100"):
        spark.conf.set("spark.starloom.rowsPerTask", limit)
        try:
            model = factors.BiasedFactorModel(rank=3, iterations=8, rate=0.03, reg=0.02).fit(df)
        finally:
            spark.conf.unset("spark.starloom.rowsPerTask")
        assert model.users.where("user = 'hot'").count() == 1 and model.users.count() == 41
        scores.append(rmse(model, df))
    assert abs(scores[1] - scores[0]) < 0.15


def test_empty_and_tiny_logs(spark):
    schema = "user string, item string, rating double"
    one = factors.BiasedFactorModel(rank=2, iterations=2).fit(spark.createDataFrame([("a", "b", 4.0), ("a", "b", 2.0)], schema))
    got = one.predict(spark.createDataFrame([("a", "b"), ("a", "z"), ("y", "z")], "user string, item string")).collect()
    assert [round(r["prediction"], 1) for r in sorted(got, key=lambda r: (r["user"], r["item"]))] == [3.0, 3.0, 3.0]
    none = descent.BlockDescent(2, 2, 0.1, 0.1).fit(spark.createDataFrame([], schema))
    assert none.users.count() == 0 and none.items.count() == 0


def test_stored_chunks_are_cut_in_linear_time(spark):
    """Chunks of 4 MB are cut into vectors without a copy of the chunk for each of them, which took minutes here."""
    began = time.monotonic()
    model = descent.BlockDescent(20, 1, 0.01, 0.02)
    size = descent.CHUNK_BYTES // (4 * model.width)
    numbers = np.arange(size * model.width, dtype=np.float32).reshape(size, model.width)
    rows = [(0, 0, kind, 1, chunk, bytearray(numbers.tobytes())) for kind in (descent.USERS, descent.ITEMS) for chunk in range(4)] + [(0, 0, descent.USERS, 0, 0, bytearray())]
    found = model._vectors(spark.createDataFrame(rows, descent.PART).coalesce(1))
    got = found.groupBy("seed", "kind", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("a"), F.max("place").alias("b"), F.countDistinct("place").alias("places")).collect()
    assert sorted(tuple(r) for r in got) == [(0, kind, 1, 4 * size, 0, 4 * size - 1, 4 * size) for kind in (descent.USERS, descent.ITEMS)]
    last = found.where((F.col("kind") == descent.ITEMS) & (F.col("place") == 3 * size + 5)).collect()
    assert [r["payload"] for r in last] == [numbers[5].tobytes()] and time.monotonic() - began < 60


def test_an_epoch_begins_where_the_one_before_ended():
    """All diagonals once an epoch, with one step less for each epoch after the first; one block needs a single step."""
    for blocks, epochs in ((1, 4), (2, 3), (3, 4)):
        steps = descent.diagonals(blocks, epochs)
        assert len(steps) == epochs * (blocks - 1) + 1
        assert sorted((e, d) for d, own in steps for e in own) == [(e, d) for e in range(epochs) for d in range(blocks)]
        assert all(own == sorted(own) for _, own in steps)


def test_a_large_batch_is_descended_on_in_pieces(monkeypatch):
    """Pieces of a batch give the very numbers of the whole batch."""
    rng = np.random.default_rng(8)
    rows = np.empty(3000, descent.RATING)
    rows["user"], rows["item"], rows["rating"] = rng.integers(0, 900, 3000), rng.integers(0, 700, 3000), rng.integers(1, 6, 3000)
    rows["batch"] = descent.deal_into_batches(rows["user"], rows["item"])
    rows = rows[np.argsort(rows["batch"], kind="stable")]
    order, found = np.arange(int(rows["batch"][-1]) + 1), []
    for size in (descent.PIECE_RATINGS, 7, 10**9):
        monkeypatch.setattr(descent, "PIECE_RATINGS", size)
        users, items = (descent.first_vectors(np.arange(n), 1, 6, 0.1) for n in (900, 700))
        descent.descend(users, items, rows, order, 3.0, 0.01, 0.02, True)
        found.append((users, items))
    for users, items in found[1:]:
        assert np.array_equal(users, found[0][0]) and np.array_equal(items, found[0][1])
