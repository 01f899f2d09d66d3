"""Operators give the same rows whether or not a long group is divided."""

import numpy as np
from pyspark.sql import functions as F

from starloom.operators import history, neighbours, profile, skew, splits

COLUMNS = "user string, item string, rating double, timestamp timestamp, review_id string"


def reviews(spark, n=900, seed=1):
    """One user holds half of all rows, many of them with the same timestamp."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.5 else f"u{rng.integers(40)}"
        rows.append((user, f"i{rng.integers(25)}", float(rng.integers(1, 6)), int(rng.integers(60)) * 86400, f"r{i:05d}"))
    df = spark.createDataFrame(rows, "user string, item string, rating double, s bigint, review_id string")
    return df.select("user", "item", "rating", F.timestamp_seconds("s").alias("timestamp"), "review_id")


def as_set(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in df.collect())


def test_long_groups_are_divided(spark, tiny_tasks):
    df = reviews(spark)
    divided = skew.divide_long_groups(df, ["user"], ["timestamp", "review_id"])
    rest, stored = divided
    assert rest.count() + stored.count() == df.count() and rest.filter("user = 'hot'").isEmpty()
    assert stored.groupBy("user", "_chunk").count().agg(F.max("count")).first()[0] < 200
    hot = stored.filter("user = 'hot'").select("_chunk", "timestamp", "review_id").collect()
    ordered = sorted(hot, key=lambda r: (r["timestamp"], r["review_id"]))
    assert [r["_chunk"] for r in ordered] == sorted(r["_chunk"] for r in hot)


def test_running_sums_match_plain_window(spark, tiny_tasks):
    df = reviews(spark).withColumn("one", F.lit(1))
    aggs = {"n": ("sum", "one"), "s": ("sum", "rating"), "low": ("min", "rating"), "high": ("max", "rating")}
    order = ["timestamp", "review_id"]
    assert as_set(skew.before_each_row(df, ["user"], order, aggs)) == as_set(skew.before_each_row(df, ["user"], order, aggs, check=False))
    whole = skew.before_each_row(df, [], order, {"n": ("sum", "one")}).select(F.coalesce("n", F.lit(0)).alias("n"))
    assert sorted(r["n"] for r in whole.collect()) == list(range(900))


def test_last_rows_match_plain_window(spark, tiny_tasks):
    df = reviews(spark)
    event = F.struct("item", "rating", "review_id")
    order = ["timestamp", "item", "review_id"]
    for n in (3, 20, 70):
        assert as_set(skew.last_rows_before(df, ["user"], order, event, n, "e")) == as_set(skew.last_rows_before(df, ["user"], order, event, n, "e", check=False))


def test_prefix_statistics_match(spark, tiny_tasks):
    df = reviews(spark).withColumns(
        {"business_stars": F.lit(3.0), "business_city_top": F.col("item"), "business_state": F.lit("s"), "business_primary_category_family": F.lit("c"), "business_is_open": F.lit(1)}
    )
    divided = as_set(history.prefix_statistics(df, 3.0))
    spark.conf.set("spark.starloom.rowsPerTask", "1000000")
    assert divided == as_set(history.prefix_statistics(df, 3.0))


def test_quantiles_match(spark, tiny_tasks):
    df = reviews(spark).withColumn("v", F.rand(3) * 100).select("user", "v").cache()
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r["user"]: r for r in skew.quantiles(df, ["user"], "v", probs).collect()}
    whole = skew.quantiles(df, [], "v", probs).first()
    pdf = df.toPandas()
    for name, p in probs.items():
        assert np.isclose(whole[name], np.quantile(pdf["v"], p))
        for user, part in pdf.groupby("user"):
            assert np.isclose(got[user][name], np.quantile(part["v"], p))


def test_profile_and_split_do_not_depend_on_division(spark, tiny_tasks):
    df = reviews(spark)
    counts = profile.entity_counts(df, "user")
    a = profile.entity_profile(counts).first()
    n = np.sort([r["n"] for r in counts.collect()])
    k = len(n)
    assert np.isclose(a["gini_interaction_concentration"], ((2 * np.arange(1, k + 1) - k - 1) * n).sum() / (k * n.sum()))
    assert np.isclose(a["head_10pct_interaction_share"], n[::-1][: int(np.ceil(k * 0.1))].sum() / n.sum())
    train, validation = splits.temporal_split(df)
    assert train.count() == 720 and validation.count() == 180
    assert train.agg(F.max(F.struct("timestamp", "review_id"))).first()[0] < validation.agg(F.min(F.struct("timestamp", "review_id"))).first()[0]


def test_tiles_equal_self_join(spark):
    df = reviews(spark, 600).groupBy("user", "item").agg(F.avg("rating").alias("x"))
    plain = neighbours.common_sums(df, "user", "item", "x", ordinary=10_000)
    old = neighbours.TILE_MEMBERS, neighbours.TILE_GROUPS
    try:
        for members, groups in ((1000, 256), (6, 3)):
            neighbours.TILE_MEMBERS, neighbours.TILE_GROUPS = members, groups
            for ordinary in (0, 8):
                assert as_set(neighbours.common_sums(df, "user", "item", "x", ordinary)) == as_set(plain)
    finally:
        neighbours.TILE_MEMBERS, neighbours.TILE_GROUPS = old
