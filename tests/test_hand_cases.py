"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from starloom.functions import buckets, numeric, text
from starloom.operators import blending, history, metrics, priors, routing
from starloom.plans import known_user, raw_features
from starloom.plans.pair_features import boosting_features, fit_review_context
from starloom.sources.tables import canonical_reviews

FACETS = "business_stars double, business_city_top string, business_state string, business_primary_category_family string, business_is_open int"


def values(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_bands(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (10,), (21,)], "n int").select("n", buckets.history_band(F.col("n")).alias("b"), buckets.collapsed_band(F.col("n")).alias("c"))
    assert [r["b"] for r in df.orderBy("n").collect()] == ["0", "1", "2-5", "6-20", ">20"]
    assert [r["c"] for r in df.orderBy("n").collect()] == ["0", "1", "2-20", "2-20", ">20"]


def test_scalar_priors(spark):
    t = spark.createDataFrame([("u1", "b1", 4.0), ("u1", "b2", 2.0), ("u2", "b1", 5.0), ("u3", "b3", 3.0)], "user string, item string, rating double")
    g, u, i = priors.scalar_priors(t)
    assert g == 3.5
    found = values(u, "user_key", "user_mean", "user_std", "user_count")
    assert found["u1"][0] == 3.0 and found["u1"][2] == 2 and found["u2"][:2] == (5.0, 0.0)
    assert values(i, "item_key", "item_mean")["b1"] == 4.5


def rows(spark):
    data = [
        ("r1", "u1", "b1", 5.0, "2020-01-01", 4.0, "A", "S", "x", 1), ("r2", "u1", "b2", 1.0, "2020-01-02", 3.0, "A", "S", "x", 1),
        ("r3", "u1", "b3", 4.0, "2020-01-03", 3.5, "B", "S", "y", 0), ("r4", "u2", "b1", 3.0, "2020-01-01", 4.0, "A", "S", "x", 1),
    ]
    df = spark.createDataFrame(data, "review_id string, user string, item string, rating double, d string, " + FACETS)
    return df.withColumn("timestamp", F.to_timestamp("d")).drop("d")


def test_prefix_statistics(spark):
    p = "tabular_history_"
    got = values(history.prefix_statistics(rows(spark), 3.0), "review_id", p + "count", p + "mean", p + "same_city_count", p + "median")
    assert got["r1"] == (0.0, 3.0, 0.0, 3.0)
    assert got["r2"] == (1.0, 5.0, 1.0, 5.0)
    assert got["r3"] == (2.0, 3.0, 0.0, 3.0)
    assert got["r4"][0] == 0.0


def test_context_statistics_ignore_the_target_rating(spark):
    context = rows(spark).filter("review_id in ('r1', 'r2')")
    p = "tabular_history_"
    results = []
    for rating in (1.0, 5.0):
        target = rows(spark).filter("review_id = 'r3'").withColumn("rating", F.lit(rating))
        results.append(values(history.context_statistics(target, context, 3.0), "review_id", p + "count", p + "mean", p + "same_city_count")["r3"])
    assert results == [(2.0, 3.0, 0.0)] * 2


def test_prefix_vectors_see_only_the_past(spark):
    vec = spark.createDataFrame([("b1", [1.0, 0.0]), ("b2", [0.0, 1.0])], "business_id string, embedding array<double>")
    df = known_user.prefix_vector_table(rows(spark), vec, ["1", "2-5"])
    got = values(df, "review_id", "mean_vec", "known_prefix_history_rating_range", "known_prefix_count_is_2", "known_prefix_count_is_3")
    assert got["r2"][0] == [1.0, 0.0] and got["r3"][0] == [0.5, 0.5]
    assert got["r3"][1:] == (4.0, 1.0, 0.0) and "r1" not in got


def test_target_bands():
    assert known_user.target_bands("1, 2-5,nope") == ["1", "2-5"]
    with pytest.raises(ValueError):
        known_user.target_bands("0")


def test_router_branches(spark):
    df = spark.createDataFrame([(False, "0"), (True, "1"), (True, "2-5"), (True, ">20")], "known boolean, band string")
    got = [r["b"] for r in df.select(routing.router_branch(F.col("known"), F.col("band"), ["1", "2-5"]).alias("b")).collect()]
    assert got == ["cold_model", "known_prefix_deep_model", "known_prefix_deep_model", "known_model"]


def test_experts(spark):
    df = spark.createDataFrame([("0",), ("1",), ("2-20",), (">20",)], "b string").select(routing.expert_branch(F.col("b")).alias("e"))
    assert [r["e"] for r in df.collect()] == ["cold_user_tabular", "very_short_history_tabular", "mid_history_tabular", "long_history_tabular"]


def test_raw_features_of_unknown_user_and_item(spark):
    users = spark.createDataFrame([("u1", 3, 4.0)], "user_id string, review_count bigint, average_stars double")
    for c in raw_features.COMPLIMENTS:
        users = users.withColumn(f"compliment_{c}", F.lit(0))
    for c in ("useful", "funny", "cool", "fans"):
        users = users.withColumn(c, F.lit(0))
    users = users.withColumns({"yelping_since": F.lit("2015-01-01"), "elite": F.lit("2016,2017"), "friends": F.lit("None")})
    biz = spark.createDataFrame(
        [("b1", "A", "S", "1", 1.0, 2.0, 4.0, 10, 1, "{'WiFi': 'free', 'P': {'lot': True, 'x': False}}", "Food, Bars", "{'Monday': '9:0-17:0', 'Saturday': '22:0-2:0', 'Sunday': '0:0-0:0'}")],
        "business_id string, city string, state string, postal_code string, latitude double, longitude double, stars double, review_count bigint, is_open bigint, attributes string, categories string, hours string",
    )
    columns = "review_id string, user_id string, business_id string, stars double, useful bigint, funny bigint, cool bigint, date string"
    train = spark.createDataFrame([("r1", "u1", "b1", 4.0, 1, 0, 0, "2020-01-01"), ("r2", "u1", "b1", 2.0, -1, 0, 0, "2020-01-05 19:00:00")], columns)
    spec = raw_features.fit_raw_features(train, users, biz)
    test = spark.createDataFrame([("t1", "u_new", "b_new", 3.0, -1, 0, 0, "2020-02-01"), ("t2", "u1", "b1", 3.0, 3, 0, 0, "bad date")], columns)
    got = values(raw_features.raw_features(test, users, biz, spec), "review_id", "user_known_in_train", "user_train_count", "user_train_mean", "item_is_new", "review_useful_log1p")
    assert got["t1"] == (0.0, 0.0, 3.0, 1.0, 0.0)
    assert got["t2"][:4] == (1.0, 2.0, 3.0, 0.0)
    full = values(raw_features.raw_features(test, users, biz, spec), "review_id", "business_weekly_open_minutes", "business_late_night_days", "business_attributes_count", "business_attribute_true_count", "user_history_is_2", "user_elite_years_count")
    assert full["t2"] == (480.0 + 240.0 + 1440.0, 2.0, 3.0, 1.0, 1.0, 2.0)


def test_literals(spark):
    cases = ["{'a': 'it\\'s', \"b\": \"say 'hi'\", 'c': None, 'd': u'x', 'e': 1.5,}", "not a dict", "", None, "{'n': \"{'k': True}\"}", "{broken"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").select("i", text.flat_attributes(F.col("t")).alias("a"))
    got = {r["i"]: {x["key"]: (x["value"], x["kind"]) for x in r["a"]} for r in df.collect()}
    assert got[0] == {"a": ("it's", "text"), "b": ("say 'hi'", "text"), "c": (None, "none"), "d": ("x", "text"), "e": ("1.5", "number")}
    assert got[1] == got[2] == got[3] == got[5] == {}
    assert got[4] == {"n.k": ("true", "bool")}


def test_hours(spark):
    cases = [("9:00-17:00", 480), ("22:00-2:00", 240), ("0:00-0:00", 1440), ("closed", 0), ("25:00-3:00", 0), ("9:61-10:00", 0)]
    df = spark.createDataFrame(cases, "t string, m int").select("m", text.interval_minutes(F.col("t")).alias("got"))
    assert all(r["m"] == r["got"] for r in df.collect())


def test_new_user_is_masked(spark):
    vec = lambda key: spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], f"{key} string, embedding array<double>")
    c = "review_id string, user string, item string, rating double, s bigint, useful double, funny double, cool double"
    make = lambda data: spark.createDataFrame(data, c).withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    train = make([("r1", "b", "a", 4.0, 0, 1.0, 0.0, 0.0), ("r2", "b", "b", 2.0, 86400, 0.0, 0.0, 0.0)])
    test = make([("t1", "a", "a", 3.0, 90000, 0.0, 0.0, 0.0), ("t2", "b", "a", 3.0, 90000, 0.0, 0.0, 0.0)])
    context = fit_review_context(train)
    f = boosting_features(test, vec("user_id"), vec("business_id"), train, context, 2)
    got = values(f, "review_id", "user_emb_0", "is_new_user", "user_mean_rating", "history_count")
    assert got["t1"] == (0.0, 1.0, 3.0, 0.0) and got["t2"] == (3.0, 0.0, 3.0, 2.0)
    forced = boosting_features(test, vec("user_id"), vec("business_id"), train, context, 2, forced_new=F.lit(True))
    assert values(forced, "review_id", "user_emb_0", "is_new_user")["t2"] == (0.0, 1.0)


def test_rounding_and_nan(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (5.7,), (float("nan"),), (None,)], "x double")
    up = [r["u"] for r in df.limit(4).select(numeric.round_half_up(F.col("x")).alias("u")).collect()]
    even = [r["e"] for r in df.limit(3).select(numeric.round_half_even(F.col("x")).alias("e")).collect()]
    assert up == [1.0, 2.0, 3.0, 5.0] and even == [0.0, 2.0, 2.0]
    scored = df.withColumn("rating", F.lit(1.0))
    assert metrics.overall(scored, "x").first()["n_samples"] == 4
    combined = df.withColumn("y", F.lit(2.0)).select(blending.combine(["x", "y"], "mean", clip_to=None).alias("m")).collect()
    assert [r["m"] for r in combined] == [1.25, 1.75, 2.25, 3.85, 2.0, 2.0]


def test_segments(spark):
    df = spark.createDataFrame([(2,), (3,), (4,), (5,), (6,)], "history_count int").withColumns({"rating": F.lit(3.0), "p": F.lit(2.0)})
    got = values(metrics.short_segments(df, "p"), "segment", "n_samples")
    assert got == {"2": 1, "3": 1, "4": 1, "5": 1, "2-3": 2, "4-5": 2}


def test_canonical_reviews_accepts_both_namings(spark):
    raw = spark.createDataFrame([("r", "u", "b", "4", "2020-01-01"), ("s", "u", "b", "x", "no")], "review_id string, user_id string, business_id string, stars string, date string")
    once = canonical_reviews(raw)
    assert once.columns == ["review_id", "user", "item", "rating", "timestamp"]
    assert canonical_reviews(once).collect() == once.collect()
    bad = once.filter("review_id = 's'").first()
    assert bad["rating"] is None and bad["timestamp"] is None


def test_thresholds_are_applied_in_serving_too(spark):
    df = spark.createDataFrame(
        [("a", "2-5", True, 0.9, 0.5, 5.0, 3.0), ("b", "2-5", True, 0.1, 0.5, 5.0, 3.0), ("c", "1", True, 0.9, 0.5, 5.0, 3.0), ("d", "2-5", False, 0.9, 0.5, None, 3.0)],
        "id string, history_band string, deep_prediction_available boolean, alpha double, correction_hat double, deep_prediction double, incumbent_prediction double",
    )
    got = values(routing.replacement(df, ["2-5"], {"2-5": 0.5}), "id", "final_prediction")
    assert got == {"a": 5.0, "b": 3.0, "c": 3.0, "d": 3.0}


def test_parsers_read_a_value_once(spark):
    """A repeated column expression is evaluated again, so the size of the expression is the work per row."""
    days = text.open_days(F.col("h"))._jc.toString()
    cells = text.flat_attributes(F.col("h"))._jc.toString()
    assert days.count("variant_get") == 1 and days.count("parse_json") == 1
    assert cells.count("schema_of_variant") <= 2 and cells.count("parse_json") == 2
