"""Comparisons of stated metadata with what the reviews show, and leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import text
from starloom.operators.skew import quantiles
from starloom.session import one_row


def compare_with_train(metadata: DataFrame, aggregates: DataFrame, key: str, stated_mean: str) -> DataFrame:
    """Per entity: stated count and mean against the train aggregates."""
    joined = metadata.select(key, "review_count", F.col(stated_mean).alias("stated_mean")).join(aggregates, key, "left")
    n = F.coalesce("train_review_count", F.lit(0))
    return joined.select(
        key, "review_count", "stated_mean", "train_review_count", "train_average_stars",
        F.col("train_review_count").isNotNull().alias("seen_in_train"),
        (F.col("review_count") - n).alias("count_difference"),
        F.abs(F.col("review_count") - n).alias("abs_count_difference"),
        (F.col("review_count") == n).alias("exact_count_match"),
        (F.col("stated_mean") - F.col("train_average_stars")).alias("mean_difference"),
        F.abs(F.col("stated_mean") - F.col("train_average_stars")).alias("abs_mean_difference"),
    )


def summarize_comparison(compared: DataFrame) -> DataFrame:
    """One row: sizes over all entities, the rest over those seen in train."""
    seen = compared.filter("seen_in_train")
    over = lambda c: F.when(F.col("seen_in_train"), F.col(c))
    row = one_row(
        compared.agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.sum(F.col("seen_in_train").cast("int")).alias("rows_seen_in_train"),
            F.sum((~F.col("seen_in_train")).cast("int")).alias("rows_unseen_in_train"),
            F.avg(over("exact_count_match").cast("int")).alias("exact_count_match_rate"),
            F.avg(over("abs_count_difference")).alias("mean_abs_count_difference"),
            F.avg(over("abs_mean_difference")).alias("mean_abs_mean_difference"),
        )
    )
    row["median_abs_count_difference"] = one_row(quantiles(seen, [], "abs_count_difference", {"m": 0.5}))["m"]
    row["median_abs_mean_difference"] = one_row(quantiles(seen, [], "abs_mean_difference", {"m": 0.5}))["m"]
    return compared.sparkSession.createDataFrame([row])


def leakage_check(train: DataFrame, outside: DataFrame, users: DataFrame) -> DataFrame:
    """For users without train reviews: how well the stated mean foretells their ratings, against the global mean."""
    g = one_row(train.agg(F.avg("rating").alias("g")))["g"]
    cold = outside.join(train.select("user").distinct(), "user", "left_anti")
    profile = users.select(F.col("user_id").alias("user"), "average_stars", "review_count")
    joined = cold.join(profile, "user")
    per_user = cold.groupBy("user").agg(F.count(F.lit(1)).alias("n_outside"), F.avg("rating").alias("outside_mean"))
    extra = per_user.join(profile, "user").agg(
        F.count(F.lit(1)).alias("n_cold_users"),
        F.avg((F.col("review_count") > F.col("n_outside")).cast("int")).alias("share_with_other_reviews"),
        F.avg((F.abs(F.col("average_stars") - F.col("outside_mean")) < 0.01).cast("int")).alias("share_equal_means"),
    )
    base = joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.corr("average_stars", "rating").alias("correlation"),
        F.avg(F.abs(F.col("average_stars") - F.col("rating"))).alias("profile_mae"),
        F.avg(F.abs(F.lit(g) - F.col("rating"))).alias("global_mae"),
    )
    return train.sparkSession.createDataFrame([{**one_row(base), **one_row(extra)}])


def attribute_key_counts(businesses: DataFrame) -> DataFrame:
    flat = businesses.select(F.explode(text.flat_attributes(F.col("attributes"))).alias("a"))
    return flat.groupBy(F.col("a.key").alias("attribute_key")).agg(F.count(F.lit(1)).alias("count"))


def parser_summary(businesses: DataFrame) -> DataFrame:
    """Presence rates and parser coverage of the business table, in one row."""
    b = businesses.withColumn("_open", text.open_days(F.col("hours"))).select(
        "city", "state", F.size(text.tokens(F.col("categories"))).alias("n_categories"),
        F.size(text.flat_attributes(F.col("attributes"))).alias("n_attributes"),
        F.col("hours").isNotNull().alias("has_hours"),
        *[c.alias(n) for n, c in text.opening_hours("_open").items()],
    )
    keys = attribute_key_counts(businesses).agg(F.count(F.lit(1)).alias("n_attribute_keys"))
    row = b.agg(
        F.count(F.lit(1)).alias("n_businesses"), F.avg((F.col("n_categories") > 0).cast("int")).alias("categories_rate"),
        F.avg((F.col("n_attributes") > 0).cast("int")).alias("attributes_rate"), F.avg(F.col("has_hours").cast("int")).alias("hours_rate"),
        F.countDistinct("state").alias("n_states"), F.countDistinct("city").alias("n_cities"),
        F.avg("open_days_count").alias("mean_open_days"), F.avg("weekly_open_minutes").alias("mean_weekly_minutes"),
        F.avg("n_categories").alias("mean_categories"),
    )
    return businesses.sparkSession.createDataFrame([{**one_row(row), **one_row(keys)}])


def user_audit(users: DataFrame, train: DataFrame) -> DataFrame:
    from starloom.operators.priors import train_aggregates

    return compare_with_train(users, train_aggregates(train, "user", "user_id"), "user_id", "average_stars")


def business_audit(businesses: DataFrame, train: DataFrame) -> DataFrame:
    from starloom.operators.priors import train_aggregates

    return compare_with_train(businesses, train_aggregates(train, "item", "business_id"), "business_id", "stars")
