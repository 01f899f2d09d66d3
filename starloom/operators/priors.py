"""Train-only aggregates per user, item and place, and smoothed group means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import dates
from starloom.session import one_row


def train_scalars(train: DataFrame) -> dict:
    """Global mean and the ends of the train window (microseconds), from canonical reviews."""
    return one_row(
        train.agg(
            F.avg("rating").alias("global_mean"),
            F.unix_micros(F.min("timestamp")).alias("start"),
            F.unix_micros(F.max("timestamp")).alias("end"),
        )
    )


def train_aggregates(train: DataFrame, key: str, key_as: str) -> DataFrame:
    """Count, mean, sample deviation and first and last date of the train reviews of each entity."""
    return train.groupBy(F.col(key).alias(key_as)).agg(
        F.count("rating").alias("train_review_count"),
        F.avg("rating").alias("train_average_stars"),
        F.stddev_samp("rating").alias("train_rating_std"),
        F.min("timestamp").alias("train_first_review_date"),
        F.max("timestamp").alias("train_last_review_date"),
    )


def entity_priors(train: DataFrame, key: str, prefix: str, scalars: dict) -> DataFrame:
    """Count, mean, deviation, bias, span and idle days per entity; one map-side combined shuffle."""
    stats = train.groupBy(F.col(key).alias(f"{prefix}_id")).agg(
        F.count("rating").alias("n"),
        F.avg("rating").alias("mean"),
        F.stddev_samp("rating").alias("std"),
        F.unix_micros(F.min("timestamp")).alias("first"),
        F.unix_micros(F.max("timestamp")).alias("last"),
    )
    day = F.lit(dates.DAY_MICROS)
    p = f"{prefix}_train_"
    return stats.select(
        f"{prefix}_id",
        F.col("n").cast("double").alias(p + "count"),
        F.col("mean").alias(p + "mean"),
        F.coalesce("std", F.lit(0.0)).alias(p + "std"),
        (F.col("mean") - F.lit(scalars["global_mean"])).alias(p + "bias"),
        F.coalesce((F.col("last") - F.col("first")) / day, F.lit(0.0)).alias(p + "span_days"),
        F.greatest(F.coalesce((F.lit(scalars["end"]) - F.col("last")) / day, F.lit(0.0)), F.lit(0.0)).alias(p + "days_since_last_review"),
    )


def place_priors(train: DataFrame, places: DataFrame) -> dict[str, DataFrame]:
    """Counts and means by city, state and postal code, from one pass over the reviews.

    The reviews are first summed per distinct place, so the three tables come from that small result. A
    missing place is a group of its own, for businesses without a row.
    """
    joined = train.join(places, train["item"] == places["business_id"], "left")
    columns = {"city": "business_city", "state": "business_state", "postal": "business_postal_code"}
    from starloom.operators.skew import pin_small

    summed = pin_small(
        joined.groupBy(*columns.values()).agg(F.sum("rating").alias("s"), F.count("rating").alias("n"))
    )
    return {
        name: summed.groupBy(column).agg(
            F.sum("n").cast("double").alias(f"{name}_train_count"), (F.sum("s") / F.sum("n")).alias(f"{name}_train_mean")
        )
        for name, column in columns.items()
    }


def scalar_priors(train: DataFrame) -> tuple[float, DataFrame, DataFrame]:
    """Global mean and mean, deviation and count per user and per item."""

    def of(key, prefix):
        return train.groupBy(F.col(key).alias(f"{prefix}_key")).agg(
            F.avg("rating").alias(f"{prefix}_mean"),
            F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias(f"{prefix}_std"),
            F.count("rating").cast("double").alias(f"{prefix}_count"),
        )

    return one_row(train.agg(F.avg("rating").alias("g")))["g"], of("user", "user"), of("item", "item")


def smoothed_group_stats(df: DataFrame, groups: list[str], prefix: str, overall: float, alpha: float) -> DataFrame:
    """Group means pulled towards ``overall`` with the weight of ``alpha`` rows, and the group size."""
    return df.groupBy(*groups).agg(
        F.count("rating").cast("double").alias(f"{prefix}_support_count"),
        ((F.sum("rating") + F.lit(alpha * overall)) / (F.count("rating") + F.lit(alpha))).alias(f"{prefix}_mean"),
    )


def history_counts(context: DataFrame, user: str = "user") -> DataFrame:
    return context.groupBy(F.col(user).alias("_history_user")).agg(F.count(F.lit(1)).alias("history_count"))


def attach_history(df: DataFrame, context: DataFrame, user: str = "user") -> DataFrame:
    """History count and band of each row's user in ``context``; users without reviews have band 0."""
    from starloom.functions.buckets import history_band

    counts = history_counts(context, user)
    joined = df.join(counts, df[user] == counts["_history_user"], "left").drop("_history_user")
    n = F.coalesce("history_count", F.lit(0))
    return joined.withColumns({"history_count": n, "history_band": history_band(n)})


def average_duplicates(df: DataFrame, rounded: bool = False) -> DataFrame:
    """One row per user and item; repeated ratings are averaged (and rounded half even)."""
    mean = F.avg("rating")
    return df.groupBy("user", "item").agg((F.rint(mean) if rounded else mean).alias("rating"))
