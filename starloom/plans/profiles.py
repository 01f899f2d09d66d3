"""User profiles as weighted means of the vectors of rated businesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.dates import DAY_MICROS


ID_ROWS = 1_000_000  # ids that are sent to all executors at most


def with_known_items(interactions: DataFrame, items: DataFrame) -> DataFrame:
    """The rows whose item has a vector in ``items`` (business_id, embedding); only its ids are joined."""
    from starloom.operators.skew import maybe_broadcast

    ids = items.where("embedding is not null").select(F.col("business_id").alias("_known")).distinct()
    return interactions.join(maybe_broadcast(ids, ID_ROWS), interactions["item"] == F.col("_known"), "left_semi")


def interaction_weights(interactions: DataFrame, mode: str, half_life_days: float = 365.0, rows: DataFrame | None = None) -> DataFrame:
    """Each review with its weight in the user's profile; modes mean, rating, centered and recency.

    Per-user statistics come from an aggregate that is joined back, so a long history is not one task's work. With ``rows``, a part of
    ``interactions``, these alone are weighed, by the statistics of all.
    """
    rows = interactions if rows is None else rows
    if mode == "mean":
        return rows.withColumn("weight", F.lit(1.0))
    if mode == "rating":
        return rows.withColumn("weight", F.col("rating"))
    stats = interactions.groupBy(F.col("user").alias("_u")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("rating").alias("_mean"), F.max("timestamp").alias("_last"),
        F.min("rating").alias("_low"), F.max("rating").alias("_high"),
    )
    joined = rows.join(stats, rows["user"] == stats["_u"])
    if mode == "recency":
        age = (F.unix_micros("_last") - F.unix_micros("timestamp")) / F.lit(DAY_MICROS)
        weight = F.exp(-F.greatest(F.coalesce(age, F.lit(0.0)), F.lit(0.0)) / F.lit(half_life_days))
    elif mode == "centered":
        # a single review, or ratings that are all equal, would weigh nothing: they count as 1
        flat = (F.col("_n") <= 1) | (F.col("_low") == F.col("_high"))
        weight = F.when(flat, 1.0).otherwise(F.col("rating") - F.col("_mean"))
    else:
        raise ValueError(f"unknown mode {mode}")
    return joined.withColumn("weight", weight).drop("_u", "_n", "_mean", "_last", "_low", "_high")


def target_users(*frames: DataFrame) -> DataFrame:
    """Every user id that occurs in any of the tables."""
    out = frames[0].select("user_id")
    for f in frames[1:]:
        out = out.unionByName(f.select("user_id"))
    return out.filter(F.col("user_id").isNotNull()).distinct()


def expand_to_targets(targets: DataFrame, table: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per target id; ids that the table lacks get zeros."""
    return targets.join(table.select(key, *columns), key, "left").fillna(0, columns)


def profile_vectors(interactions: DataFrame, features: DataFrame, mode: str, half_life_days: float = 365.0) -> DataFrame:
    """Weighted mean of the rated items' sparse features per user: ``user, feature_index, value``.

    ``features`` is long: business_id, feature_index, value. Reviews of items without features do not count.
    Weights are first summed per user and item, so the join with the features sees each pair once. The
    divisor is the sum of weights, of absolute weights when they are centered, or 1 when that is zero.
    """
    items = features.select("business_id").distinct()
    known = interactions.join(items, interactions["item"] == items["business_id"], "left_semi")
    pairs = interaction_weights(known, mode, half_life_days).groupBy("user", "item").agg(F.sum("weight").alias("w"))
    total = F.sum(F.abs("w")) if mode == "centered" else F.sum("w")
    divisors = pairs.groupBy(F.col("user").alias("_u")).agg(total.alias("_d"))
    summed = pairs.join(features, pairs["item"] == features["business_id"]).groupBy("user", "feature_index").agg(F.sum(F.col("w") * F.col("value")).alias("s"))
    joined = summed.join(divisors, summed["user"] == divisors["_u"])
    value = F.col("s") / F.when(F.col("_d") == 0, F.lit(1.0)).otherwise(F.col("_d"))
    return joined.select("user", "feature_index", value.alias("value")).filter(F.col("value") != 0)


def dense_profiles(interactions: DataFrame, embeddings: DataFrame, width: int, mode: str = "mean") -> DataFrame:
    """The same mean over dense item vectors: ``user_id, embedding``."""
    from starloom.functions import vectors

    embeddings = embeddings.where("embedding is not null")
    weighted = interaction_weights(interactions, mode, rows=with_known_items(interactions, embeddings))
    joined = weighted.join(embeddings, weighted["item"] == embeddings["business_id"])
    w = F.abs("weight") if mode == "centered" else F.col("weight")
    sums = joined.groupBy(F.col("user").alias("user_id")).agg(
        vectors.sum_vectors(F.col("embedding"), width, F.col("weight")).alias("s"), F.sum(w).alias("d")
    )
    d = F.when(F.col("d") == 0, 1.0).otherwise(F.col("d"))
    return sums.select("user_id", vectors.scale(F.col("s"), 1 / d).alias("embedding"))


def user_metadata_block(targets: DataFrame, users: DataFrame, train: DataFrame) -> DataFrame:
    """Safe user metadata: log counts, tenure and elite years as scores fitted on train users only."""
    from starloom.functions import numeric, text
    from starloom.operators.skew import quantiles
    from starloom.session import one_row
    from starloom.sources.derived import COMPLIMENTS

    counts = ["useful", "funny", "cool", "fans"] + [f"compliment_{c}" for c in COMPLIMENTS]
    one = users.dropDuplicates(["user_id"]).select("user_id", "yelping_since", "elite", *counts)
    seen = train.select(F.col("user").alias("user_id")).distinct().withColumn("_fit", F.lit(True))
    end = one_row(train.agg(F.unix_micros(F.max("timestamp")).alias("end")))["end"]
    rows = targets.join(one, "user_id", "left").join(seen, "user_id", "left")
    raw = (F.lit(end) - F.unix_micros("yelping_since")) / F.lit(DAY_MICROS)
    rows = rows.withColumns({"_fit": F.coalesce("_fit", F.lit(False)), "metadata__tenure_days": raw})
    fill = one_row(quantiles(rows.filter("_fit"), [], "metadata__tenure_days", {"m": 0.5}))["m"]
    if fill is None:
        fill = one_row(quantiles(rows, [], "metadata__tenure_days", {"m": 0.5}))["m"] or 0.0
    elite = text.elite_years(F.col("elite")).cast("double")
    rows = rows.withColumns(
        {
            "metadata__tenure_days": F.coalesce("metadata__tenure_days", F.lit(fill)), "metadata__elite_years_count": elite,
            "metadata__elite_any": (elite > 0).cast("double"), **{f"metadata__{c}_log1p": F.log1p(numeric.number_or(c)) for c in counts},
        }
    )
    scored = ["metadata__tenure_days", "metadata__elite_years_count"] + [f"metadata__{c}_log1p" for c in counts]
    fitted = numeric.fit_scores(rows, scored, fit_on=F.col("_fit"))
    return rows.select(
        "user_id", "metadata__tenure_days", "metadata__elite_years_count", "metadata__elite_any", *[numeric.score(c, fitted).alias(f"{c}_z") for c in scored]
    )


def clean_user_table(targets: DataFrame, interactions: DataFrame, metadata: DataFrame) -> DataFrame:
    """History size, band, mean rating and metadata per target user."""
    from starloom.functions.buckets import history_band

    stats = interactions.groupBy(F.col("user").alias("user_id")).agg(F.count(F.lit(1)).alias("history_count"), F.avg("rating").alias("user_mean_rating"))
    rows = expand_to_targets(targets, stats, "user_id", ["history_count", "user_mean_rating"])
    return rows.withColumn("history_band", history_band(F.col("history_count"))).join(metadata, "user_id", "left")


def profile_summary(clean: DataFrame) -> DataFrame:
    """Users per band and percentiles of the history counts, in one row."""
    from starloom.functions.buckets import BANDS
    from starloom.operators.skew import quantiles
    from starloom.session import one_row

    n = lambda b: F.sum((F.col("history_band") == b).cast("bigint"))
    names = ["band_0", "band_1", "band_2_5", "band_6_20", "band_over_20"]
    row = one_row(clean.agg(F.count(F.lit(1)).alias("n_users"), F.avg("history_count").alias("mean_history"), *[n(b).alias(c) for b, c in zip(BANDS, names)]))
    row.update(one_row(quantiles(clean, [], "history_count", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, few_values=True)))
    return clean.sparkSession.createDataFrame([row])


def embedding_source(clean: DataFrame, users: DataFrame) -> DataFrame:
    """Where a user's vector comes from: history, metadata_only or default_only."""
    known = users.select("user_id").distinct().withColumn("_m", F.lit(True))
    source = F.when(F.col("history_count") > 0, "history").when(F.col("_m"), "metadata_only").otherwise("default_only")
    return clean.join(known, "user_id", "left").withColumn("embedding_source", source).drop("_m")
