"""Vocabularies and encoded feature blocks in long form: ``business_id, feature_name, value``."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import numeric, text
from starloom.operators.skew import maybe_broadcast, quantiles
from starloom.session import one_row

BLOCKS = ["geo", "categories", "attributes", "hours", "priors"]


def one_hot(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.select("business_id", F.concat_ws("_", F.lit(prefix), column).alias("feature_name"), F.lit(1.0).alias("value"))


def kept_values(df: DataFrame, column: str, at_least: int) -> DataFrame:
    """Values that occur often enough, with their counts."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)


def city_buckets(df: DataFrame, at_least: int) -> DataFrame:
    """Cities below the minimum frequency become ``__other__``."""
    kept = maybe_broadcast(kept_values(df, "city_clean", at_least).select(F.col("city_clean").alias("_city")))
    joined = df.join(kept, df["city_clean"] == F.col("_city"), "left")
    return joined.withColumn("city_bucket", F.coalesce("_city", F.lit("__other__"))).drop("_city")


def hashed_city(df: DataFrame, width: int) -> DataFrame:
    """Cities hashed to a fixed number of columns (Spark's hash, so columns differ from other hashers)."""
    hashed = FeatureHasher(inputCols=["city_bucket"], outputCol="_h", numFeatures=width).transform(df)
    cells = hashed.select("business_id", F.posexplode(vector_to_array("_h")).alias("i", "value")).filter("value <> 0")
    return cells.select("business_id", F.format_string("geo__city_hash__%03d", "i").alias("feature_name"), "value")


def scores(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Standard scores of numeric columns under new names, zeros left out."""
    fitted = numeric.fit_scores(df, list(columns))
    cells = F.array(*[F.struct(F.lit(name).alias("feature_name"), numeric.score(c, fitted).alias("value")) for c, name in columns.items()])
    return df.select("business_id", F.inline(cells)).filter("value <> 0")


def plain_cells(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(name).alias("feature_name"), F.col(c).cast("double").alias("value")) for c, name in columns.items()])
    return df.select("business_id", F.inline(cells)).filter("value <> 0")


def geo_clusters(df: DataFrame, k: int, seed: int = 42) -> DataFrame:
    points = VectorAssembler(inputCols=["latitude_filled", "longitude_filled"], outputCol="features").transform(df)
    model = KMeans(k=k, seed=seed).fit(points)
    return model.transform(points).select("business_id", F.format_string("geo__cluster_%d", "prediction").alias("feature_name"), F.lit(1.0).alias("value"))


def prepare(businesses: DataFrame, priors: DataFrame) -> DataFrame:
    """Business rows with cleaned places, filled coordinates, parsed lists and train priors."""
    joined = businesses.join(priors, "business_id", "left").withColumn("_open", text.open_days(F.col("hours")))
    mid = {c: one_row(quantiles(businesses, [], c, {"m": 0.5}))["m"] or 0.0 for c in ("latitude", "longitude")}
    top = one_row(priors.agg(F.max("train_review_count").alias("m")))["m"] or 0
    n = F.coalesce(F.col("train_review_count").cast("double"), F.lit(0.0))
    return joined.withColumns(
        {
            "state_clean": text.text_or(F.col("state"), "__unknown__"), "city_clean": text.text_or(F.col("city"), "__unknown__"),
            **{f"{c}_filled": F.coalesce(c, F.lit(float(v))) for c, v in mid.items()}, "is_open_clean": numeric.number_or("is_open"),
            "tokens": F.array_distinct(text.tokens(F.col("categories"))), "flat": text.flat_attributes(F.col("attributes")), **text.opening_hours("_open"),
            "prior_seen_in_train": F.col("train_review_count").isNotNull().cast("double"), "prior_log1p": F.log1p(n),
            "prior_support": n / F.lit(float(top)) if top else F.lit(0.0), "prior_mean": F.coalesce("train_average_stars", F.lit(0.0)),
            "prior_std": F.coalesce("train_rating_std", F.lit(0.0)),
        }
    ).drop("_open")


def category_cells(prepared: DataFrame, at_least: int) -> DataFrame:
    """Multi-hot categories that occur in at least ``at_least`` businesses."""
    tokens = prepared.select("business_id", F.explode("tokens").alias("token"))
    kept = maybe_broadcast(kept_values(tokens, "token", at_least).select("token"))
    return tokens.join(kept, "token", "left_semi").select("business_id", F.concat(F.lit("category__"), text.slug(F.col("token"))).alias("feature_name"), F.lit(1.0).alias("value"))


def attribute_cells(prepared: DataFrame, at_least: int, most_values: int) -> DataFrame:
    """Multi-hot ``key=value``: keys with too many values are left out, rare values become ``key=other``."""
    flat = prepared.select("business_id", F.explode("flat").alias("a"))
    pairs = flat.select("business_id", F.col("a.key").alias("key"), text.attribute_text(F.col("a.value"), F.col("a.kind")).alias("v")).distinct()
    counts = pairs.groupBy("key", "v").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy(F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("_values")).filter(F.col("_values") <= most_values)
    known = counts.join(keys, counts["key"] == keys["_key"]).select(F.col("key").alias("_k"), F.col("v").alias("_v"), F.when(F.col("n") >= at_least, F.col("v")).otherwise("other").alias("shown"))
    known = maybe_broadcast(known)
    tokens = pairs.join(known, (pairs["key"] == F.col("_k")) & (pairs["v"] == F.col("_v"))).select("business_id", F.concat_ws("=", "key", "shown").alias("token")).distinct()
    return tokens.select("business_id", F.concat(F.lit("attribute__"), text.slug(F.col("token"))).alias("feature_name"), F.lit(1.0).alias("value"))


HOURS = {c: f"hours__{c}_z" for c in ("open_days_count", "weekly_open_minutes", "weekend_days_open", "late_night_days")}
PRIORS = {
    "prior_seen_in_train": "prior__seen_in_train", "prior_log1p": "prior__train_review_count_log1p", "prior_support": "prior__train_support_percentile",
    "prior_mean": "prior__train_average_stars", "prior_std": "prior__train_rating_std",
}


def block_cells(prepared: DataFrame, min_city=20, max_city_columns=200, city_width=64, min_category=20, min_attribute=20, max_values=12, clusters=0) -> dict[str, DataFrame]:
    """All blocks in long form."""
    bucketed = city_buckets(prepared, min_city)
    cities = bucketed.select("city_bucket").distinct().limit(max_city_columns + 1).count()
    city = one_hot(bucketed, "city_bucket", "geo__city") if cities <= max_city_columns else hashed_city(bucketed, city_width)
    geo = one_hot(prepared, "state_clean", "geo__state").unionByName(city)
    geo = geo.unionByName(scores(prepared, {"latitude_filled": "geo__latitude_z", "longitude_filled": "geo__longitude_z"}))
    geo = geo.unionByName(plain_cells(prepared, {"is_open_clean": "geo__is_open"}))
    if clusters:
        geo = geo.unionByName(geo_clusters(prepared, clusters))
    return {
        "geo": geo, "categories": category_cells(prepared, min_category), "attributes": attribute_cells(prepared, min_attribute, max_values),
        "hours": scores(prepared, HOURS), "priors": plain_cells(prepared, PRIORS),
    }


def feature_metadata(cells: dict[str, DataFrame]) -> DataFrame:
    """Every feature with its block and a contiguous number, blocks in order and names in order within a block.

    The list of features is as long as the vocabularies, so one task numbers it.
    """
    parts = None
    for i, name in enumerate(BLOCKS):
        fixed = {"hours": list(HOURS.values()), "priors": list(PRIORS.values())}.get(name)
        names = cells[name].select("feature_name").distinct()
        if fixed:
            names = cells[name].sparkSession.createDataFrame([(f,) for f in fixed], "feature_name string")
        part = names.select(F.lit(i).alias("_o"), F.lit(name).alias("block_name"), "feature_name")
        parts = part if parts is None else parts.unionByName(part)
    number = F.row_number().over(Window.orderBy("_o", "feature_name")) - 1
    source = F.when(F.col("block_name") == "priors", "train_reviews aggregates").otherwise("business_metadata")
    return parts.select(number.cast("bigint").alias("feature_index"), "feature_name", "block_name", source.alias("source"), (F.col("block_name") == "priors").alias("requires_audit"))
