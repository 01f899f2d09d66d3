"""The raw feature table: reviews with user and business metadata and, optionally, train priors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import buckets, dates, numeric, text
from starloom.operators.priors import entity_priors, place_priors, train_scalars
from starloom.sources.derived import COMPLIMENTS
from starloom.sources.tables import canonical_reviews

CATEGORICAL = [
    "business_city", "business_state", "business_postal_code", "business_train_support_bucket", "user_train_history_bucket",
]
META = ["review_id", "user", "item", "rating", "review_date"]


@dataclass
class RawSpec:
    """What is fitted on train: scalars, prior tables and, per categorical column, its levels."""

    feature_set: str
    scalars: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)
    levels: DataFrame | None = None

    @property
    def global_mean(self) -> float:
        return self.scalars["global_mean"]


def prepare_users(users: DataFrame, train_end: int) -> DataFrame:
    """User metadata as features, one row per user, all prefixed ``user_``."""
    n = lambda c: numeric.number_or(c)
    since = F.col("yelping_since").try_cast("timestamp")
    tenure = dates.tenure_days(since, train_end)
    votes = n("useful") + n("funny") + n("cool")
    compliments = [n(f"compliment_{c}") for c in COMPLIMENTS]
    total = sum(compliments[1:], compliments[0])
    positive = [(c > 0).cast("double") for c in compliments]
    elite, friends = text.elite_years(F.col("elite")).cast("double"), text.friend_count(F.col("friends")).cast("double")
    columns = {
        "user_tenure_days": tenure,
        "user_tenure_years": tenure / 365.25,
        "user_yelping_since_missing": since.isNull().cast("double"),
        **{f"user_{c}": n(c) for c in ("review_count", "useful", "funny", "cool", "fans")},
        "user_average_stars": numeric.number_or("average_stars", None),
        "user_review_count_log1p": F.log1p(n("review_count")),
        "user_total_votes": votes,
        "user_total_votes_log1p": F.log1p(votes),
        "user_engagement_log1p": F.log1p(votes + n("fans")),
        "user_elite_years_count": elite,
        "user_elite_any": (elite > 0).cast("double"),
        "user_friends_count": friends,
        "user_friends_log1p": F.log1p(friends),
        **{f"user_compliment_{c}": n(f"compliment_{c}") for c in COMPLIMENTS},
        "user_compliment_total": total,
        "user_compliment_nonzero_count": sum(positive[1:], positive[0]),
        "user_compliment_log1p_total": F.log1p(total),
    }
    return users.select("user_id", *[c.alias(name) for name, c in columns.items()])


def prepare_businesses(businesses: DataFrame) -> DataFrame:
    """Business metadata as features, one row per business, all prefixed ``business_``, plus category tokens."""
    n = lambda c, d=0.0: numeric.number_or(c, d)
    flag = lambda c: c.cast("double")
    attributes = businesses.withColumns(
        {"_a": text.flat_attributes(F.col("attributes")), "_tokens": text.tokens(F.col("categories")), "_open": text.open_days(F.col("hours"))}
    )
    hours = text.opening_hours("_open")
    matching = lambda test: F.size(F.filter("_a", test)).cast("double")
    lat, lon, stars, count = n("latitude", None), n("longitude", None), n("stars", None), n("review_count")
    columns = {
        "business_city": text.text_or(F.col("city"), "__missing__"),
        "business_state": text.text_or(F.col("state"), "__missing__"),
        "business_postal_code": text.text_or(F.col("postal_code"), "__missing__"),
        "business_latitude": lat,
        "business_longitude": lon,
        "business_stars": stars,
        "business_review_count": count,
        "business_is_open": n("is_open"),
        "business_review_count_log1p": F.log1p(count),
        "business_has_latitude": flag(lat.isNotNull()),
        "business_has_longitude": flag(lon.isNotNull()),
        "business_categories_count": F.size("_tokens").cast("double"),
        "business_categories_missing": flag(F.col("categories").isNull()),
        "business_has_categories": flag(F.col("categories").isNotNull()),
        "business_attributes_count": F.size("_a").cast("double"),
        "business_attributes_missing": flag(F.col("attributes").isNull()),
        "business_has_attributes": flag(F.col("attributes").isNotNull()),
        "business_attribute_true_count": matching(lambda e: (e["kind"] == "bool") & (e["value"] == "true")),
        "business_attribute_false_count": matching(lambda e: (e["kind"] == "bool") & (e["value"] == "false")),
        "business_attribute_string_count": matching(lambda e: e["kind"] == "text"),
        **{f"business_{k}": c for k, c in hours.items()},
        "business_hours_missing": flag(F.col("hours").isNull()),
        "business_has_hours": flag(F.col("hours").isNotNull()),
        "business_rating_per_review": stars / F.greatest(count, F.lit(1.0)),
        "business_geo_abs": F.abs(F.coalesce(lat, F.lit(0.0))) + F.abs(F.coalesce(lon, F.lit(0.0))),
        "business_category_tokens": F.col("_tokens"),
    }
    return attributes.select("business_id", *[c.alias(name) for name, c in columns.items()])


def prepare_reviews(reviews: DataFrame) -> DataFrame:
    """Canonical reviews with vote and date columns. Negative votes are clamped before the logarithm."""
    df = canonical_reviews(reviews)
    if "rating" not in df.columns:
        df = df.withColumn("rating", F.lit(None).cast("double"))
    for vote in ("useful", "funny", "cool"):
        if vote not in df.columns:
            df = df.withColumn(vote, F.lit(0.0))
    votes = {f"review_{v}": numeric.number_or(v) for v in ("useful", "funny", "cool")}
    return df.select(
        "review_id", F.col("user").cast("string").alias("user"), F.col("item").cast("string").alias("item"), "rating",
        F.col("timestamp").alias("review_date"),
        *[c.alias(n) for n, c in votes.items()],
        (votes["review_useful"] + votes["review_funny"] + votes["review_cool"]).alias("review_total_votes"),
        *[numeric.log1p_nonnegative(c).alias(f"{n}_log1p") for n, c in votes.items()],
        *[c.alias(n) for n, c in dates.date_parts(F.col("timestamp")).items()],
    )


def fit_raw_features(train_reviews: DataFrame, users: DataFrame, businesses: DataFrame, feature_set="raw_priors") -> RawSpec:
    if feature_set not in ("raw_core", "raw_priors"):
        raise ValueError(f"unknown feature set {feature_set}")
    train = canonical_reviews(train_reviews)
    scalars = train_scalars(train)
    places = prepare_businesses(businesses).select("business_id", "business_city", "business_state", "business_postal_code")
    tables = {
        "user": entity_priors(train, "user", "user", scalars),
        "business": entity_priors(train, "item", "business", scalars),
        **place_priors(train, places),
    }
    return RawSpec(feature_set, scalars, tables)


def raw_features(reviews: DataFrame, users: DataFrame, businesses: DataFrame, spec: RawSpec) -> DataFrame:
    """One row per review with all raw features; priors are added for the ``raw_priors`` set.

    User and item priors are joined on the ids of the review itself, so that a train user without a profile
    keeps them. Place priors are joined null-safe: businesses without a row share the group of missing places.
    """
    g = F.lit(spec.global_mean)
    rv = prepare_reviews(reviews)
    u = prepare_users(users, spec.scalars["end"])
    b = prepare_businesses(businesses).drop("business_category_tokens")
    frame = rv.join(u, rv["user"] == u["user_id"], "left").drop("user_id")
    frame = frame.join(b, frame["item"] == b["business_id"], "left").drop("business_id")
    user_priors, item_priors = spec.tables["user"], spec.tables["business"]
    frame = frame.join(user_priors, frame["user"] == user_priors["user_id"], "left")
    frame = frame.join(item_priors, frame["item"] == item_priors["business_id"], "left")
    known_user, known_item = F.col("user_id").isNotNull(), F.col("business_id").isNotNull()
    or0 = lambda c: F.coalesce(c, F.lit(0.0))
    frame = frame.withColumns(
        {
            "user_known_in_train": known_user.cast("double"),
            "business_known_in_train": known_item.cast("double"),
            "review_days_since_train_start": or0(dates.days_from_micros(F.col("review_date"), spec.scalars["start"])),
            "review_days_since_train_end": F.greatest(or0(dates.days_from_micros(F.col("review_date"), spec.scalars["end"])), F.lit(0.0)),
            "user_average_stars": F.coalesce("user_average_stars", g),
            "user_tenure_days": or0("user_tenure_days"),
            "user_tenure_years": or0("user_tenure_years"),
            "business_stars": F.coalesce("business_stars", g),
            "business_latitude": or0("business_latitude"),
            "business_longitude": or0("business_longitude"),
            "business_rating_per_review": F.coalesce("business_rating_per_review", g),
            "business_geo_abs": or0("business_geo_abs"),
        }
    ).drop("user_id", "business_id")
    prior_columns = [c for c in user_priors.columns + item_priors.columns if c not in ("user_id", "business_id")]
    if spec.feature_set == "raw_core":
        frame = frame.drop(*prior_columns).withColumns(
            {"business_train_support_bucket": F.lit("__missing__"), "user_train_history_bucket": F.lit("__missing__")}
        )
    else:
        for name, column in (("city", "business_city"), ("state", "business_state"), ("postal", "business_postal_code")):
            prior = spec.tables[name].withColumnRenamed(column, "_place")
            frame = frame.join(prior, frame[column].eqNullSafe(prior["_place"]), "left").drop("_place")
        means = {c for c in frame.columns if c.endswith("_train_mean")}
        priors = prior_columns + [f"{p}_train_{k}" for p in ("city", "state", "postal") for k in ("count", "mean")]
        frame = frame.withColumns({c: F.coalesce(c, g if c in means else F.lit(0.0)) for c in priors})
        frame = frame.withColumns(support_interactions())
    frame = frame.withColumns(
        {
            "user_minus_global_mean": F.col("user_average_stars") - g,
            "business_minus_global_mean": F.col("business_stars") - g,
            "user_business_metadata_gap": F.col("user_average_stars") - F.col("business_stars"),
            "user_review_count_x_business_review_count": F.log1p("user_review_count") * F.log1p("business_review_count"),
            **{c: text.text_or(F.col(c), "__missing__") for c in CATEGORICAL},
        }
    )
    features = [c for c in frame.columns if c not in META]
    return frame.select(*META, *features)


def support_interactions() -> dict:
    """Gaps, exact short-history flags and products of user history and item support."""
    nu, ni = F.col("user_train_count"), F.col("business_train_count")
    flag = lambda c: c.cast("double")
    return {
        "user_business_train_gap": F.col("user_train_mean") - F.col("business_train_mean"),
        "user_business_train_bias_sum": F.col("user_train_bias") + F.col("business_train_bias"),
        "business_train_support_bucket": buckets.support_bucket(ni),
        "user_train_history_bucket": buckets.support_bucket(nu),
        "item_is_new": flag(ni <= 0),
        "item_support_log1p": F.log1p(ni),
        "user_history_count_log1p": F.log1p(nu),
        **{f"user_history_is_{k}": flag(nu == k) for k in (2, 3, 4, 5)},
        "user_history_is_short_2_3": flag(nu.between(2, 3)),
        "user_history_is_short_4_5": flag(nu.between(4, 5)),
        "user_item_support_interaction": F.log1p(nu) * F.log1p(ni),
        "item_support_per_user_history": ni / F.greatest(nu, F.lit(1.0)),
        "item_support_x_known_user": ni * F.col("user_known_in_train"),
    }


def fit_levels(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The levels each categorical column has at fit time, numbered by name: ``column, level, index``."""
    from pyspark.sql import Window

    pairs = frame.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("level")) for c in columns]))).distinct()
    return pairs.withColumn("index", (F.row_number().over(Window.partitionBy("column").orderBy("level")) - 1).cast("bigint"))


def encode_levels(frame: DataFrame, levels: DataFrame, columns: list[str], unknown: float = -1.0) -> DataFrame:
    """Each categorical column as the number of its level; levels not seen at fit time become ``unknown``."""
    from starloom.operators.skew import maybe_broadcast

    spark = frame.sparkSession
    most = 100_000
    rows = levels.filter(F.col("column").isin(columns)).limit(most + 1).collect()
    for c in columns:
        if len(rows) <= most:  # small enough to be constants of the plan
            own = [(r["level"], float(r["index"])) for r in rows if r["column"] == c]
            of_column = F.broadcast(spark.createDataFrame(own, "_l string, _i double"))
        else:
            of_column = maybe_broadcast(levels.filter(F.col("column") == c).select(F.col("level").alias("_l"), F.col("index").cast("double").alias("_i")))
        frame = frame.join(of_column, frame[c] == F.col("_l"), "left").withColumn(c, F.coalesce("_i", F.lit(unknown))).drop("_l", "_i")
    return frame
