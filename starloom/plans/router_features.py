"""The router table: raw features plus user archetypes, business facets, affinities and friends' ratings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import buckets, text
from starloom.operators import graph
from starloom.operators.priors import smoothed_group_stats
from starloom.operators.skew import pin_small
from starloom.plans.raw_features import RawSpec, fit_raw_features, prepare_businesses, prepare_users, raw_features
from starloom.session import durable, one_row
from starloom.sources.tables import canonical_reviews

# Profile columns that the archetypes are formed on.
ARCHETYPE_COLUMNS = [
    "user_average_stars", "user_review_count_log1p", "user_tenure_years", "user_total_votes_log1p", "user_engagement_log1p",
    "user_friends_log1p", "user_elite_years_count", "user_compliment_log1p_total", "user_compliment_nonzero_count",
]
FACETS = {
    "archetype_state": "business_state", "archetype_city": "business_city_top", "archetype_star_bin": "business_star_bin",
    "archetype_open": "business_is_open", "archetype_category": "business_primary_category_family",
}
SPARSE = "__metadata_sparse__"


def top_values(rows: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` values with the largest sum of ``n``; ties by value."""
    return rows.groupBy(column).agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), column).limit(n)


@dataclass
class Archetypes:
    """Fill values, scales and centres of the user clusters."""

    fill: dict[str, float]
    scale: dict[str, float]
    centers: list[list[float]]

    def _normalized(self, c: str) -> Column:
        return (F.coalesce(F.col(c), F.lit(self.fill[c])) - F.lit(self.fill[c])) / F.lit(self.scale[c])

    def assign(self, users: DataFrame) -> DataFrame:
        """Nearest centre, squared distance to it, completeness and buckets; sparse metadata overrides the centre."""
        columns = list(self.fill)
        complete = sum((F.col(c).isNotNull().cast("double") for c in columns), F.lit(0.0)) / len(columns)
        users = users.withColumns({f"_x{i}": self._normalized(c) for i, c in enumerate(columns)})
        square = lambda center: sum(((F.col(f"_x{i}") - F.lit(float(v))) * (F.col(f"_x{i}") - F.lit(float(v))) for i, v in enumerate(center)), F.lit(0.0))
        users = users.withColumn("_d", F.array(*[square(c) for c in self.centers]))
        nearest = F.array_position("_d", F.array_min("_d")) - 1
        sparse = complete < 0.75
        return users.withColumns(
            {
                "user_metadata_completeness": complete, "user_metadata_sparse_flag": sparse.cast("double"), "user_archetype_distance": F.array_min("_d"),
                "user_archetype_id": F.when(sparse, SPARSE).otherwise(F.format_string("archetype_%03d", nearest)),
                "user_activity_bucket": buckets.activity_bucket(F.col("user_review_count")),
                "user_reputation_bucket": buckets.stars_bucket(F.col("user_average_stars")), "user_tenure_bucket": buckets.tenure_bucket(F.col("user_tenure_years")),
            }
        ).drop("_d", *[f"_x{i}" for i in range(len(columns))])


def archetype_scales(users: DataFrame) -> tuple[dict, dict]:
    aggs = [F.avg(c).alias(f"m_{c}") for c in ARCHETYPE_COLUMNS] + [F.stddev_samp(c).alias(f"s_{c}") for c in ARCHETYPE_COLUMNS]
    f = one_row(users.agg(*aggs))
    std = lambda v: v if v is not None and v > 1e-6 else 1.0
    return {c: f[f"m_{c}"] or 0.0 for c in ARCHETYPE_COLUMNS}, {c: std(f[f"s_{c}"]) for c in ARCHETYPE_COLUMNS}


def fit_archetypes(users: DataFrame, k: int = 64, seed: int = 42, iterations: int = 20) -> Archetypes:
    """K-means over normalized profile columns; at least 4 clusters, at most one per user."""
    fill, scale = archetype_scales(users)
    base = Archetypes(fill, scale, [])
    rows = users.select("user_id", *[base._normalized(c).alias(c) for c in ARCHETYPE_COLUMNS])
    points = durable(VectorAssembler(inputCols=ARCHETYPE_COLUMNS, outputCol="features").transform(rows).select("features"))
    n = min(max(4, k), points.limit(max(4, k)).count())
    model = KMeans(k=n, seed=seed, maxIter=iterations).fit(points)
    centers = sorted([float(v) for v in c] for c in model.clusterCenters())
    return Archetypes(fill, scale, centers)


def archetype_profiles(users: DataFrame) -> DataFrame:
    mean = lambda c: F.avg(c).alias(f"{c}_mean")
    return users.groupBy("user_archetype_id").agg(
        F.count("user_id").alias("n_users"), F.avg("user_metadata_completeness").alias("metadata_completeness_mean"),
        F.avg("user_metadata_sparse_flag").alias("metadata_sparse_rate"), *[mean(c) for c in ARCHETYPE_COLUMNS],
    )


def facet_values(businesses: DataFrame, train: DataFrame, cities: int, categories: int) -> tuple[list[str], list[str]]:
    """The most reviewed cities and categories. Reviews are counted per item first, then joined."""
    counts = train.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(businesses, counts["item"] == businesses["business_id"], "left")
    city = joined.select(F.coalesce("business_city", F.lit("__missing__")).alias("v"), "n")
    category = joined.select(F.explode("business_category_tokens").alias("v"), "n")
    names = lambda df, k: [r["v"] for r in top_values(df, "v", k).collect()]  # at most k rows
    return names(city, cities), names(category, categories)


def with_facets(businesses: DataFrame, cities: list[str], categories: list[str]) -> DataFrame:
    return businesses.withColumns(
        {
            "business_city_top": F.when(F.col("business_city").isin(cities), F.col("business_city")).otherwise("__other__"),
            "business_primary_category_family": text.first_allowed(F.col("business_category_tokens"), categories),
            "business_star_bin": buckets.stars_bucket(F.col("business_stars")),
        }
    )


def _faceted(rows: DataFrame, users: DataFrame, businesses: DataFrame) -> DataFrame:
    u = users.select(F.col("user_id").alias("_u"), "user_archetype_id")
    b = businesses.select(F.col("business_id").alias("_b"), *FACETS.values())
    joined = rows.join(u, rows["user"] == u["_u"], "left").join(b, rows["item"] == b["_b"], "left").drop("_u", "_b")
    missing = {"business_state": "__missing__", "business_city_top": "__other__", "business_star_bin": "__missing__", "business_primary_category_family": "__other__"}
    return joined.withColumns(
        {
            "user_archetype_id": F.coalesce("user_archetype_id", F.lit(SPARSE)), **{c: F.coalesce(c, F.lit(d)) for c, d in missing.items()},
            "business_is_open": F.coalesce("business_is_open", F.lit(0.0)).cast("int"),
        }
    )


def archetype_priors(train: DataFrame, users: DataFrame, businesses: DataFrame, overall: float) -> dict[str, DataFrame]:
    """Smoothed mean rating per archetype, and per archetype and business facet.

    The reviews are summed once per archetype and full facet combination; the six tables come from that.
    """
    rows = _faceted(train.select("user", "item", "rating"), users, businesses)
    combined = pin_small(rows.groupBy("user_archetype_id", *FACETS.values()).agg(F.sum("rating").alias("s"), F.count("rating").alias("n")))

    def table(groups, prefix, alpha):
        mean = (F.sum("s") + F.lit(alpha * overall)) / (F.sum("n") + F.lit(alpha))
        return combined.groupBy(*groups).agg(F.sum("n").cast("double").alias(f"{prefix}_support_count"), mean.alias(f"{prefix}_mean"))

    out = {"archetype_train": table(["user_archetype_id"], "archetype_train", 20.0)}
    for prefix, facet in FACETS.items():
        out[prefix] = table(["user_archetype_id", facet], prefix, 50.0)
    return out


@dataclass
class RouterSpec:
    base: RawSpec
    archetypes: Archetypes
    cities: list[str]
    categories: list[str]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    train: DataFrame | None = None
    item_bias: DataFrame | None = None
    content: DataFrame | None = None


def fit_router_features(
    train_reviews: DataFrame, users: DataFrame, businesses: DataFrame, feature_set="raw_core", n_archetypes: int = 64, cities: int = 100, categories: int = 32,
    archetypes: Archetypes | None = None, item_bias: DataFrame | None = None, content: DataFrame | None = None, friends: bool = True, item_stats: bool = True,
) -> RouterSpec:
    base = fit_raw_features(train_reviews, users, businesses, feature_set)
    train = canonical_reviews(train_reviews)
    u = prepare_users(users, base.scalars["end"])
    archetypes = archetypes or fit_archetypes(u, n_archetypes)
    b = prepare_businesses(businesses)
    top_cities, top_categories = facet_values(b, train, cities, categories)
    faceted = with_facets(b, top_cities, top_categories)
    tables = archetype_priors(train, archetypes.assign(u), faceted, base.global_mean)
    if item_stats:
        tables["item_stats"] = train.groupBy(F.col("item").alias("business_id")).agg(
            F.avg("rating").alias("business_train_mean_rating"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("business_train_rating_std")
        )
    return RouterSpec(base, archetypes, top_cities, top_categories, tables, train if friends else None, item_bias, content)


def router_features(reviews: DataFrame, users: DataFrame, businesses: DataFrame, spec: RouterSpec) -> DataFrame:
    """One row per review with raw features, archetype, facets, affinities and optional extras."""
    g = spec.base.global_mean
    frame = raw_features(reviews, users, businesses, spec.base)
    u = spec.archetypes.assign(prepare_users(users, spec.base.scalars["end"]))
    b = with_facets(prepare_businesses(businesses), spec.cities, spec.categories)
    u_columns = {
        "user_archetype_id": SPARSE, "user_metadata_completeness": 0.0, "user_metadata_sparse_flag": 1.0, "user_archetype_distance": 0.0,
        "user_activity_bucket": "__missing__", "user_reputation_bucket": "__missing__", "user_tenure_bucket": "__missing__",
    }
    b_columns = {"business_city_top": "__other__", "business_primary_category_family": "__other__", "business_star_bin": "__missing__"}
    us, bs = u.select(F.col("user_id").alias("_u"), *u_columns), b.select(F.col("business_id").alias("_b"), *b_columns)
    frame = frame.join(us, frame["user"] == us["_u"], "left").join(bs, frame["item"] == bs["_b"], "left").drop("_u", "_b")
    frame = frame.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in {**u_columns, **b_columns}.items()})
    frame = frame.withColumn("business_is_open", F.coalesce("business_is_open", F.lit(0.0)).cast("int"))
    for prefix in ["archetype_train", *FACETS]:
        t = spec.tables[prefix].withColumnRenamed("user_archetype_id", "_a")
        match = frame["user_archetype_id"] == t["_a"]
        if prefix in FACETS:
            facet = FACETS[prefix]
            t = t.withColumnRenamed(facet, "_f")
            match = match & (frame[facet] == t["_f"])
        frame = frame.join(t, match, "left").drop("_a", "_f")
        frame = frame.withColumns(
            {f"{prefix}_support_count": F.coalesce(f"{prefix}_support_count", F.lit(0.0)), f"{prefix}_mean": F.coalesce(f"{prefix}_mean", F.lit(g))}
        )
    frame = frame.withColumns(
        {
            "archetype_train_bias": F.col("archetype_train_mean") - F.lit(g), "archetype_business_star_gap": F.col("archetype_train_mean") - F.col("business_stars"),
            "archetype_state_gap": F.col("archetype_state_mean") - F.col("business_stars"), "archetype_category_gap": F.col("archetype_category_mean") - F.col("business_stars"),
        }
    )
    if spec.content is not None:
        columns = [c for c in spec.content.columns if c != "business_id"]
        c = spec.content.withColumnRenamed("business_id", "_b")
        frame = frame.join(c, frame["item"] == c["_b"], "left").drop("_b").fillna(0.0, columns)
    if "item_stats" in spec.tables:
        s = spec.tables["item_stats"].withColumnRenamed("business_id", "_b")
        frame = frame.join(s, frame["item"] == s["_b"], "left").drop("_b")
        frame = frame.withColumns(
            {"business_train_mean_rating": F.coalesce("business_train_mean_rating", F.lit(g)), "business_train_rating_std": F.coalesce("business_train_rating_std", F.lit(0.0))}
        ).withColumn("business_train_vs_stated_gap", F.col("business_train_mean_rating") - F.col("business_stars"))
    if spec.item_bias is not None:
        i = spec.item_bias.select(F.col("item").alias("_b"), F.col("item_bias").alias("cf_item_bias"))
        frame = frame.join(i, frame["item"] == i["_b"], "left").drop("_b").withColumn("cf_item_bias", F.coalesce("cf_item_bias", F.lit(0.0)))
        frame = frame.withColumn("cf_item_prediction", F.lit(g) + F.col("cf_item_bias"))
    if spec.train is not None:
        frame = graph.with_friend_ratings(frame, users, spec.train, g)
    return frame


def feature_families(columns: list[str], spark) -> DataFrame:
    """How many feature columns each family has, by prefix."""
    families = ["user_compliment_", "user_history_", "user_train_", "user_", "business_train_", "business_attribute", "business_", "archetype_", "friend_business_", "city_", "state_", "postal_", "review_", "item_", "cf_", "known_prefix_"]
    rows = spark.createDataFrame([(c,) for c in columns], "feature string")
    label = F
    for f in families:
        label = label.when(F.col("feature").startswith(f), f.rstrip("_"))
    return rows.groupBy(label.otherwise("other").alias("family")).agg(F.count(F.lit(1)).alias("n_features"))
