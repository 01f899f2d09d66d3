"""Feature tables over user and item vectors, scalar priors and review context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import dates, numeric, vectors
from starloom.plans.profiles import with_known_items
from starloom.session import one_row


def fit_review_context(train: DataFrame) -> dict:
    """Start of the train window and the scale of each context column, from canonical train reviews."""
    start = one_row(train.agg(F.unix_micros(F.min("timestamp")).alias("start")))["start"]
    columns = dates.review_context("timestamp", start)
    raw = train.select(*[c.alias(n) for n, c in columns.items()])
    return {"start": start, "scale": numeric.fit_scores(raw, list(columns), smallest=1e-6, replaced_by=1.0)}


def scaled_review_context(fitted: dict) -> dict[str, Column]:
    columns = dates.review_context("timestamp", fitted["start"])
    return {n: (c - F.lit(fitted["scale"][n][0])) / F.lit(fitted["scale"][n][1]) for n, c in columns.items()}


def interaction_frame(reviews: DataFrame, with_rating: bool = True) -> DataFrame:
    """Canonical reviews with clamped votes; rows without user, item, time (and rating) are dropped."""
    from starloom.sources.tables import canonical_reviews, drop_null_rows

    df = canonical_reviews(reviews)
    votes = {v: F.greatest(F.coalesce(F.col(v).try_cast("double"), F.lit(0.0)), F.lit(0.0)) if v in df.columns else F.lit(0.0) for v in ("useful", "funny", "cool")}
    need = ["user", "item", "timestamp"] + (["rating"] if with_rating else [])
    keep = [c for c in ["review_id"] + need if c in df.columns]
    return drop_null_rows(df, need).select(*keep, *[c.alias(v) for v, c in votes.items()])


def join_coverage(frame: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """How many rows have a user vector, an item vector, both or neither."""
    rows = _with_vectors(frame, users, items)
    u, i = F.col("user_vector").isNotNull(), F.col("item_vector").isNotNull()
    n = lambda c: F.sum(c.cast("bigint"))
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), n(u).alias("with_user"), n(i).alias("with_item"), n(u & i).alias("with_both"), n(~u & ~i).alias("with_neither"),
        F.avg((u & i).cast("int")).alias("both_rate"),
    )


def _with_vectors(frame: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    u = users.select(F.col("user_id").alias("_u"), F.col("embedding").alias("user_vector"))
    i = items.select(F.col("business_id").alias("_i"), F.col("embedding").alias("item_vector"))
    return frame.join(u, frame["user"] == u["_u"], "left").join(i, frame["item"] == i["_i"], "left").drop("_u", "_i")


def rows_with_both_vectors(frame: DataFrame, users: DataFrame, items: DataFrame, context: DataFrame) -> DataFrame:
    """Rows whose user and item have vectors, with the user's history count and band in the context.

    Rows whose item has none leave first, and the history is joined before any vector: only rows that stay are moved with one.
    """
    from starloom.operators.priors import attach_history
    from starloom.operators.skew import maybe_broadcast

    u = users.where("embedding is not null").select(F.col("user_id").alias("_u"), F.col("embedding").alias("user_vector"))
    i = items.where("embedding is not null").select(F.col("business_id").alias("_i"), F.col("embedding").alias("item_vector"))
    rows = attach_history(with_known_items(frame, items), context)
    return rows.join(u, rows["user"] == u["_u"]).join(maybe_broadcast(i), rows["item"] == i["_i"]).drop("_u", "_i")


def pair_feature_rows(rows: DataFrame) -> DataFrame:
    """The rows with the features of their two vectors in place of these."""
    log = F.log1p("history_count")
    return rows.withColumns(vectors.pair_features(F.col("user_vector"), F.col("item_vector"), log)).drop("user_vector", "item_vector")


def sparse_pair_features(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Dot product, lengths and cosine of sparse vectors in long form; pairs without a common feature get 0."""
    norms = lambda t, key, name: t.groupBy(F.col(key).alias(f"_{name}")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias(f"{name}_norm"))
    p = pairs.select("user", "item").distinct()
    u = users.select(F.col("user").alias("_u"), "feature_index", F.col("value").alias("_x"))
    i = items.select(F.col("business_id").alias("_i"), F.col("feature_index").alias("_f"), F.col("value").alias("_y"))
    cells = p.join(u, p["user"] == u["_u"]).select("user", "item", "feature_index", "_x")
    dots = cells.join(i, (cells["item"] == i["_i"]) & (cells["feature_index"] == i["_f"])).groupBy("user", "item").agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"))
    nu, ni = norms(users, "user", "user"), norms(items, "business_id", "item")
    rows = p.join(dots, ["user", "item"], "left")
    rows = rows.join(nu, rows["user"] == nu["_user"], "left").join(ni, rows["item"] == ni["_item"], "left").drop("_user", "_item").fillna(0.0, ["dot", "user_norm", "item_norm"])
    length = F.greatest(F.col("user_norm") * F.col("item_norm"), F.lit(1e-8))
    return rows.withColumns({"cosine": F.col("dot") / length, "norm_gap": F.abs(F.col("user_norm") - F.col("item_norm"))})


def boosting_features(frame: DataFrame, users: DataFrame, items: DataFrame, train: DataFrame, context: dict, width: int, forced_new: Column | None = None) -> DataFrame:
    """The wide table of a boosted model: both vectors, their product, pair features, priors and review context.

    A user is new when train lacks it, whatever vectors exist, or when ``forced_new`` says so; then vector,
    history and mean of the user are masked, as they would be for a user never seen.
    """
    from starloom.operators.priors import scalar_priors

    g, u, i = scalar_priors(train)
    rows = _with_vectors(frame, users, items)
    rows = rows.join(u, rows["user"] == u["user_key"], "left").join(i, rows["item"] == i["item_key"], "left")
    new = F.col("user_key").isNull() if forced_new is None else F.col("user_key").isNull() | forced_new
    zero = vectors.zeros(width)
    rows = rows.withColumn("is_new_user", new)
    known = ~F.col("is_new_user")
    rows = rows.withColumns(
        {
            "user_vector": F.when(known, F.coalesce("user_vector", zero)).otherwise(zero), "item_vector": F.coalesce("item_vector", zero),
            "history_count": F.when(known, F.coalesce("user_count", F.lit(0.0))).otherwise(0.0), "user_mean_rating": F.when(known, F.coalesce("user_mean", F.lit(g))).otherwise(F.lit(g)),
            "user_rating_std": F.when(known, F.coalesce("user_std", F.lit(0.0))).otherwise(0.0), "biz_mean_rating": F.coalesce("item_mean", F.lit(g)),
            "biz_rating_std": F.coalesce("item_std", F.lit(0.0)), "biz_review_count": F.coalesce("item_count", F.lit(0.0)), "global_mean": F.lit(g),
        }
    )
    pair = vectors.pair_features(F.col("user_vector"), F.col("item_vector"), F.log1p("history_count"))
    pair["biz_norm"] = pair.pop("item_norm")
    scaled = scaled_review_context(context)
    rows = rows.withColumns(
        {**pair, "is_new_user": F.col("is_new_user").cast("double"), "mean_rating_gap": F.col("user_mean_rating") - F.col("biz_mean_rating"), **{f"{n}_z": c for n, c in scaled.items()}}
    )
    scalars = [*pair, "is_new_user", "user_mean_rating", "user_rating_std", "history_count", "biz_mean_rating", "biz_rating_std", "biz_review_count", "global_mean", "mean_rating_gap", *[f"{n}_z" for n in scaled]]
    cells = {f"user_emb_{k}": F.col("user_vector")[k] for k in range(width)}
    cells.update({f"biz_emb_{k}": F.col("item_vector")[k] for k in range(width)})
    cells.update({f"prod_emb_{k}": F.col("user_vector")[k] * F.col("item_vector")[k] for k in range(width)})
    meta = [c for c in ("review_id", "user", "item", "rating") if c in rows.columns]
    return rows.select(*meta, *[c.alias(n) for n, c in cells.items()], *scalars)


def with_synthetic_cold(frame: DataFrame, key: Column, fraction: float, seed: int = 42) -> DataFrame:
    """Training rows plus a hashed share of them once more, marked to be treated as new users."""
    from starloom.operators.splits import sample_fraction

    extra = sample_fraction(frame, key, fraction, seed).withColumn("forced_new", F.lit(True))
    return frame.withColumn("forced_new", F.lit(False)).unionByName(extra)
