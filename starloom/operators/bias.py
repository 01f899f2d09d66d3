"""Mean and bias models, their explanation and top-k recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.numeric import clip
from starloom.operators import recommend
from starloom.operators.skew import top_rows, before_each_row
from starloom.session import durable, one_row


def _join_side(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    t = table.withColumnRenamed(key, f"_{key}")
    return df.join(t, df[key] == t[f"_{key}"], "left").drop(f"_{key}")


class RatingModel:
    """Fitted tables plus joins: ``fit(train)``, then ``predict(df)`` adds a prediction to rows of user and item."""

    clip_range: tuple | None = (1.0, 5.0)

    def fit(self, train: DataFrame) -> "RatingModel":
        raise NotImplementedError

    def raw(self, df: DataFrame, out: str) -> DataFrame:
        raise NotImplementedError

    def predict(self, df: DataFrame, out: str = "prediction", rounded: bool = False) -> DataFrame:
        scored = self.raw(df, out)
        value = clip(F.col(out), *self.clip_range) if self.clip_range else F.col(out)
        return scored.withColumn(out, F.rint(value) if rounded else value)

    def inner_products(self, users: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The model as inner products: (user, factors, base) of ``users`` and (item, factors, bias) of all known items.

        The prediction of a pair is base + bias + the product of both factor columns; null factors count as 0.
        """
        raise NotImplementedError

    def recommend(self, users: DataFrame, k: int = 10, seen: DataFrame | None = None) -> DataFrame:
        """user, item, score, rank: the ``k`` known items with the highest predictions per user, without the pairs in ``seen`` (``recommend.recommend``)."""
        return recommend.recommend(self, users, seen, k)


class MeanModel(RatingModel):
    """Half the user mean, half the item mean; the global mean stands in for an unknown side."""

    clip_range = None

    def fit(self, train):
        self.g = one_row(train.agg(F.avg("rating").alias("g")))["g"]
        self.users = train.groupBy("user").agg(F.avg("rating").alias("_um"))
        self.items = train.groupBy("item").agg(F.avg("rating").alias("_im"))
        return self

    def raw(self, df, out):
        rows = _join_side(_join_side(df, self.users, "user"), self.items, "item")
        return rows.withColumn(out, (F.coalesce("_um", F.lit(self.g)) + F.coalesce("_im", F.lit(self.g))) / 2).drop("_um", "_im")


class BiasModel(RatingModel):
    """Global mean plus the plain mean deviations of user and item."""

    def fit(self, train):
        self.g = one_row(train.agg(F.avg("rating").alias("g")))["g"]
        self.users = train.groupBy("user").agg((F.avg("rating") - F.lit(self.g)).alias("user_bias"), F.count("rating").alias("n_user_ratings"))
        self.items = train.groupBy("item").agg((F.avg("rating") - F.lit(self.g)).alias("item_bias"), F.count("rating").alias("n_item_ratings"))
        return self

    def components(self, df: DataFrame) -> DataFrame:
        """Each row with the parts of its prediction; an unknown side has bias 0."""
        rows = _join_side(_join_side(df, self.users.select("user", "user_bias"), "user"), self.items.select("item", "item_bias"), "item")
        return rows.withColumns(
            {
                "known_user": F.col("user_bias").isNotNull(), "known_item": F.col("item_bias").isNotNull(), "global_mean": F.lit(self.g),
                "user_bias": F.coalesce("user_bias", F.lit(0.0)), "item_bias": F.coalesce("item_bias", F.lit(0.0)),
            }
        )

    def inner_products(self, users):
        base = F.lit(self.g) + F.coalesce("user_bias", F.lit(0.0))
        own = _join_side(users, self.users.select("user", "user_bias"), "user").select("user", F.lit(None).cast("array<double>").alias("factors"), base.alias("base"))
        return own, self.items.select("item", F.lit(None).cast("array<double>").alias("factors"), F.col("item_bias").alias("bias"))

    def raw(self, df, out):
        rows = self.components(df)
        return rows.withColumn(out, F.col("global_mean") + F.col("user_bias") + F.col("item_bias")).drop("known_user", "known_item", "global_mean", "user_bias", "item_bias")


class RegularizedBiasModel(BiasModel):
    """Biases by alternating damped least squares: items, then users, for a number of epochs.

    The three rating columns are stored once, so that no epoch repeats the joins behind them. An epoch is two
    map-side combined aggregates. The bias tables are checkpointed every few epochs, so the plan does not grow
    and a lost executor does not restart the fit.
    """

    def __init__(self, reg_user: float = 12.0, reg_item: float = 5.0, epochs: int = 10):
        self.reg_user, self.reg_item, self.epochs = reg_user, reg_item, epochs

    def fit(self, train, stored: bool = False):
        """``stored`` says that ``train`` is a checkpoint or table already, and need not be written once more."""
        ratings = train.select("user", "item", "rating")
        ratings = ratings if stored else durable(ratings)
        self.g = one_row(ratings.agg(F.avg("rating").alias("g")))["g"]
        users = None
        for epoch in range(self.epochs):
            rows = ratings if users is None else _join_side(ratings, users.select("user", "user_bias"), "user")
            bu = F.lit(0.0) if users is None else F.coalesce("user_bias", F.lit(0.0))
            items = rows.groupBy("item").agg(
                (F.sum(F.col("rating") - F.lit(self.g) - bu) / (F.lit(self.reg_item) + F.count("rating"))).alias("item_bias"),
                F.count("rating").alias("n_item_ratings"),
            )
            last = epoch == self.epochs - 1
            items = durable(items) if last or epoch % 3 == 2 else items
            rows = _join_side(ratings, items.select("item", "item_bias"), "item")
            users = rows.groupBy("user").agg(
                (F.sum(F.col("rating") - F.lit(self.g) - F.col("item_bias")) / (F.lit(self.reg_user) + F.count("rating"))).alias("user_bias"),
                F.count("rating").alias("n_user_ratings"),
            )
            users = durable(users) if last or epoch % 3 == 2 else users
        self.users, self.items = users, items
        return self


def extreme_biases(table: DataFrame, key: str, bias: str, count: str, n: int = 20, rare: int | None = None) -> DataFrame:
    """The ``n`` entities with the largest bias, optionally among those with at most ``rare`` ratings."""
    rows = table.filter(F.col(count) <= rare) if rare is not None else table
    return rows.withColumn("abs_bias", F.abs(bias)).orderBy(F.col("abs_bias").desc(), key).limit(n)


def recommend_by_item_score(users: DataFrame, scores: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Top-k unseen items per user when the ranking of items is the same for everyone.

    A user's answer lies within the first ``k + number of seen items`` places of the ranking, so only those
    are looked at; no user is paired with the whole catalogue. Needs ``item, score``; ``seen`` is ``user, item``.
    """
    ranked = before_each_row(
        scores.withColumns({"_one": F.lit(1), "_neg": -F.col("score")}), [], ["_neg", "item"], {"_above": ("sum", "_one")}
    ).select("item", "score", (F.coalesce("_above", F.lit(0)) + 1).cast("bigint").alias("_place"))
    pairs = seen.select("user", "item").distinct()
    counts = pairs.groupBy(F.col("user").alias("_u")).agg(F.count(F.lit(1)).alias("_seen"))
    asked = users.select("user").distinct()
    asked = asked.join(counts, asked["user"] == counts["_u"], "left").select("user", F.coalesce("_seen", F.lit(0)).alias("_seen"))
    places = asked.select("user", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k) + F.col("_seen"))).alias("_place"))
    candidates = places.join(ranked, "_place").join(pairs, ["user", "item"], "left_anti")
    return top_rows(candidates, ["user"], [F.col("score").desc(), F.col("item")], k).select("user", "item", "score", "rank")
