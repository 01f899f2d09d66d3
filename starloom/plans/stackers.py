"""Feature rows and fits of the meta models that combine several predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import numeric
from starloom.operators.splits import random_split


def attach_engagement(df: DataFrame, reviews: DataFrame) -> DataFrame:
    """Votes and date parts of each review, joined by review id."""
    part = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    engagement = reviews.select(
        "review_id",
        numeric.log1p_nonnegative(F.col("useful")).alias("review_useful_log1p"),
        numeric.log1p_nonnegative(F.col("funny")).alias("review_funny_log1p"),
        part(F.month("date")).alias("review_month"),
        part(F.weekday("date")).alias("review_weekday"),
    )
    return df.join(engagement, "review_id", "left")


# Fixed names: the columns define each meta model.
STACK_FEATURES = {
    "v1": ["cf_prediction", "cb_prediction_raw", "history_band_enc", "history_count", "history_rating_std", "cf_cb_diff"],
    "v2": [
        "cf_prediction", "cb_prediction_raw", "history_band_enc", "history_count", "history_rating_std", "user_mean_rating", "business_mean_rating",
        "business_review_count", "cf_cb_diff",
    ],
    "v3": ["cb_prediction_raw", "history_band_enc", "history_count", "history_rating_std", "user_mean_rating", "business_mean_rating", "business_review_count"],
    "v4": [
        "cb_prediction_raw", "history_band_enc", "history_count_log1p", "history_rating_std", "user_mean_rating", "business_mean_rating", "business_review_count_log1p",
        "history_positive_share", "history_negative_share", "cb_pred_fractional_part", "correction_hat", "review_useful_log1p", "review_funny_log1p", "review_month", "review_weekday",
        "user_tenure_years", "user_elite_any", "user_total_votes_log1p", "user_business_bias_gap",
    ],
    "v5": [
        "cb_prediction_raw", "history_band_enc", "history_count_log1p", "history_rating_std", "user_mean_rating", "business_mean_rating", "business_review_count_log1p",
        "business_bayesian_prior", "history_positive_share", "history_negative_share", "cb_pred_fractional_part", "correction_hat", "review_useful_log1p",
        "user_tenure_years", "user_elite_any", "user_total_votes_log1p", "user_business_bias_gap",
    ],
    "v6_known": [
        "cb_prediction_raw", "history_band_enc", "history_count_log1p", "history_rating_std", "user_mean_rating", "business_mean_rating", "business_review_count_log1p",
        "business_bayesian_prior", "history_positive_share", "history_negative_share", "cb_pred_fractional_part", "correction_hat", "review_useful_log1p",
        "user_tenure_years", "user_elite_any", "user_total_votes_log1p", "user_business_bias_gap",
    ],
    "v6_cold": [
        "business_mean_rating", "business_review_count_log1p", "business_bayesian_prior", "user_tenure_years", "user_elite_any", "user_total_votes_log1p", "review_useful_log1p",
    ],
}


def train_stats(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean, count and deviation per user and per item, from canonical train reviews."""
    def of(key, name):
        return train.groupBy(F.col(key).alias(f"_{key}")).agg(
            F.avg("rating").alias(f"{name}_mean_rating"), F.count("rating").alias(f"{name}_review_count"), F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias(f"{name}_rating_std"),
        )

    return of("user", "user"), of("item", "business")


def user_profile(users: DataFrame) -> DataFrame:
    """Tenure to a fixed day, elite flag and votes of a user."""
    from starloom.functions import dates, text

    n = lambda c: numeric.number_or(c)
    return users.select(
        F.col("user_id").alias("_profile"), dates.whole_tenure_years(F.col("yelping_since")).alias("user_tenure_years"),
        (text.elite_years(F.col("elite")) > 0).cast("double").alias("user_elite_any"), F.log1p(n("useful") + n("funny") + n("cool")).alias("user_total_votes_log1p"),
    )


def stack_rows(rows: DataFrame, train: DataFrame, users: DataFrame, overall: float) -> DataFrame:
    """Meta features of scored rows.

    Needs review_id, user, item, history_band, history_count, cb_prediction_raw, deep_prediction_raw and the
    votes and timestamp of the review; history statistics and corrections are used when there.
    """
    from starloom.functions.buckets import band_code

    u, i = train_stats(train)
    p = user_profile(users)
    df = rows.join(u, rows["user"] == u["_user"], "left").join(i, rows["item"] == i["_item"], "left").join(p, rows["user"] == p["_profile"], "left")
    df = df.drop("_user", "_item", "_profile")
    g = F.lit(overall)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    part = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    cf = F.coalesce("cf_prediction", "cb_prediction_raw") if "cf_prediction" in rows.columns else F.col("cb_prediction_raw")  # a missing one agrees
    n = F.coalesce(F.col("business_review_count").cast("double"), F.lit(0.0))
    return df.withColumns(
        {
            "history_band_enc": band_code(F.col("history_band")), "history_count_log1p": F.log1p(F.coalesce("history_count", F.lit(0))),
            **{c: zero(c) for c in ("history_rating_std", "history_positive_share", "history_negative_share", "correction_hat")},
            "cf_prediction": cf, "cf_cb_diff": cf - F.col("cb_prediction_raw"), "history_count": F.coalesce("history_count", F.lit(0)), "business_review_count": n,
            "cb_pred_fractional_part": F.abs(F.coalesce("deep_prediction_raw", "cb_prediction_raw") - F.col("cb_prediction_raw")),
            "business_review_count_log1p": F.log1p(n), "business_bayesian_prior": numeric.bayesian_prior(F.col("business_mean_rating"), n, overall),
            "user_business_bias_gap": F.coalesce("user_mean_rating", g) - F.coalesce("business_mean_rating", g),
            "user_mean_rating": F.coalesce("user_mean_rating", g), "business_mean_rating": F.coalesce("business_mean_rating", g),
            "user_rating_std": F.coalesce("user_rating_std", F.lit(0.0)), "business_rating_std": F.coalesce("business_rating_std", F.lit(0.0)),
            "review_useful_log1p": numeric.log1p_nonnegative(F.col("useful")), "review_funny_log1p": numeric.log1p_nonnegative(F.col("funny")),
            "review_month": part(F.month("timestamp")), "review_weekday": part(F.weekday("timestamp")),
            **{c: F.coalesce(c, F.lit(0.0)) for c in ("user_tenure_years", "user_elite_any", "user_total_votes_log1p")},
        }
    )


def cold_stack_rows(validation: DataFrame, train: DataFrame, users: DataFrame, overall: float) -> DataFrame:
    """Meta rows of users without train reviews: the Bayesian item prior stands in for the base prediction."""
    _, i = train_stats(train)
    cold = validation.join(train.select("user").distinct(), "user", "left_anti")
    stats = i.select(F.col("_item"), F.col("business_mean_rating").alias("_m"), F.col("business_review_count").alias("_n"))
    cold = cold.join(stats, cold["item"] == stats["_item"], "left")
    prior = numeric.bayesian_prior(F.col("_m"), F.col("_n"), overall)
    cold = cold.withColumns(
        {"deep_prediction_raw": prior, "history_band": F.lit("0"), "history_count": F.lit(0)}
    ).withColumn("cb_prediction_raw", numeric.clip(F.rint("deep_prediction_raw"), 1, 5)).drop("_item", "_m", "_n")
    return stack_rows(cold, train, users, overall)


def run_stacker(version: str, fit_rows: DataFrame, score_rows: DataFrame, rounds: int = 60, patience: int = 4) -> DataFrame:
    """Fit one stacker and score rows: v1 to v5 are one model, v6 is one model for known and one for new users.

    A fifth of the fit rows, drawn by review, decides when boosting stops; the model is then refitted on all of them.
    """
    from starloom.operators.boosting import Booster

    keep = ["review_id", "history_band"] + (["rating"] if "rating" in score_rows.columns else [])
    if version == "v6":
        known = lambda df: df.filter(F.col("history_band") != "0")
        cold = lambda df: df.filter(F.col("history_band") == "0")
        return run_stacker("v6_known", known(fit_rows), known(score_rows), rounds, patience).unionByName(run_stacker("v6_cold", cold(fit_rows), cold(score_rows), rounds, patience))
    rest, held = random_split(fit_rows, F.col("review_id"), 0.2)
    model = Booster(STACK_FEATURES[version], rounds=rounds, patience=patience, maxDepth=4).fit(rest, held).refit(fit_rows)
    return model.score(score_rows, keep)
