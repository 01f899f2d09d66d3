"""Queries that fit models end to end: boosted trees, ridge, routers, experts, stackers, batch scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.aggregates import test, train
from starloom.catalog.features import stack_input, user_vectors
from starloom.catalog.registry import plain, query
from starloom.functions.numeric import round_half_up
from starloom.operators import bias, metrics, splits
from starloom.operators.boosting import Booster, Ridge
from starloom.plans import pair_features, stackers, training
from starloom.plans.profiles import dense_profiles, with_known_items
from starloom.session import Stored, durable, one_row
from starloom.sources import derived


# Boosting ends by validation, after PATIENCE rounds without gain; ROUNDS is the most.
ROUNDS, PATIENCE = 60, 3
STOPS = {"rounds": ROUNDS, "patience": PATIENCE}


PAIR_COLUMNS = ["review_id", "user", "item", "rating", "timestamp"]


def inputs(spark, sf):
    return derived.train_reviews(spark, sf), derived.test_reviews(spark, sf), derived.users(spark, sf), derived.businesses(spark, sf)


@query("md_boosted_raw_features")
def _(spark, sf):
    _, _, scored = training.train_raw_booster(*inputs(spark, sf), **STOPS)
    return plain(scored.select("review_id", "rating", "prediction_raw", "prediction", "history_band"))


@query("md_feature_importance")
def _(spark, sf):
    model, _, _ = training.train_raw_booster(*inputs(spark, sf), **STOPS)
    return plain(model.importance())


@query("md_ridge_pair_features")
def _(spark, sf):
    t, i = Stored(train(spark, sf).select(*PAIR_COLUMNS)).rows, derived.item_embeddings(spark, sf)
    u = durable(dense_profiles(t, i, 64))
    rows = lambda df: pair_features.pair_feature_rows(pair_features.rows_with_both_vectors(df, u, i, t))
    names = ["cosine", "dot", "user_norm", "item_norm", "norm_gap", "history_log1p"]
    scored = Ridge(names).fit(Stored(rows(t).select(*names, "rating")).rows).score(rows(test(spark, sf).select(*PAIR_COLUMNS)), ["review_id", "user", "rating", "history_band"])
    return plain(scored)


@query("an_embedding_utility")
def _(spark, sf):
    t, i = Stored(train(spark, sf).select(*PAIR_COLUMNS)).rows, derived.item_embeddings(spark, sf)
    asked = durable(with_known_items(test(spark, sf).select(*PAIR_COLUMNS), i))
    names = ["cosine", "dot", "user_norm", "item_norm", "norm_gap", "history_log1p"]
    out = None
    for mode in ("mean", "centered"):
        u = durable(dense_profiles(t, i, 64, mode))
        rows = lambda df: pair_features.pair_feature_rows(pair_features.rows_with_both_vectors(df, u, i, t))
        scored = durable(Ridge(names).fit(Stored(rows(t).select(*names, "rating")).rows).score(rows(asked), ["review_id", "user", "rating", "history_band"], "p"))
        auc = one_row(metrics.preference_auc(scored, "p"))
        part = metrics.by_group(scored, "history_band", "p").withColumns({"space": F.lit(mode), "pairwise_auc": F.lit(auc["pairwise_auc"])})
        out = part if out is None else out.unionByName(part)
    return plain(out)


@query("rt_train_router")
def _(spark, sf):
    run = training.train_router(*inputs(spark, sf), embeddings=derived.item_embeddings(spark, sf), **STOPS)
    return plain(run.metrics["scored"].select("review_id", "rating", "history_band", "served_branch", "prediction_raw", "prediction"))


@query("rt_train_transition_router")
def _(spark, sf):
    run = training.train_router(*inputs(spark, sf), cold_max_band="6-20", transition=True, **STOPS)
    return plain(run.metrics["by_branch"])


@query("rt_batch_scoring")
def _(spark, sf):
    tr, te, users, biz = inputs(spark, sf)
    run = training.train_router(tr, te, users, biz, **STOPS)
    return plain(training.predict_router(run, te.drop("stars"), users, biz))


@query("rt_tabular_experts")
def _(spark, sf):
    scored = training.train_tabular_experts(*inputs(spark, sf), **STOPS)
    return plain(scored.select("review_id", "rating", "band", "expert_name", "baseline", "prediction_raw", "prediction"))


@query("rt_boosted_with_synthetic_cold")
def _(spark, sf):
    t, i, u = train(spark, sf), derived.item_embeddings(spark, sf), user_vectors(spark, sf)
    key = F.col("review_id")
    fit_rows = pair_features.with_synthetic_cold(t, key, 0.2)
    context = pair_features.fit_review_context(t)
    frame = lambda df, forced: pair_features.boosting_features(df, u, i, t, context, 64, forced)
    names = [c for c in frame(t, None).columns if c not in ("review_id", "user", "item", "rating") and not c.startswith("prod_emb_")]
    model = Booster(names, rounds=20, maxDepth=4).fit(frame(fit_rows, F.col("forced_new")))  # for submission: all rows, no validation
    scored = model.score(frame(test(spark, sf), None), ["review_id", "rating", "is_new_user"])
    return plain(scored)


def stacked(spark, sf):
    t = train(spark, sf)
    g = one_row(t.agg(F.avg("rating").alias("g")))["g"]
    return durable(stackers.stack_rows(stack_input(spark, sf), t, derived.users(spark, sf), g))


def stacker(version):
    @query(f"rt_stacker_{version}")
    def _(spark, sf):
        rows = stacked(spark, sf)
        rows = rows if version in ("v5", "v6") else rows.filter(F.col("history_band") != "0")
        first, second = splits.random_split(rows, F.col("review_id"), 0.5)  # each half is scored by the model of the other
        return plain(stackers.run_stacker(version, first, second).unionByName(stackers.run_stacker(version, second, first)))


for _version in ("v1", "v2", "v3", "v4", "v5", "v6"):
    stacker(_version)
