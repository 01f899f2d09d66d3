"""Routers: which model serves a row, by history band, item frequency or cold-start case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.numeric import clip, round_half_up, short_history_weight, shrunk_mean
from starloom.operators.metrics import mae
from starloom.session import one_row


def router_branch(known: Column, band: Column, prefix_bands: list[str], transition: bool = False) -> Column:
    """cold, known or prefix branch; with ``transition`` the 2-5 band has a branch of its own."""
    out = F.when(~known, "cold_model").when(band.isin(prefix_bands), "known_prefix_deep_model")
    if transition:
        out = out.when(band == "2-5", "transition_blend_model")
    return out.otherwise("known_model")


EXPERTS = {"0": "cold_user_tabular", "1": "very_short_history_tabular", "2-20": "mid_history_tabular", ">20": "long_history_tabular"}


def expert_branch(collapsed: Column) -> Column:
    out = F
    for band, name in EXPERTS.items():
        out = out.when(collapsed == band, name)
    return out.otherwise("long_history_tabular")


def enabled_bands(df: DataFrame, incumbent: str, candidate: str, margin: float = 0.0) -> DataFrame:
    """Per band the MAE of both models on the same rows, and whether the candidate wins by the margin."""
    both = df.filter(F.col(candidate).isNotNull() & ~F.isnan(candidate))
    i, c = mae(round_half_up(F.col(incumbent))), mae(round_half_up(F.col(candidate)))
    stats = both.groupBy("history_band").agg(F.count(F.lit(1)).alias("n_samples"), i.alias("incumbent_mae"), c.alias("candidate_mae"))
    return stats.withColumn("enabled", F.col("candidate_mae") - F.col("incumbent_mae") <= -margin)


def band_names(gate: DataFrame) -> list[str]:
    return sorted(r["history_band"] for r in gate.filter("enabled").select("history_band").collect())


def route(df: DataFrame, branch: str, predictions: dict[str, str], fallback: str) -> DataFrame:
    """The chosen branch's prediction, or the fallback where the branch has none; raw and rounded.

    The branch that served is recorded, so a fallen-back row shows the fallback's name.
    """
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    chosen, served = F, F
    for name, column in predictions.items():
        test = (F.col(branch) == name) & ok(column)
        chosen, served = chosen.when(test, F.col(column)), served.when(test, F.lit(name))
    raw = chosen.otherwise(F.col(predictions[fallback]))
    return df.withColumns(
        {"served_branch": served.otherwise(F.lit(fallback)), "prediction_raw": raw, "prediction": round_half_up(raw)}
    )


def transition_blend(short: Column, medium: Column, count: Column) -> Column:
    w = short_history_weight(count)
    return w * short + (1 - w) * medium


def scatter(df: DataFrame, subset: DataFrame, prediction: str, key: str = "review_id") -> DataFrame:
    """A subset's predictions back on the full table; the other rows get null."""
    s = subset.select(F.col(key).alias("_key"), prediction)
    return df.join(s, df[key] == s["_key"], "left").drop("_key")


def _counts(train: DataFrame, key: str, name: str) -> DataFrame:
    return train.groupBy(F.col(key).alias(f"_{key}")).agg(F.count("rating").alias(name), F.avg("rating").alias(f"_{key}_mean"))


def with_counts(df: DataFrame, train: DataFrame) -> DataFrame:
    u, i = _counts(train, "user", "user_count"), _counts(train, "item", "item_count")
    joined = df.join(u, df["user"] == u["_user"], "left").drop("_user").join(i, df["item"] == i["_item"], "left").drop("_item")
    return joined.withColumns(
        {
            "user_known": F.col("user_count").isNotNull(), "item_known": F.col("item_count").isNotNull(),
            "user_count": F.coalesce("user_count", F.lit(0)), "item_count": F.coalesce("item_count", F.lit(0)),
        }
    )


def threshold_router(df: DataFrame, train: DataFrame, rare: str, frequent: str, threshold: int, unknown: str = "rare", default: float | None = None) -> DataFrame:
    """The model for rare items up to ``threshold`` train ratings, the one for frequent items above.

    Unknown items take the rare or the frequent model or the global mean; a missing prediction becomes ``default``.
    """
    g = one_row(train.agg(F.avg("rating").alias("g")))["g"]
    items = train.groupBy(F.col("item").alias("_item")).agg(F.count(F.lit(1)).alias("item_count"))
    joined = df.join(items, df["item"] == items["_item"], "left").drop("_item")
    n = F.col("item_count")
    used = F.when(n.isNull(), {"rare": "rare", "frequent": "frequent", "global_mean": "global_mean"}[unknown]).when(n <= threshold, "rare").otherwise("frequent")
    joined = joined.withColumns({"item_known": n.isNotNull(), "model_used": used})
    pred = F.when(F.col("model_used") == "rare", F.col(rare)).when(F.col("model_used") == "frequent", F.col(frequent)).otherwise(F.lit(g))
    return joined.withColumn("prediction", clip(F.coalesce(pred, F.lit(g if default is None else default)), 1, 5))


def cold_warm_router(
    df: DataFrame, train: DataFrame, models: dict[str, str], fallback: str | None = None, user_threshold: int = 0, item_threshold: int = 0, specialized: bool = True
) -> DataFrame:
    """warm, cold_user, cold_item or cold_both by presence in train, or by counts up to the thresholds.

    ``models`` maps routes to prediction columns; a route without one takes the fallback, then the global mean.
    """
    g = one_row(train.agg(F.avg("rating").alias("g")))["g"]
    rows = with_counts(df, train)
    cold = lambda known, n, t: ~known | ((F.lit(t) > 0) & (n <= t))
    uc, ic = cold(F.col("user_known"), F.col("user_count"), user_threshold), cold(F.col("item_known"), F.col("item_count"), item_threshold)
    rows = rows.withColumns({"user_is_cold": uc, "item_is_cold": ic})
    u, i = (F.col("user_is_cold"), F.col("item_is_cold")) if specialized else (~F.col("user_known"), ~F.col("item_known"))
    name = F.when(u & i, "cold_both").when(u, "cold_user").when(i, "cold_item").otherwise("warm")
    rows = rows.withColumn("route", name)
    pred, used = F, F
    for r in ("warm", "cold_user", "cold_item", "cold_both"):
        column = models.get(r) or fallback
        pred = pred.when(F.col("route") == r, F.col(column) if column else F.lit(g))
        used = used.when(F.col("route") == r, F.lit(column or "global_mean"))
    return rows.withColumns({"model_used": used, "prediction": clip(F.coalesce(pred, F.lit(g)), 1, 5)}).drop("_user_mean", "_item_mean")


def adaptive_blend(
    df: DataFrame, train: DataFrame, model: str, shrink_user=10.0, shrink_item=10.0, full_confidence=20, partial_penalty=0.35,
    use_item_count=True, posterior: dict | None = None,
) -> DataFrame:
    """A shrunk baseline mixed with a model, by how much is known about user and item.

    The weight is the root of both confidences, reduced when one side is unknown; two unknown sides give the
    baseline alone. With ``posterior`` (factor columns and strengths) half of the weight comes from how
    informative the factors are, and a model that repeats the baseline loses weight.
    """
    s = one_row(train.agg(F.avg("rating").alias("g"), F.min("rating").alias("low"), F.max("rating").alias("high")))
    g, low, high = s["g"], s["low"], s["high"]
    if high <= low:
        raise ValueError("the largest rating must exceed the smallest")
    rows = with_counts(df, train)
    ku, ki, nu, ni = F.col("user_known"), F.col("item_known"), F.col("user_count"), F.col("item_count")
    su, si = shrunk_mean(F.col("_user_mean"), nu, g, shrink_user), shrunk_mean(F.col("_item_mean"), ni, g, shrink_item)
    baseline = F.when(ku & ki, 0.5 * su + 0.5 * si).when(ku, su).when(ki, si).otherwise(F.lit(g))
    rows = rows.withColumn("_baseline", baseline)
    m = F.col(model)
    rows = rows.withColumn("_model", F.coalesce(F.when(~F.isnan(m), m), F.col("_baseline")))
    share = lambda n: F.least(n / F.lit(float(full_confidence)), F.lit(1.0))
    weight = F.sqrt(share(nu) * (share(ni) if use_item_count else F.lit(1.0)))
    if posterior:
        p = {"count_strength": 0.5, "posterior_strength": 0.5, "user_strength": 1.0, "item_strength": 1.5, "neutral": 0.25, "collapse_threshold": 0.05, "collapse_strength": 0.5, **posterior}
        unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
        rows = rows.withColumns(
            {
                "count_weight": weight, "user_conf": F.coalesce(user_confidence(p["user_factors"]), F.lit(p["neutral"])),
                "item_conf": F.coalesce(item_confidence(p["item_factors"]), F.lit(p["neutral"])),
            }
        )
        pw = F.sqrt(unit(F.col("user_conf") * p["user_strength"]) * unit(F.col("item_conf") * p["item_strength"]))
        ratio = F.abs(F.col("_model") - F.col("_baseline")) / F.lit(high - low) / F.lit(p["collapse_threshold"])
        rows = rows.withColumns(
            {"posterior_weight": pw, "collapse_penalty": F.when(ratio >= 1, 1.0).otherwise(1 - p["collapse_strength"] + p["collapse_strength"] * ratio)}
        )
        total = p["count_strength"] + p["posterior_strength"]
        weight = unit(F.col("count_weight") * (p["count_strength"] / total) + F.col("posterior_weight") * (p["posterior_strength"] / total)) * F.col("collapse_penalty")
    weight = F.when(ku & ki, weight).when(ku | ki, weight * partial_penalty).otherwise(F.lit(0.0))
    rows = rows.withColumn("weight", weight)
    w = F.col("weight")
    return rows.withColumns(
        {
            "baseline": clip(F.col("_baseline"), low, high), "model": clip(F.col("_model"), low, high),
            "prediction": clip(w * F.col("_model") + (1 - w) * F.col("_baseline"), low, high),
        }
    ).drop("_baseline", "_model", "_user_mean", "_item_mean")


def user_confidence(factors: str) -> Column:
    """L1 distance of the normalized factors from the uniform ones, as a share of the largest possible."""
    total = F.aggregate(factors, F.lit(0.0), lambda a, x: a + x)
    k = F.size(factors)
    gap = F.aggregate(factors, F.lit(0.0), lambda a, x: a + F.abs(x / total - 1 / k))
    return F.when(total > 0, F.when(k <= 1, 1.0).otherwise(F.least(gap / (2 * (1 - 1 / k)), F.lit(1.0))))


def item_confidence(factors: str) -> Column:
    """Twice the mean distance of the factors from one half."""
    return F.least(2 * F.aggregate(factors, F.lit(0.0), lambda a, x: a + F.abs(x - 0.5)) / F.size(factors), F.lit(1.0))


def replacement(df: DataFrame, bands: list[str], alpha_at_least: dict[str, float] | None = None, correction_at_least: dict[str, float] | None = None) -> DataFrame:
    """Marks rows that the candidate replaces: enabled band, prediction there, weight and correction large enough.

    One function for validation and serving, so that both apply the same thresholds.
    """
    rule = F.lit(False)
    for band in bands:
        keep = (F.col("history_band") == band) & F.col("deep_prediction_available")
        if alpha_at_least and band in alpha_at_least:
            keep = keep & (F.col("alpha") >= alpha_at_least[band])
        if correction_at_least and band in correction_at_least:
            keep = keep & (F.abs("correction_hat") >= correction_at_least[band])
        rule = rule | F.coalesce(keep, F.lit(False))
    replaced = F.when(F.col("replace"), F.col("deep_prediction")).otherwise(F.col("incumbent_prediction"))
    return df.withColumn("replace", rule).withColumn("final_prediction", replaced)


def policy_counts(df: DataFrame, bands: list[str]) -> DataFrame:
    """Candidates and selected rows per enabled band."""
    rows = df.filter(F.col("history_band").isin(bands) & F.col("deep_prediction_available"))
    return rows.groupBy("history_band").agg(F.count(F.lit(1)).alias("initial_candidate_rows"), F.sum(F.col("replace").cast("bigint")).alias("selected_rows"))
