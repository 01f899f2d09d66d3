"""What a user did before each review: running statistics, affinities and event sequences.

Every frame leaves the current row out. Rows are ordered by date and review id, which is unique.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import vectors
from starloom.functions.dates import DAY_MICROS
from starloom.operators.running_median import median_before_each_row
from starloom.operators.skew import before_each_row, has_long_keys, last_rows_before, quantiles, top_rows
from starloom.session import durable

ORDER = ["timestamp", "review_id"]
MAX_LEVELS = 64  # up to so many distinct ratings, medians come from counts per level
FACETS = {
    "city": "business_city_top", "state": "business_state", "category": "business_primary_category_family",
    "is_open": "business_is_open",
}
# Leaky columns that a prefix table must not contain, and the names prefix columns also go by.
WHOLE_HISTORY_COLUMNS = [
    "user_known_in_train", "user_train_count", "user_train_mean", "user_train_std", "user_train_bias",
    "user_train_span_days", "user_train_days_since_last_review", "user_business_train_gap", "user_business_train_bias_sum",
]


def mean_before(df: DataFrame, overall: float, user="user", rating="rating", order=ORDER, out="user_loo_average_stars"):
    """Mean of the user's previous ratings, or ``overall`` for the first review."""
    run = before_each_row(
        df.withColumn("_one", F.lit(1)), [user], order, {"_sum": ("sum", rating), "_count": ("sum", "_one")}
    )
    mean = F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count")).otherwise(F.lit(overall))
    return run.withColumn(out, mean).drop("_one", "_sum", "_count")


def rating_levels(df: DataFrame, rating: str) -> list[float] | None:
    """The distinct ratings if there are few, as with stars; None otherwise."""
    found = df.filter(F.col(rating).isNotNull()).select(F.col(rating).cast("double").alias("r")).distinct().limit(MAX_LEVELS + 1).collect()
    return sorted(r["r"] for r in found) if len(found) <= MAX_LEVELS else None


def median_from_levels(levels: list[float], counts: list[Column]) -> Column:
    """Median of a multiset given by the number of copies of each level."""
    total = sum(counts[1:], counts[0])
    low, high = F.floor((total + 1) / 2), F.floor(total / 2) + 1

    def at(rank):
        seen, out = None, None
        for level, n in zip(levels, counts):
            seen = n if seen is None else seen + n
            out = F.when(seen >= rank, F.lit(level)) if out is None else out.when(seen >= rank, F.lit(level))
        return out

    return (at(low) + at(high)) / 2


def _median(levels: list[float] | None) -> Column:
    """From the counts per level where there are few levels, else from the column made for it."""
    if levels is None:
        return F.col("_median")
    return median_from_levels(levels, [F.coalesce(f"_c{i}", F.lit(0)) for i in range(len(levels))]) if levels else F.lit(None).cast("double")


def _statistics(n, s, ss, low, high, median, positive, negative, stars, first, last, now, candidate, overall) -> dict[str, Column]:
    has = F.coalesce(n, F.lit(0)) > 0
    mean = s / n
    value = lambda c, missing: F.when(has, c).otherwise(F.lit(missing))
    days = lambda a, b: F.greatest(F.coalesce((a - b) / F.lit(DAY_MICROS), F.lit(0.0)), F.lit(0.0))
    p = "tabular_history_"
    return {
        p + "count": F.coalesce(n, F.lit(0)).cast("double"),
        p + "mean": value(mean, overall),
        p + "std": value(F.sqrt(F.greatest(ss / n - mean * mean, F.lit(0.0))), 0.0),
        p + "min": value(low, overall),
        p + "max": value(high, overall),
        p + "median": value(median, overall),
        p + "positive_rate": value(positive / n, 0.0),
        p + "low_rate": value(negative / n, 0.0),
        p + "business_stars_mean": value(stars / n, overall),
        p + "business_star_gap": value(mean - candidate, 0.0),
        p + "span_days": value(days(last, first), 0.0),
        p + "days_since_last": value(days(now, last), 0.0),
    }


def _facet_columns(name: str, n: Column, s: Column, total: Column, overall: float) -> dict[str, Column]:
    has = F.coalesce(n, F.lit(0)) > 0
    p = f"tabular_history_same_{name}_"
    return {
        p + "count": F.coalesce(n, F.lit(0)).cast("double"),
        p + "mean": F.when(has, s / n).otherwise(F.lit(overall)),
        p + "ratio": F.when(has & (total > 0), n / total).otherwise(F.lit(0.0)),
    }


def _completeness() -> Column:
    hits = [F.when(F.col(f"tabular_history_same_{name}_count") > 0, 1.0).otherwise(0.0) for name in FACETS]
    return sum(hits[1:], hits[0]) / F.lit(4.0)


def _prepared(df: DataFrame, overall: float, levels: list[float]) -> DataFrame:
    rating = F.col("rating")
    keys = {
        "_city": F.coalesce(F.nullif(F.trim("business_city_top"), F.lit("")), F.lit("__other__")),
        "_state": F.coalesce(F.nullif(F.trim("business_state"), F.lit("")), F.lit("__missing__")),
        "_category": F.coalesce(F.nullif(F.trim("business_primary_category_family"), F.lit("")), F.lit("__other__")),
        "_is_open": (F.coalesce(F.col("business_is_open").cast("double"), F.lit(0.0)) > 0.5).cast("int"),
    }
    return df.withColumns(
        {
            **keys,
            "_micros": F.unix_micros("timestamp"),
            "_stars": F.coalesce("business_stars", F.lit(overall)),
            "_one": F.lit(1),
            "_square": rating * rating,
            "_positive": (rating >= 4).cast("int"),
            "_negative": (rating <= 2).cast("int"),
            **{f"_level{i}": (rating == level).cast("int") for i, level in enumerate(levels)},
        }
    )


_SUMS = {
    "_n": ("sum", "_one"), "_s": ("sum", "rating"), "_ss": ("sum", "_square"), "_low": ("min", "rating"),
    "_high": ("max", "rating"), "_npos": ("sum", "_positive"), "_nneg": ("sum", "_negative"), "_sstars": ("sum", "_stars"),
    "_first": ("min", "_micros"), "_last": ("max", "_micros"),
}


def prefix_statistics(df: DataFrame, overall: float) -> DataFrame:
    """Running statistics and affinities over each user's earlier reviews.

    Needs user, timestamp, review_id, rating, business_stars and the facet columns. With few distinct ratings the median
    comes from running counts per level, so that it can be carried across pieces of a long history. With
    many, from a running percentile, and in a long history from the middle values of the pieces before (``running_median``).
    """
    known = rating_levels(df, "rating")
    levels = known or []
    work = _prepared(df, overall, levels)
    sums = {**_SUMS, **{f"_c{i}": ("sum", f"_level{i}") for i in range(len(levels))}}
    long_histories = has_long_keys(work, ["user"])
    if known is None:
        work = median_before_each_row(work, ["user"], ORDER, "rating", "_median")
    work = before_each_row(work, ["user"], ORDER, sums, check=long_histories)
    stats = _statistics(
        F.col("_n"), F.col("_s"), F.col("_ss"), F.col("_low"), F.col("_high"), _median(known), F.col("_npos"),
        F.col("_nneg"), F.col("_sstars"), F.col("_first"), F.col("_last"), F.col("_micros"), F.col("_stars"), overall,
    )
    work = work.withColumns(stats)
    for name in FACETS:
        work = before_each_row(work, ["user", f"_{name}"], ORDER, {"_fn": ("sum", "_one"), "_fs": ("sum", "rating")}, check=long_histories)
        total = F.col("tabular_history_count")
        work = work.withColumns(_facet_columns(name, F.col("_fn"), F.col("_fs"), total, overall)).drop("_fn", "_fs")
    work = work.withColumn("tabular_history_feature_completeness", _completeness())
    return work.select(*df.columns, *[c for c in work.columns if c.startswith("tabular_history_")])


def context_statistics(target: DataFrame, context: DataFrame, overall: float) -> DataFrame:
    """The same columns for target rows, from a fixed context that the target rows do not belong to."""
    known = rating_levels(context, "rating")
    levels = known or []
    ctx = _prepared(context, overall, levels)
    sums = {**_SUMS, **{f"_c{i}": ("sum", f"_level{i}") for i in range(len(levels))}}
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    # one pass over the context; all tables below come from its result
    small = durable(ctx.groupBy("user", *[f"_{name}" for name in FACETS]).agg(*[agg[k](c).alias(out) for out, (k, c) in sums.items()]))
    per_user = small.groupBy(F.col("user").alias("_u")).agg(*[agg[k](out).alias(out) for out, (k, _) in sums.items()])
    for name in FACETS:  # a user's values of a facet are few against the user's rows
        facet = small.groupBy("user", f"_{name}").agg(F.sum("_n").alias("n"), F.sum("_s").alias("s"))
        entry = F.struct(F.col(f"_{name}"), F.struct("n", "s"))
        maps = facet.groupBy(F.col("user").alias("_fu")).agg(F.map_from_entries(F.collect_list(entry)).alias(f"_map_{name}"))
        per_user = per_user.join(maps, per_user["_u"].eqNullSafe(maps["_fu"])).drop("_fu")
    rows = _prepared(target.withColumn("rating", F.lit(None).cast("double")), overall, []).drop("_one", "_square", "_positive", "_negative")
    if known is None:
        medians = quantiles(context, ["user"], "rating", {"_median": 0.5}).select(F.col("user").alias("_mu"), "_median")
        per_user = per_user.join(medians, per_user["_u"].eqNullSafe(medians["_mu"]), "left").drop("_mu")
    work = rows.join(per_user, rows["user"] == per_user["_u"], "left").drop("_u")
    work = work.withColumns(
        _statistics(
            F.col("_n"), F.col("_s"), F.col("_ss"), F.col("_low"), F.col("_high"), _median(known), F.col("_npos"),
            F.col("_nneg"), F.col("_sstars"), F.col("_first"), F.col("_last"), F.col("_micros"), F.col("_stars"), overall,
        )
    )
    for name in FACETS:
        of_value = F.try_element_at(F.col(f"_map_{name}"), F.col(f"_{name}"))
        work = work.withColumns(_facet_columns(name, of_value["n"], of_value["s"], F.col("tabular_history_count"), overall)).drop(f"_map_{name}")
    work = work.withColumn("tabular_history_feature_completeness", _completeness())
    return work.select(*[c for c in target.columns if c != "rating"], *[c for c in work.columns if c.startswith("tabular_history_")])


def drop_whole_history(df: DataFrame) -> DataFrame:
    """Without the columns that look at a user's whole history, the current review included."""
    return df.drop(*[c for c in WHOLE_HISTORY_COLUMNS if c in df.columns])


def prefix_aliases(df: DataFrame, overall: float) -> DataFrame:
    """Prefix columns under the names the experts use, with bias and gap derived from them."""
    overall_parts = [
        "count", "mean", "std", "min", "max", "median", "positive_rate", "low_rate", "business_stars_mean", "span_days",
        "days_since_last", "feature_completeness",
    ]
    names = {f"tabular_history_{part}": f"prefix_user_{part}" for part in overall_parts}
    names["tabular_history_business_star_gap"] = "prefix_user_business_gap"
    for name in FACETS:
        for part in ("count", "mean", "ratio"):
            names[f"tabular_history_same_{name}_{part}"] = f"prefix_same_{name}_{part}"
    out = df.withColumns({new: F.col(old) for old, new in names.items() if old in df.columns and new not in df.columns})
    out = out.withColumn("prefix_user_bias_vs_global", F.col("prefix_user_mean") - F.lit(overall))
    if "business_train_mean" in out.columns:
        anchor = F.coalesce("business_train_mean", "business_stars", F.lit(overall)) if "business_stars" in out.columns else F.coalesce("business_train_mean", F.lit(overall))
        out = out.withColumn("prefix_user_business_gap", F.col("prefix_user_mean") - anchor)
    return out


def _event() -> Column:
    return F.struct(F.col("item").alias("item"), F.col("rating").alias("rating"), F.unix_micros("timestamp").alias("micros"))


def _with_days(events: str, now: Column) -> Column:
    return F.transform(
        events,
        lambda e: F.struct(
            e["item"].alias("item"), e["rating"].alias("rating"), F.greatest((now - e["micros"]) / F.lit(DAY_MICROS), F.lit(0.0)).alias("days")
        ),
    )


def event_sequences(df: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` earlier events ``(item, rating, days)``, oldest first, and the exact earlier count."""
    order = ["timestamp", "item", "review_id"]
    long_histories = has_long_keys(df, ["user"])
    work = last_rows_before(df, ["user"], order, _event(), n, "events", check=long_histories)
    counted = work.withColumn("_one", F.lit(1))
    work = before_each_row(counted, ["user"], order, {"exact_history_count": ("sum", "_one")}, check=long_histories)
    return work.drop("_one").withColumns(
        {
            "events": _with_days("events", F.unix_micros("timestamp")),
            "exact_history_count": F.coalesce("exact_history_count", F.lit(0)).cast("bigint"),
        }
    )


def last_events(context: DataFrame, n: int = 20) -> DataFrame:
    """Per user the last ``n`` events, oldest first, with the exact count.

    Rows past the last ``n`` are dropped before the shuffle, so a long history costs its own task nothing.
    """
    back = [F.col(c).desc() for c in ("timestamp", "item", "review_id")]
    kept = top_rows(context, ["user"], back, n, "_back")
    lists = kept.groupBy(F.col("user").alias("_u")).agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("p"), _event().alias("e")))).alias("_list")
    )
    counts = context.groupBy(F.col("user").alias("user")).agg(F.count(F.lit(1)).alias("exact_history_count"))
    return lists.join(counts, lists["_u"] == counts["user"]).select("user", F.transform("_list", lambda x: x["e"]).alias("events"), "exact_history_count")


def context_sequences(target: DataFrame, context: DataFrame, n: int = 20) -> DataFrame:
    """The last ``n`` context events of each target row's user, aged against the target row."""
    last = last_events(context, n).withColumnRenamed("user", "_u")
    joined = target.join(last, target["user"] == last["_u"], "left").drop("_u")
    empty = F.array().cast("array<struct<item:string,rating:double,days:double>>")
    return joined.withColumns(
        {
            "events": F.coalesce(_with_days("events", F.unix_micros("timestamp")), empty),
            "exact_history_count": F.coalesce("exact_history_count", F.lit(0)),
        }
    )


def sequence_statistics(events: str = "events") -> dict[str, Column]:
    """Mean, deviation, extremes, last rating, shares and mean age of an event array; empty gives zeros."""
    e = F.col(events)
    n = F.greatest(F.size(e), F.lit(1)).cast("double")
    total = lambda f: F.aggregate(e, F.lit(0.0), lambda a, x: a + f(x))
    mean = total(lambda x: x["rating"]) / n
    share = lambda test: total(lambda x: F.when(test(x["rating"]), 1.0).otherwise(0.0)) / n
    ratings = F.transform(e, lambda x: x["rating"])
    zero = lambda c: F.when(F.size(e) > 0, c).otherwise(F.lit(0.0))
    return {
        "history_rating_mean": zero(mean),
        "history_rating_std": zero(F.sqrt(total(lambda x: (x["rating"] - mean) * (x["rating"] - mean)) / n)),
        "history_rating_min": zero(F.array_min(ratings)),
        "history_rating_max": zero(F.array_max(ratings)),
        "history_last_rating": zero(F.try_element_at(ratings, F.lit(-1))),
        "history_positive_share": zero(share(lambda r: r >= 4)),
        "history_negative_share": zero(share(lambda r: r <= 2)),
        "history_recency_days_mean": zero(total(lambda x: x["days"]) / n),
    }


def event_features(user_average: Column, overall: float, half_life_days: float, weight_scale: float = 1.0, events="events") -> Column:
    """Nine values per event: rating, centred twice, liked, disliked, deviation, age and decay."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.transform(
        events,
        lambda e: F.struct(
            e["rating"].alias("rating"),
            (e["rating"] - user_average).alias("user_centered"),
            (e["rating"] - F.lit(overall)).alias("global_centered"),
            flag(e["rating"] >= 4).alias("liked"),
            flag(e["rating"] <= 2).alias("disliked"),
            F.abs(e["rating"] - user_average).alias("abs_dev_user"),
            e["days"].alias("days"),
            F.log1p(e["days"]).alias("log_days"),
            (F.exp(-F.lit(math.log(2.0) / max(half_life_days, 1e-6)) * e["days"]) * F.lit(weight_scale)).alias("decay"),
        ),
    )


def scaled_event_ratings(low: float, high: float, overall: float, events="events") -> Column:
    """Per event the rating scaled to 0..1 and its distance from the global mean in the same units."""
    span = max(high - low, 1e-6)
    return F.transform(
        events,
        lambda e: F.struct(
            ((e["rating"] - F.lit(low)) / F.lit(span)).alias("scaled"), ((e["rating"] - F.lit(overall)) / F.lit(span)).alias("centered")
        ),
    )


def sequence_pooling(df: DataFrame, embeddings: DataFrame, width: int) -> DataFrame:
    """Pooled item vectors of each row's event array, against the row's candidate item.

    Three poolings: plain mean, position-weighted, and softmax attention on the dot product with the
    candidate. Only events whose item has a vector count. Needs review_id, item, events and
    exact_history_count. The arrays hold at most the sequence length, so the exploded rows per review are bounded.
    """
    vec = embeddings.select(F.col("business_id").alias("_id"), F.col("embedding").alias("_v"))
    rows = df.select("review_id", "item", "events", "exact_history_count")
    cand = rows.join(vec.withColumnsRenamed({"_id": "_cid", "_v": "_cand"}), F.col("item") == F.col("_cid"), "left").drop("_cid")
    cand = cand.withColumns({"candidate_known": F.col("_cand").isNotNull(), "candidate": F.coalesce("_cand", vectors.zeros(width))}).drop("_cand")
    events = rows.select("review_id", F.posexplode("events").alias("p", "e")).select("review_id", "p", "e.item", "e.rating")
    known = events.join(vec, events["item"] == vec["_id"]).select("review_id", "p", "rating", F.col("_v").alias("v"))
    seq = known.groupBy("review_id").agg(F.sort_array(F.collect_list(F.struct("p", "rating", "v"))).alias("seq"))
    joined = cand.join(seq.withColumnRenamed("review_id", "_rid"), F.col("review_id") == F.col("_rid"), "left").drop("_rid")
    empty = F.array().cast("array<struct<p:int,rating:double,v:array<double>>>")
    joined = joined.withColumn("seq", F.coalesce("seq", empty))
    n = F.size("seq")
    plain_sum = F.aggregate("seq", vectors.zeros(width), lambda a, s: vectors.add(a, s["v"]))
    safe = F.greatest(n, F.lit(1)).cast("double")
    joined = joined.withColumns({"mean_vec": vectors.scale(plain_sum, 1 / safe)})
    weighted = F.aggregate(
        F.transform("seq", lambda s, i: vectors.scale(s["v"], (s["p"] + 1).cast("double"))), vectors.zeros(width), lambda a, v: vectors.add(a, v)
    )
    weights = F.aggregate("seq", F.lit(0.0), lambda a, s: a + (s["p"] + 1))
    joined = joined.withColumns(
        {"recency_vec": vectors.scale(weighted, 1 / F.greatest(weights, F.lit(1.0))), "_scores": F.transform("seq", lambda s: vectors.dot(s["v"], F.col("candidate")))}
    )
    top = F.array_max("_scores")
    joined = joined.withColumn("_exp", F.transform("_scores", lambda s: F.exp(s - top)))
    joined = joined.withColumn("_att", F.aggregate("_exp", F.lit(0.0), lambda a, x: a + x))
    attended = F.aggregate(F.zip_with("seq", "_exp", lambda s, w: vectors.scale(s["v"], w)), vectors.zeros(width), lambda a, v: vectors.add(a, v))
    joined = joined.withColumn("attn_vec", F.when(n > 0, vectors.scale(attended, 1 / F.col("_att"))).otherwise(vectors.zeros(width)))
    joined = joined.withColumn("_cos", F.transform("seq", lambda s: vectors.cosine(s["v"], F.col("candidate"))))
    return joined.drop("_scores", "_exp", "_att")


def pooled_features(pooled: DataFrame) -> DataFrame:
    """The 33 scalar prefix columns from the result of ``sequence_pooling``."""
    n = F.size("seq")
    safe = F.greatest(n, F.lit(1)).cast("double")
    count = F.col("exact_history_count").cast("double")
    ratings = F.transform("seq", lambda s: s["rating"])
    has = n > 0
    zero = lambda c: F.when(has, c).otherwise(F.lit(0.0))
    total = lambda f: F.aggregate("seq", F.lit(0.0), lambda a, s: a + f(s["rating"]))
    mean = total(lambda r: r) / safe
    std = F.sqrt(total(lambda r: (r - mean) * (r - mean)) / safe)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    last = F.try_element_at("seq", F.lit(-1))
    sim_max, sim_mean = zero(F.array_max("_cos")), zero(F.aggregate("_cos", F.lit(0.0), lambda a, x: a + x) / safe)
    last_sim = zero(F.try_element_at("_cos", F.lit(-1)))
    low, high = zero(F.array_min(ratings)), zero(F.array_max(ratings))
    p = "known_prefix_"
    cols = {
        p + "candidate_embedding_known": flag(F.col("candidate_known")),
        p + "history_count": count,
        p + "history_count_log1p": F.log1p(count),
        **{p + f"count_is_{k}": flag(count == k) for k in (2, 3, 4, 5)},
        p + "history_rating_mean": mean,
        p + "history_rating_std": std,
        p + "history_rating_min": low,
        p + "history_rating_max": high,
        p + "history_rating_range": high - low,
        p + "history_last_rating": zero(last["rating"]),
        p + "history_positive_share": total(lambda r: flag(r >= 4)) / safe,
        p + "history_negative_share": total(lambda r: flag(r <= 2)) / safe,
        p + "history_similarity_max": sim_max,
        p + "history_similarity_mean": sim_mean,
        p + "last_item_similarity": last_sim,
        p + "history_similarity_mean_x_count": sim_mean * count,
        p + "history_similarity_max_x_count": sim_max * count,
        p + "last_item_similarity_x_count": last_sim * count,
        p + "history_rating_std_x_count": std * count,
        p + "history_similarity_mean_x_rating_std": sim_mean * std,
        p + "last_item_l2": zero(vectors.distance(last["v"], F.col("candidate"))),
    }
    for name in ("mean", "recency", "attn"):
        v, c = F.col(f"{name}_vec"), F.col("candidate")
        cols[p + f"{name}_cosine"] = vectors.cosine(v, c)
        cols[p + f"{name}_dot"] = vectors.dot(v, c)
        cols[p + f"{name}_l2"] = vectors.distance(v, c)
    return pooled.select("review_id", "candidate", "mean_vec", "recency_vec", "attn_vec", *[c.alias(n) for n, c in cols.items()])
