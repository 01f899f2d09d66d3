"""Error metrics: overall, by segment, against an incumbent, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import buckets
from starloom.functions.numeric import round_half_up
from starloom.operators.skew import before_each_row, quantiles, top_rows
from starloom.session import durable


def _error(prediction, rating="rating") -> Column:
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    return F.when(p.isNotNull() & ~F.isnan(p), F.col(rating) - p)


def mae(prediction, rating="rating") -> Column:
    """Mean absolute error over the rows with a prediction; for use in ``agg``."""
    return F.avg(F.abs(_error(prediction, rating)))


def rmse(prediction, rating="rating") -> Column:
    e = _error(prediction, rating)
    return F.sqrt(F.avg(e * e))


def overall(df: DataFrame, prediction: str) -> DataFrame:
    return df.agg(mae(prediction).alias("mae"), rmse(prediction).alias("rmse"), F.count(_error(prediction)).alias("n_samples"))


def by_group(df: DataFrame, group: str, prediction: str) -> DataFrame:
    """MAE and RMSE per history band, served branch or any other column."""
    return df.groupBy(group).agg(mae(prediction).alias("mae"), rmse(prediction).alias("rmse"), F.count(_error(prediction)).alias("n_samples"))


def raw_and_rounded(df: DataFrame, prediction: str) -> DataFrame:
    rounded = round_half_up(F.col(prediction))
    return df.agg(
        mae(prediction).alias("mae_raw"), rmse(prediction).alias("rmse_raw"), mae(rounded).alias("mae_rounded"), rmse(rounded).alias("rmse_rounded"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def by_frequency_band(bands, df: DataFrame, prediction: str, metrics: dict[str, Column] | None = None) -> DataFrame:
    """Metrics per low, mid and high band; a metric is an aggregate column. Empty bands stay as null rows."""
    metrics = metrics or {"rmse": rmse(prediction), "mae": mae(prediction)}
    stats = bands.transform(df).groupBy("band").agg(F.count(F.lit(1)).alias("n_rows"), *[c.alias(n) for n, c in metrics.items()])
    names = df.sparkSession.createDataFrame([("low",), ("mid",), ("high",)], "band string")
    return names.join(stats, "band", "left").fillna(0, ["n_rows"])


def ndcg(df: DataFrame, group: str, score: str, relevance: str, tie: str, k: int) -> DataFrame:
    """NDCG@k per group; a group without relevance gets 0.

    Both rankings keep k rows per group, cut before the shuffle.
    """
    gain = lambda rank: F.col(relevance) / F.log2(F.col(rank) + 1)
    got = top_rows(df, [group], [F.col(score).desc(), F.col(tie)], k, "_r").groupBy(group).agg(F.sum(gain("_r")).alias("_dcg"))
    best = top_rows(df, [group], [F.col(relevance).desc(), F.col(tie)], k, "_r").groupBy(group).agg(F.sum(gain("_r")).alias("_ideal"))
    value = F.when(F.col("_ideal") == 0, 0.0).otherwise(F.col("_dcg") / F.col("_ideal"))
    return got.join(best, group).select(group, value.alias("ndcg"))


def preference_auc(df: DataFrame, prediction: str, tie: str = "review_id", first: int | None = None) -> DataFrame:
    """Per user the share of all liked-disliked pairs ranked right (ties half), averaged over the users with both; rows without a prediction are left out.

    Pairs are counted, not made: a liked row wins against the disliked rows of lower predictions. With ``first`` only so many rows
    of either side count, by ``tie``.
    """
    sided = df.withColumn("_side", F.when(F.col("rating") >= 4, 1).when(F.col("rating") <= 2, 0)).filter(F.col("_side").isNotNull())
    kept = sided if first is None else top_rows(sided, ["user", "_side"], [tie], first, "_r")
    counted = kept.filter(F.col(prediction).isNotNull()).groupBy("user", F.col(prediction).alias("_p")).agg(F.sum("_side").alias("_liked"), F.sum(1 - F.col("_side")).alias("_disliked"))
    ranked = before_each_row(counted, ["user"], ["_p"], {"_below": ("sum", "_disliked")}, check=first is None)
    wins = F.sum(F.col("_liked") * (F.coalesce("_below", F.lit(0)) + F.col("_disliked") / 2))
    pairs = F.sum("_liked") * F.sum("_disliked")
    users = ranked.groupBy("user").agg(wins.alias("wins"), pairs.alias("pairs")).filter("pairs > 0")
    return users.select((F.col("wins") / F.col("pairs")).alias("auc")).agg(F.avg("auc").alias("pairwise_auc"), F.count("auc").alias("n_users"))


def with_short_segments(df: DataFrame, count: str = "history_count") -> DataFrame:
    """Each row once per short segment that its history count belongs to."""
    return df.withColumn("segment", F.explode(buckets.short_weight_rows(count)))


def short_segments(df: DataFrame, prediction: str, count: str = "history_count") -> DataFrame:
    """Metrics of the overlapping segments 2, 3, 4, 5, 2-3 and 4-5, built from per-count sums."""
    return by_group(with_short_segments(df, count), "segment", prediction)


def transition_counts(df: DataFrame, predictions: dict[str, str]) -> DataFrame:
    """Rounded MAE of several models by exact history count 2..5 of known users in the 2-5 band."""
    from starloom.functions.numeric import short_history_weight

    short = df.filter((F.col("user_known_in_train") > 0.5) & (F.col("history_band") == "2-5") & F.col("history_count").between(2, 5))
    aggs = [mae(round_half_up(F.col(c))).alias(name) for name, c in predictions.items()]
    return short.groupBy("history_count").agg(
        F.count(F.lit(1)).alias("n_samples"), *aggs, F.avg(short_history_weight(F.col("history_count"))).alias("average_short_weight")
    )


def _available(df):
    return df.filter(F.col("deep_prediction_available") & F.col("history_band").isin("1", "2-5", "6-20", ">20"))


def candidate_by_band(df: DataFrame) -> DataFrame:
    """Candidate against incumbent per band, over the rows the candidate can score."""
    i, d = "incumbent_prediction", "deep_prediction"
    return _available(df).groupBy("history_band").agg(
        F.count(F.lit(1)).alias("n_samples"), mae(i).alias("incumbent_mae"), rmse(i).alias("incumbent_rmse"), mae(d).alias("deep_mae"),
        rmse(d).alias("deep_rmse"), (mae(d) - mae(i)).alias("delta_mae"),
    )


def candidate_by_short_segment(df: DataFrame) -> DataFrame:
    rows = with_short_segments(df.filter((F.col("history_band") == "2-5") & F.col("deep_prediction_available")))
    i, d = mae("incumbent_prediction"), mae("deep_prediction")
    return rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n_samples"), i.alias("incumbent_mae"), d.alias("deep_mae"), (d - i).alias("delta_mae"))


def coverage_by_band(df: DataFrame, branch: str) -> DataFrame:
    """Rows, scorable rows and incumbent branches per band."""
    ok = F.col("deep_prediction_available")
    branches = ["known_model", "known_prefix_deep_model", "cold_model"]
    n = lambda c: F.sum(c.cast("bigint"))
    return df.groupBy("history_band").agg(
        F.count(F.lit(1)).alias("total_rows"), n(ok).alias("deep_available_rows"), n(~ok).alias("deep_unavailable_rows"),
        *[n(F.col(branch) == b).alias(f"{b}_rows") for b in branches], *[n(ok & (F.col(branch) == b)).alias(f"available_{b}_rows") for b in branches],
    )


def correction_stats_by_band(df: DataFrame) -> DataFrame:
    """Spread of the blend weight, size of the correction and shares of rows that got better or worse."""
    rows = _available(df)
    i, d = F.abs(_error("incumbent_prediction")), F.abs(_error("deep_prediction"))
    stats = rows.groupBy("history_band").agg(
        F.count(F.lit(1)).alias("n_samples"), F.avg("alpha").alias("alpha_mean"), F.stddev_pop("alpha").alias("alpha_std"),
        F.avg(F.abs("correction_hat")).alias("mean_abs_correction"), F.avg((d < i).cast("int")).alias("improved_vs_incumbent_pct"),
        F.avg((d > i).cast("int")).alias("worse_vs_incumbent_pct"),
    )
    spread = quantiles(rows, ["history_band"], "alpha", {f"alpha_p{int(p * 100)}": p for p in (0.1, 0.25, 0.5, 0.75, 0.9)})
    return stats.join(spread, "history_band")


def above_thresholds(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Candidate against incumbent over the rows at or above each threshold; empty thresholds are kept.

    The thresholds are conditional aggregates of one pass, laid out as rows afterwards.
    """
    i, d = F.abs(_error("incumbent_prediction")), F.abs(_error("deep_prediction"))
    parts = []
    for k, t in enumerate(thresholds):
        on = F.col(value) >= t
        parts += [
            F.sum(F.when(on, 1).otherwise(0)).alias(f"n{k}"), F.avg(F.when(on, i)).alias(f"i{k}"), F.avg(F.when(on, d)).alias(f"d{k}"),
            F.avg(F.when(on, (d < i).cast("int"))).alias(f"b{k}"),
        ]
    row = lambda k, t: F.struct(
        F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("n_samples"), F.col(f"i{k}").alias("incumbent_mae"), F.col(f"d{k}").alias("deep_mae"),
        (F.col(f"d{k}") - F.col(f"i{k}")).alias("delta_mae"), F.col(f"b{k}").alias("improved_vs_incumbent_pct"),
    )
    return df.agg(*parts).select(F.inline(F.array(*[row(k, t) for k, t in enumerate(thresholds)])))


def worse_error_mass(delta: Column) -> Column:
    """Share of the absolute error change that is for the worse; 0 if nothing changed."""
    total = F.sum(F.abs(delta))
    return F.when(total <= 1e-12, 0.0).otherwise(F.sum(F.greatest(delta, F.lit(0.0))) / total)


def attach_snapshot(base: DataFrame, predictions: DataFrame, name: str) -> DataFrame:
    """Validation rows with one snapshot's predictions, errors and corrections."""
    rows = base.join(predictions, "review_id", "left")
    raw = F.col("deep_prediction_raw")
    available = raw.isNotNull() & ~F.isnan(raw)
    rows = rows.withColumns(
        {
            "snapshot": F.lit(name), "deep_available": F.coalesce(available, F.lit(False)), "history_count": F.coalesce("history_count", F.lit(0)),
            "incumbent_prediction": round_half_up(F.col("incumbent_prediction_raw")),
            "deep_prediction": F.coalesce("deep_prediction", round_half_up(raw)),
            "effective_correction": F.coalesce("correction_hat", "residual_hat", F.lit(0.0)),
        }
    )
    rows = rows.withColumns(
        {
            "incumbent_abs_error": F.abs(F.col("rating") - F.col("incumbent_prediction")), "deep_abs_error": F.abs(F.col("rating") - F.col("deep_prediction")),
            "abs_correction": F.abs("effective_correction"),
            "incumbent_gap_abs": F.abs(F.col("rating") - F.coalesce("incumbent_prediction_raw", F.lit(0.0))),
            "short_segment": F.when(F.col("history_band") == "2-5", buckets.segment_label(F.col("history_count"))),
        }
    )
    delta = F.col("deep_abs_error") - F.col("incumbent_abs_error")
    return rows.withColumns({"error_delta_vs_incumbent": delta, "worse_than_incumbent": F.coalesce(delta > 0, F.lit(False))})


def _delta_columns() -> list[Column]:
    i, d, e = F.avg("incumbent_abs_error"), F.avg("deep_abs_error"), F.col("error_delta_vs_incumbent")
    return [
        i.alias("incumbent_mae"), d.alias("deep_mae"), (d - i).alias("delta_mae"), F.avg("alpha").alias("alpha_mean"),
        F.avg("abs_correction").alias("mean_abs_correction"), F.avg((e > 0).cast("int")).alias("worse_pct"), F.avg((e < 0).cast("int")).alias("improved_pct"),
        worse_error_mass(e).alias("worse_error_mass_pct"),
    ]


def segment_metrics(snapshot: DataFrame) -> DataFrame:
    """Served share, errors, weights and corrections of each short segment."""
    short = snapshot.filter((F.col("history_band") == "2-5") & F.col("history_count").between(2, 5))
    short = durable(with_short_segments(short))  # read for sizes, quantiles and sums
    sizes = short.groupBy("snapshot", "segment").agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum(F.col("deep_available").cast("bigint")).alias("served_rows"),
        F.avg(F.col("deep_available").cast("int")).alias("served_pct"),
    )
    served = short.filter("deep_available")
    spread = quantiles(served, ["snapshot", "segment"], "alpha", {"alpha_p10": 0.1, "alpha_p50": 0.5, "alpha_p90": 0.9})
    stats = served.groupBy("snapshot", "segment").agg(*_delta_columns())
    keys = ["snapshot", "segment"]
    return sizes.join(stats, keys, "left").join(spread, keys, "left")


def served_two_three(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter((F.col("history_band") == "2-5") & F.col("history_count").between(2, 3) & F.col("deep_available"))


def crosscuts(snapshot: DataFrame) -> DataFrame:
    """The same metrics over six bucketings of the rows with two or three earlier reviews."""
    short = durable(served_two_three(snapshot))  # read for the edges of three columns and for the sums
    bucket = lambda c, prefix: buckets.quantile_bucket(F.col(c), buckets.quantile_edges(short, c), prefix)
    cuts = {
        "item_status": F.col("item_status"), "item_support_bucket": F.col("item_support_bucket"),
        "incumbent_gap_bucket": bucket("incumbent_gap_abs", "gap"), "history_variance_bucket": bucket("history_rating_std", "var"),
        "prefix_similarity_bucket": bucket("known_prefix_history_similarity_mean", "sim"), "exact_prefix_length": F.col("history_count").cast("string"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("crosscut"), c.cast("string").alias("bucket")) for n, c in cuts.items()])
    rows = short.select("*", F.inline(pairs)).filter(F.col("bucket").isNotNull())
    return rows.groupBy("snapshot", "crosscut", "bucket").agg(F.count(F.lit(1)).alias("n_samples"), *_delta_columns())


def hypotheses(snapshot: DataFrame, cuts: DataFrame) -> DataFrame:
    """Flags on what goes wrong: overcorrection, noisy representation, a mix of subgroups."""
    from starloom.session import one_row

    short = served_two_three(snapshot)
    e, c = F.col("error_delta_vs_incumbent"), F.col("abs_correction")
    s = one_row(
        short.agg(
            F.count(F.lit(1)).alias("two_three_rows"), F.avg(e).alias("two_three_delta_mae"), worse_error_mass(e).alias("worse_error_mass_pct"),
            F.avg(F.when(e > 0, c)).alias("worse_abs_correction_mean"), F.avg(F.when(e < 0, c)).alias("improved_abs_correction_mean"),
            F.avg(F.when(e > 0, F.col("alpha"))).alias("worse_alpha_mean"), F.avg(F.when(e < 0, F.col("alpha"))).alias("improved_alpha_mean"),
        )
    )
    d = F.col("delta_mae")
    of = lambda name: F.when(F.col("crosscut") == name, d)
    k = one_row(
        cuts.agg(
            (F.max(of("prefix_similarity_bucket")) - F.min(of("prefix_similarity_bucket"))).alias("prefix_similarity_delta_range"),
            F.count(of("prefix_similarity_bucket")).alias("_ns"),
            (F.max(of("history_variance_bucket")) - F.min(of("history_variance_bucket"))).alias("history_variance_delta_range"),
            F.count(of("history_variance_bucket")).alias("_nv"),
            (F.max(d) - F.min(d)).alias("subgroup_delta_spread"), F.min(d).alias("best_subgroup_delta"), F.max(d).alias("worst_subgroup_delta"),
        )
    )
    worse, better = s["worse_abs_correction_mean"], s["improved_abs_correction_mean"]
    row = {**s, **{n: v for n, v in k.items() if not n.startswith("_")}}
    row["h1_overcorrection"] = bool(worse is not None and better is not None and worse > better and s["worse_error_mass_pct"] >= 0.55)
    row["h2_representation_noise"] = bool(
        k["_ns"] >= 2 and k["_nv"] >= 2 and k["prefix_similarity_delta_range"] >= 0.01 and k["history_variance_delta_range"] >= 0.005
    )
    row["h3_subpopulation_mix"] = bool(k["subgroup_delta_spread"] is not None and k["subgroup_delta_spread"] >= 0.015)
    return snapshot.sparkSession.createDataFrame([row])


def extreme_buckets(cuts: DataFrame, n: int = 2) -> DataFrame:
    """The ``n`` best and the ``n`` worst buckets of each snapshot and crosscut."""
    keys = ["snapshot", "crosscut"]
    best = top_rows(cuts, keys, [F.col("delta_mae"), F.col("bucket")], n).withColumn("end", F.lit("best"))
    worst = top_rows(cuts, keys, [F.col("delta_mae").desc(), F.col("bucket")], n).withColumn("end", F.lit("worst"))
    return best.unionByName(worst)


def compare_snapshots(segments: DataFrame, first: str, second: str) -> DataFrame:
    """Both snapshots side by side per segment, with the change of the error difference."""
    values = ["served_rows", "incumbent_mae", "deep_mae", "delta_mae", "alpha_mean", "mean_abs_correction", "worse_pct"]
    wide = segments.groupBy("segment").pivot("snapshot", [first, second]).agg(*[F.max(v).alias(v) for v in values])
    return wide.withColumn(f"{second}_minus_{first}_delta_mae", F.col(f"{second}_delta_mae") - F.col(f"{first}_delta_mae"))


def compare_runs(runs: DataFrame, baseline: str) -> DataFrame:
    """Band metrics of every run against one baseline run, and the change weighted by band size."""
    base = runs.filter(F.col("run") == baseline).select("history_band", F.col("mae").alias("baseline_mae"), F.col("n_samples").alias("_n"))
    joined = runs.join(base, "history_band")
    return joined.select(
        "run", "history_band", "mae", "baseline_mae", (F.col("mae") - F.col("baseline_mae")).alias("delta_mae"), "n_samples",
        ((F.col("mae") - F.col("baseline_mae")) * F.col("_n")).alias("weighted_delta"),
    )


def weighted_impact(compared: DataFrame) -> DataFrame:
    return compared.groupBy("run").agg((F.sum("weighted_delta") / F.sum("n_samples")).alias("estimated_overall_delta"))
