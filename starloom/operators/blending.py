"""Combining predictions: row-wise ensembles, fitted weights, votes and submission ensembles."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.numeric import clip, round_half_even, round_half_up
from starloom.operators.metrics import mae, rmse
from starloom.session import one_row


def _present(predictions: list[str]) -> Column:
    cols = [F.when(~F.isnan(F.col(c)), F.col(c)) for c in predictions]
    return F.filter(F.array(*cols), lambda x: x.isNotNull())


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def array_median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(s)
    low, high = F.floor((n + 1) / 2).cast("int"), (F.floor(n / 2) + 1).cast("int")
    return F.when(n > 0, (F.try_element_at(s, F.greatest(low, F.lit(1))) + F.try_element_at(s, F.greatest(high, F.lit(1)))) / 2)


def combine(predictions: list[str], strategy: str, weights: list[float] | None = None, clip_to=(1.0, 5.0)) -> Column:
    """Mean, median or weighted mean of the predictions that are there; weights are renormalized over them."""
    if strategy == "mean":
        out = array_mean(_present(predictions))
    elif strategy == "median":
        out = array_median(_present(predictions))
    elif strategy == "weighted":
        if weights is None:
            raise ValueError("weighted needs weights")
        ok = [F.col(c).isNotNull() & ~F.isnan(c) for c in predictions]
        total = sum(F.when(o, F.lit(w)).otherwise(0.0) for o, w in zip(ok, weights))
        out = sum(F.when(o, F.col(c) * w).otherwise(0.0) for o, c, w in zip(ok, predictions, weights)) / F.nullif(total, F.lit(0.0))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    return clip(out, *clip_to) if clip_to else out


def weights_from_errors(df: DataFrame, predictions: list[str], metric: str = "rmse", temperature: float = 1.0) -> list[float]:
    """Softmax of minus temperature times error; a model without predictions gets weight 0."""
    measure = {"rmse": rmse, "mae": mae}[metric]
    errors = one_row(df.agg(*[measure(c).alias(c) for c in predictions]))
    scaled = [-temperature * errors[c] if errors[c] is not None else -math.inf for c in predictions]
    top = max(scaled)
    raw = [math.exp(s - top) for s in scaled]
    return [r / sum(raw) for r in raw]


def _filled_with_row_mean(predictions: list[str]) -> list[Column]:
    mean = F.coalesce(array_mean(_present(predictions)), F.lit(0.0))
    return [F.coalesce(F.when(~F.isnan(c), F.col(c)), mean) for c in predictions]


def _simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative entries that sum to one."""
    u = np.sort(v)[::-1]
    above = np.cumsum(u) - 1.0
    k = np.nonzero(u - above / np.arange(1, len(v) + 1) > 0)[0][-1]
    return np.maximum(v - above[k] / (k + 1.0), 0.0)


def optimal_weights(df: DataFrame, predictions: list[str], steps: int = 5000) -> list[float]:
    """Non-negative weights with sum one and least squared error.

    The rows are reduced to the products of every two models and of each with the rating; the few numbers
    are then solved on the driver.
    """
    x = _filled_with_row_mean(predictions)
    k = len(predictions)
    aggs = [F.avg(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.avg(x[i] * F.col("rating")).alias(f"b{i}") for i in range(k)]
    found = one_row(df.agg(*aggs))
    gram = np.array([[found[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    b = np.array([found[f"b{i}"] for i in range(k)])
    w, step = np.full(k, 1.0 / k), 1.0 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    for _ in range(steps):
        w = _simplex(w - step * (gram @ w - b))
    return [float(v) for v in w]


class RidgeStack:
    """Ridge regression over the predictions; missing ones take the column mean at fit and the row mean later."""

    def __init__(self, predictions: list[str], alpha: float = 1.0):
        self.predictions, self.alpha = predictions, alpha

    def fit(self, df: DataFrame) -> "RidgeStack":
        means = one_row(df.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in self.predictions]))
        x = [F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(means[c] or 0.0)) for c in self.predictions]
        y, k = F.col("rating"), len(x)
        aggs = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(x[i] * y).alias(f"b{i}") for i in range(k)]
        aggs += [F.sum(c).alias(f"s{i}") for i, c in enumerate(x)] + [F.sum(y).alias("y"), F.count(y).alias("n")]
        f = one_row(df.agg(*aggs))
        n, s = f["n"], np.array([f[f"s{i}"] for i in range(k)])
        gram = np.array([[f[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - np.outer(s, s) / n
        b = np.array([f[f"b{i}"] for i in range(k)]) - s * f["y"] / n
        self.coefficients = np.linalg.solve(gram + self.alpha * np.eye(k), b)
        self.intercept = f["y"] / n - float(self.coefficients @ s) / n
        return self

    def predict(self) -> Column:
        x = _filled_with_row_mean(self.predictions)
        return clip(sum((F.lit(float(w)) * c for w, c in zip(self.coefficients, x)), F.lit(float(self.intercept))), 1, 5)


def majority_vote(
    df: DataFrame, models: list[str], base: str, majority: int | None = None, conflict: int = 4,
    tie_strategy: str = "base_model", conflict_strategy: str = "base_model", out: str = "stars_blend",
) -> DataFrame:
    """The most voted star if it has a majority; otherwise, and on strong conflict, the named strategy."""
    majority = majority or len(models) // 2 + 1
    a = F.array(*[F.col(m) for m in models])
    count = lambda star: F.size(F.filter(a, lambda x: x == star)).cast("bigint")
    votes = {f"votes_{s}": count(s) for s in range(1, 6)}
    df = df.withColumns(
        {
            **votes, "blend_min": F.array_min(a), "blend_max": F.array_max(a), "blend_mean": array_mean(a), "blend_median": array_median(a),
            "blend_n_unique": F.size(F.array_distinct(a)).cast("bigint"),
        }
    )
    most = F.greatest(*[F.col(v) for v in votes])
    mode = F.coalesce(*[F.when(F.col(f"votes_{s}") == most, F.lit(float(s))) for s in range(1, 6)])
    df = df.withColumns({"blend_max_diff": F.col("blend_max") - F.col("blend_min"), "blend_mode": mode, "blend_mode_count": most})
    df = df.withColumns({"blend_has_majority": F.col("blend_mode_count") >= majority, "blend_strong_conflict": F.col("blend_max_diff") >= conflict})
    other = {
        "base_model": F.col(base), "median": round_half_even(F.col("blend_median")), "mean_round": round_half_even(F.col("blend_mean")), "mode": F.col("blend_mode"),
    }
    chosen = F.when(F.col("blend_strong_conflict"), other[conflict_strategy]).when(~F.col("blend_has_majority"), other[tie_strategy]).otherwise(F.col("blend_mode"))
    return df.withColumn(out, clip(chosen, 1, 5).cast("bigint"))


def vote_summary(df: DataFrame) -> DataFrame:
    no, hard = (~F.col("blend_has_majority")).cast("int"), F.col("blend_strong_conflict").cast("int")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(no).alias("n_no_majority"), F.sum(hard).alias("n_strong_conflict"),
        F.avg(no).alias("pct_no_majority"), F.avg(hard).alias("pct_strong_conflict"),
    )


def conflict_rows(df: DataFrame, min_diff: int = 4, no_majority_only: bool = False) -> DataFrame:
    rows = df.filter(F.col("blend_max_diff") >= min_diff)
    return rows.filter(~F.col("blend_has_majority")) if no_majority_only else rows


def _mode_of_stars(stars: Column, median: Column) -> Column:
    """Most frequent whole star; among equals the rounded median if it is one of them, else the largest."""
    count = lambda s: F.size(F.filter(stars, lambda x: x == s))
    counts = F.array(*[count(s) for s in range(1, 6)])
    best = F.filter(F.array(*[F.lit(float(s)) for s in range(1, 6)]), lambda s: F.element_at(counts, s.cast("int")) == F.array_max(counts))
    return F.when(F.array_contains(best, round_half_up(median)), round_half_up(median)).otherwise(F.array_max(best))


def submission_ensemble(long: DataFrame, method: str = "median", trim: float = 0.1) -> DataFrame:
    """One row per review from a long table ``path, review_id, stars`` of several submissions.

    A review that a submission lacks, or has twice, is an error. A review has one row per submission, so the
    collected arrays are as short as the list of submissions.
    """
    members = long.select("path").distinct().count()
    if members < 2:
        raise ValueError("an ensemble needs two submissions")
    a = long.groupBy("review_id").agg(F.collect_list("stars").alias("a"), F.countDistinct("path").alias("paths"), F.count(F.lit(1)).alias("n"))
    if not a.filter((F.col("paths") != members) | (F.col("n") != members)).isEmpty():
        raise ValueError("submissions do not hold the same reviews")
    s = F.array_sort("a")
    cut = int(math.floor(members * trim))
    trimmed = s if members <= 2 or cut == 0 or 2 * cut >= members else F.slice(s, cut + 1, members - 2 * cut)
    median = array_median(F.col("a"))
    raw = {
        "median": median, "mean": array_mean(F.col("a")), "trimmed_mean": array_mean(trimmed),
        "mode": _mode_of_stars(F.transform("a", lambda x: round_half_up(x)), median),
    }[method]
    mean = array_mean(F.col("a"))
    std = F.sqrt(F.aggregate("a", F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / F.size("a"))
    low, high = F.array_min("a"), F.array_max("a")
    return a.select(
        "review_id", low.alias("prediction_min"), high.alias("prediction_max"), (high - low).alias("prediction_range"), std.alias("prediction_std"),
        raw.alias("ensemble_raw"), round_half_up(raw).cast("bigint").alias("ensemble_rounded"),
    )


def submission_members(long: DataFrame) -> DataFrame:
    return long.groupBy("path").agg(F.avg("stars").alias("mean_prediction"), F.stddev_pop("stars").alias("std_prediction"))


def agreement(df: DataFrame, models: list[str]) -> DataFrame:
    """How many rows all models agree on, and the correlation of every two models."""
    a = F.array(*[F.col(m) for m in models])
    pairs = [(x, y) for i, x in enumerate(models) for y in models[i + 1 :]]
    found = one_row(df.agg(F.avg((F.size(F.array_distinct(a)) == 1).cast("int")).alias("|"), *[F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs]))
    rows = [(x, y, found[f"{x}|{y}"], found["|"]) for x, y in pairs]
    return df.sparkSession.createDataFrame(rows, "first string, second string, correlation double, all_agree double")


def calibrate_alpha(df: DataFrame, expert: str, baseline: str, group: str) -> DataFrame:
    """Per group the blend weight with the least rounded MAE.

    The grid 0, 0.15, ... 1 is tried in order; starting from 1.0 only a strictly smaller error replaces it.
    All grid points are conditional averages of one aggregate.
    """
    grid = [0.0, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0]  # fixed values
    blend = lambda a: F.lit(a) * F.col(expert) + F.lit(1.0 - a) * F.col(baseline)
    err = lambda a: F.round(F.avg(F.abs(F.col("rating") - round_half_up(blend(a)))), 12)
    errors = df.groupBy(group).agg(*[err(a).alias(f"e{i}") for i, a in enumerate(grid)])
    best = F.least(*[F.col(f"e{i}") for i in range(len(grid))])
    first = F.coalesce(*[F.when(F.col(f"e{i}") == best, F.lit(a)) for i, a in enumerate(grid)])
    alpha = F.when(F.col(f"e{len(grid) - 1}") == best, F.lit(1.0)).otherwise(first)
    return errors.select(group, alpha.alias("alpha"), best.alias("mae"))


def blend_by_group(df: DataFrame, alphas: DataFrame, expert: str, baseline: str, group: str, out: str) -> DataFrame:
    small = F.broadcast(alphas.select(F.col(group).alias("_g"), F.col("alpha").alias("_a")))  # one row per band
    a = F.coalesce("_a", F.lit(1.0))
    return df.join(small, df[group] == F.col("_g"), "left").withColumn(out, a * F.col(expert) + (1 - a) * F.col(baseline)).drop("_g", "_a")


def known_user_average(known: str, deep: str, gbm: str) -> Column:
    """Average of both models for known users that the deep model scored, the boosted model otherwise."""
    return F.when(F.col(known) & F.col(deep).isNotNull(), (F.col(deep) + F.col(gbm)) / 2).otherwise(F.col(gbm))
