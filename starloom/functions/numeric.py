"""Column expressions: rounding, clipping, shrinkage, weights and standard scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.session import one_row


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """Limit to [low, high]; an unset bound is left open. Null stays null."""
    kept = x
    if low is not None:
        kept = F.when(x < low, F.lit(float(low))).otherwise(kept)
    if high is not None:
        kept = F.when(x > high, F.lit(float(high))).otherwise(kept)
    return kept


def round_half_up(x: Column) -> Column:
    """Whole stars 1..5, ties up."""
    return clip(F.floor(x + 0.5).cast("double"), 1, 5)


def round_half_even(x: Column) -> Column:
    """Nearest whole number, ties to even."""
    return F.rint(x)


def floor_stars(x: Column) -> Column:
    return clip(F.floor(x).cast("double"), 1, 5)


def ceil_stars(x: Column) -> Column:
    return clip(F.ceil(x).cast("double"), 1, 5)


def number_or(column: str, default: float | None = 0.0) -> Column:
    """The value as a double; text that is no number, NaN and null become ``default``."""
    x = F.col(column).try_cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(default))


def log1p_nonnegative(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def shrunk_mean(mean: Column, count: Column, overall: float, strength: float) -> Column:
    """``(count * mean + strength * overall) / (count + strength)``; no rows gives ``overall``."""
    shrunk = (count * mean + F.lit(strength * overall)) / (count + F.lit(strength))
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(overall)).otherwise(shrunk)


def bayesian_prior(mean: Column, count: Column, overall: float, pseudo_count: float = 5.0) -> Column:
    n = F.coalesce(count.cast("double"), F.lit(0.0))
    m = F.coalesce(mean, F.lit(overall))
    return clip((n * m + F.lit(pseudo_count * overall)) / (n + F.lit(pseudo_count)), 1, 5)


def short_history_weight(count: Column) -> Column:
    """Weight of the short-history expert: ``(6 - count) / 4`` between 0.25 and 0.85."""
    return clip((F.lit(6.0) - count) / 4.0, 0.25, 0.85)


def scale_to_unit(x: Column, low: float, high: float) -> Column:
    return (x - F.lit(low)) / F.lit(high - low)


def scale_from_unit(x: Column, low: float, high: float) -> Column:
    return x * F.lit(high - low) + F.lit(low)


def bad_ratings(df: DataFrame, column: str, top: int, show: int = 10) -> list:
    """Up to ``show`` values that are no whole numbers in 0..top."""
    x = F.col(column)
    wrong = x.isNull() | (F.abs(x - F.rint(x)) > 1e-8) | ~x.between(0, top)
    return [r[0] for r in df.filter(wrong).select(x).distinct().orderBy(x).limit(show).collect()]


def require_whole_ratings(df: DataFrame, column: str, top: int) -> DataFrame:
    wrong = bad_ratings(df, column, top)
    if wrong:
        raise ValueError(f"ratings must be whole numbers from 0 to {top}; found {wrong}")
    return df.withColumn(column, F.rint(column).cast("int"))


def binomial_pmf(p: Column, top: int, eps: float = 1e-10) -> Column:
    """Array of the probabilities of 0..top successes with chance ``p``."""
    p = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.array(
        *[
            F.exp(F.lit(math.lgamma(top + 1) - math.lgamma(r + 1) - math.lgamma(top - r + 1)) + r * F.log(p) + (top - r) * F.log(1 - p))
            for r in range(top + 1)
        ]
    )


def binomial_mode(p: Column, top: int) -> Column:
    """The most probable count; the smaller one of equals."""
    pmf = binomial_pmf(p, top)
    return (F.array_position(pmf, F.array_max(pmf)) - 1).cast("bigint")


def fit_scores(
    df: DataFrame, columns: list[str], fit_on: Column | None = None, smallest: float = 0.0, replaced_by: float | None = None
) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, over the rows where ``fit_on`` holds (all rows if none).

    Without ``replaced_by`` a deviation of zero stays zero and later gives zero scores. With it, deviations
    below ``smallest`` become ``replaced_by``.
    """
    chosen = lambda c: F.col(c) if fit_on is None else F.when(fit_on, F.col(c))
    aggs = [F.avg(chosen(c)).alias(f"{c}|m") for c in columns] + [F.stddev_pop(chosen(c)).alias(f"{c}|s") for c in columns]
    if fit_on is not None:
        aggs.append(F.sum(F.when(fit_on, 1).otherwise(0)).alias("|n"))
    found = one_row(df.agg(*aggs))
    if fit_on is not None and not found["|n"]:
        return fit_scores(df, columns, None, smallest, replaced_by)
    fitted = {}
    for c in columns:
        mean, std = found[f"{c}|m"], found[f"{c}|s"]
        mean, std = (0.0 if mean is None else mean), (0.0 if std is None else std)
        if replaced_by is not None and std < smallest:
            std = replaced_by
        fitted[c] = (mean, std)
    return fitted


def score(column: str, fitted: dict[str, tuple[float, float]]) -> Column:
    mean, std = fitted[column]
    return F.lit(0.0) if std == 0.0 else (F.col(column) - F.lit(mean)) / F.lit(std)


def guarded_std(x: Column) -> Column:
    """Sample deviation, replaced by 1 when undefined or at most 1e-6."""
    return F.when(F.stddev_samp(x) > 1e-6, F.stddev_samp(x)).otherwise(1.0)
