"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))


def unit(a: Column) -> Column:
    """Length one; a zero vector stays zero."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length == 0, x).otherwise(x / length))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def sum_vectors(vector: Column, n: int, weight: Column | None = None) -> Column:
    """Element-wise sum over a group, combined on the map side; use inside ``agg``."""
    part = lambda i: vector[i] if weight is None else vector[i] * weight
    return F.array(*[F.sum(part(i)) for i in range(n)])


def mean_vectors(vector: Column, n: int) -> Column:
    return F.array(*[F.avg(vector[i]) for i in range(n)])


def pair_features(user: Column, item: Column, history_log1p: Column) -> dict[str, Column]:
    """Cosine, dot product, both lengths, their gap and the history size."""
    nu, ni, d = norm(user), norm(item), dot(user, item)
    return {
        "cosine": d / F.greatest(nu * ni, F.lit(1e-8)),
        "dot": d,
        "user_norm": nu,
        "item_norm": ni,
        "norm_gap": F.abs(nu - ni),
        "history_log1p": history_log1p,
    }
