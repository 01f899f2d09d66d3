"""CASE ladders that turn counts, stars and tenures into labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.session import one_row

# Fixed labels of the history bands, in order, with the ordinal code used by the stackers.
BANDS = ["0", "1", "2-5", "6-20", ">20"]
BAND_CODES = {"0": 0.0, "1": 1.0, "2-5": 2.0, "6-20": 6.0, ">20": 20.0}
SHORT_SEGMENTS = {"2": [2], "3": [3], "4": [4], "5": [5], "2-3": [2, 3], "4-5": [4, 5]}


def ladder(x: Column, steps: list[tuple[float, str]], beyond: str, missing: str, inclusive: bool = True) -> Column:
    """The label of the first bound that ``x`` does not exceed (or is below, when not inclusive)."""
    out = F.when(x.isNull() | F.isnan(x.cast("double")), missing)
    for bound, label in steps:
        out = out.when((x <= bound) if inclusive else (x < bound), label)
    return out.otherwise(beyond)


def history_band(count: Column) -> Column:
    return ladder(count, [(0, "0"), (1, "1"), (5, "2-5"), (20, "6-20")], ">20", "0")


def known_history_band(count: Column) -> Column:
    return ladder(count, [(1, "1"), (5, "2-5"), (20, "6-20")], ">20", "1")


def collapsed_band(count: Column) -> Column:
    return ladder(count, [(0, "0"), (1, "1"), (20, "2-20")], ">20", "0")


def support_bucket(count: Column) -> Column:
    steps = [(0, "0"), (1, "1"), (2, "2"), (3, "3"), (5, "4-5"), (10, "6-10"), (20, "11-20")]
    return ladder(count, steps, ">20", "0")


def item_support_bucket(count: Column) -> Column:
    return ladder(count, [(0, "0"), (1, "1"), (5, "2-5"), (20, "6-20")], ">20", "0")


def activity_bucket(reviews: Column) -> Column:
    return ladder(reviews, [(0, "0"), (1, "1"), (5, "2-5"), (20, "6-20"), (100, "21-100")], ">100", "0")


def stars_bucket(stars: Column) -> Column:
    """Used for the reputation of users and for the stars of businesses."""
    steps = [(2.5, "1.0-2.5"), (3.5, "2.5-3.5"), (4.0, "3.5-4.0"), (4.5, "4.0-4.5")]
    return ladder(stars, steps, "4.5-5.0", "__missing__", inclusive=False)


def tenure_bucket(years: Column) -> Column:
    return ladder(years, [(1, "<1y"), (3, "1-3y"), (6, "3-6y")], ">6y", "__missing__", inclusive=False)


def band_code(band: Column) -> Column:
    codes = F.create_map(*[F.lit(v) for pair in BAND_CODES.items() for v in pair])
    return F.coalesce(F.try_element_at(codes, band), F.lit(0.0))


def score_label(z: Column, high: str = "high", low: str = "low", middle: str = "mid") -> Column:
    return F.when(z >= 1, high).when(z <= -1, low).otherwise(middle)


def fixed_edges(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed intervals between ``edges``; the lowest edge is included. Outside gives null."""
    out = F.when(x < edges[0], F.lit(None))
    for bound, label in zip(edges[1:], labels):
        out = out.when(x <= bound, label)
    return out


def bucketed(df: DataFrame, column: str, key: str, edges: list[float], labels: list[str], out: str) -> DataFrame:
    """``df`` with the label of ``column`` between fixed ``edges``; a missing value counts as the median (0 without any).

    Edges that do not rise strictly cannot be used. Then rows are ranked by value and ``key``, and the ranks cut into as many equal parts as there are
    labels, or distinct values if these are fewer. Ranks come from range partitions where the table is long.
    """
    from starloom.operators.skew import before_each_row, quantiles

    median = one_row(quantiles(df, [], column, {"m": 0.5}))["m"]
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0 if median is None else float(median)))
    if all(a < b for a, b in zip(edges, edges[1:])):
        return df.withColumn(out, fixed_edges(value, edges, labels))
    rows = df.withColumns({"_value": value, "_one": F.lit(1)})
    size = one_row(rows.select("_value").groupBy("_value").agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")))
    parts = min(len(labels), max(1, size["distinct"]))
    ranked = before_each_row(rows, [], ["_value", key], {"_before": ("sum", "_one")})
    part = F.greatest(F.ceil(F.coalesce("_before", F.lit(0)) * parts / F.lit(max(size["n"] - 1, 1))), F.lit(1)).cast("int")
    return ranked.withColumn(out, F.element_at(F.array(*[F.lit(x) for x in labels[:parts]]), part)).select(*df.columns, out)


def segment_label(count: Column) -> Column:
    """2-3 and 4-5 for short histories, null otherwise."""
    return F.when(count.between(2, 3), "2-3").when(count.between(4, 5), "4-5")


def short_weight_rows(count: str) -> Column:
    """All overlapping short segments that a history count belongs to, as an array."""
    return F.filter(
        F.array(*[F.when(F.col(count).isin(ns), F.lit(label)) for label, ns in SHORT_SEGMENTS.items()]),
        lambda s: s.isNotNull(),
    )


def quantile_edges(df: DataFrame, column: str, q: int = 4) -> list[float]:
    """Exact quantile edges of a column, duplicates removed; empty when it has no values."""
    from starloom.operators.skew import quantiles

    names = {f"q{i}": i / q for i in range(q + 1)}
    found = one_row(quantiles(df, [], column, names))
    edges = [found[n] for n in names]
    if edges[0] is None:
        return []
    return sorted(set(edges))


def quantile_bucket(x: Column, edges: list[float], prefix: str, q: int = 4) -> Column:
    """Quantile label ``prefix_q1`` and so on.

    No values at all gives "missing" everywhere; merged edges make labels and edges disagree, which is
    answered with "all".
    """
    if not edges:
        return F.lit("missing")
    if len(edges) != q + 1:
        return F.lit("all")
    out = F.when(x.isNull(), "missing")
    for i, bound in enumerate(edges[1:], start=1):
        out = out.when(x <= bound, f"{prefix}_q{i}")
    return out.otherwise("missing")

