"""Operators that stay balanced when one key holds a large part of all rows.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. The functions here first count
rows per key (a map-side combined aggregate). When no key is over the task limit, the plain window is
used. Otherwise the rows of long keys are range-partitioned by key and sort order, the pieces are processed in
parallel, and what a piece needs from the pieces before it is carried over. The pieces are stored once, so
that every later use reads them, and chained calls do not multiply the work. Where a group is
divided does not change results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.session import durable, one_row

DEFAULT_ROWS_PER_TASK = 2_000_000
CHUNK = "_chunk"


def rows_per_task(spark) -> int:
    """How many rows of one group a single task may take (``spark.starloom.rowsPerTask``)."""
    return int(spark.conf.get("spark.starloom.rowsPerTask", str(DEFAULT_ROWS_PER_TASK)))


def small_enough_to_broadcast(df: DataFrame, max_rows: int = 200_000) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def maybe_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint behind a check of the size; beyond it the join strategy is left to Spark."""
    return F.broadcast(df) if small_enough_to_broadcast(df, max_rows) else df


def pin_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A fitted lookup table as constants of the plan, with a broadcast hint, if it has at most ``max_rows`` rows.

    It is then computed once and joined without moving the other side. A larger table is returned as it is,
    and Spark picks the join.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality on all ``keys``."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True))


def long_keys(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The keys with more than ``limit`` rows and their counts, as a table (at most rows / ``limit`` of them)."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")) if keys else df.agg(F.count(F.lit(1)).alias("_rows"))
    return durable(counted.filter(F.col("_rows") > limit))


def has_long_keys(df: DataFrame, keys: list[str]) -> bool:
    return not long_keys(df, keys, rows_per_task(df.sparkSession)).isEmpty()


def divide_long_groups(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame | None, DataFrame] | None:
    """The rows of ordinary keys, and the stored rows of long keys with a ``_chunk`` number that grows with ``order``.

    None if no key is long. Without ``keys`` all rows are one group, and there are no ordinary ones. ``order`` must
    identify a row inside its key, so that any amount of ties can be divided. A key's chunks are the range partitions
    it lies in, so their numbers need not start at 0.
    """
    limit = rows_per_task(df.sparkSession)
    found = long_keys(df, keys, limit)
    total = one_row(found.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")))["n"]
    if not total:
        return None
    rest, hot = None, df
    if keys:
        named = found.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
        match = reduce(lambda a, b: a & b, [df[k].eqNullSafe(named[f"_hot_{k}"]) for k in keys])
        rest, hot = df.join(named, match, "left_anti"), df.join(named, match, "left_semi")
    pieces = max(2, -(-2 * total // limit))
    ranged = hot.repartitionByRange(pieces, *[F.col(c).asc_nulls_first() for c in [*keys, *order]])
    return rest, durable(ranged.withColumn(CHUNK, F.spark_partition_id()))


_WINDOW = {"sum": F.sum, "min": F.min, "max": F.max}


def _combine(kind: str, before: Column, inside: Column) -> Column:
    if kind == "sum":
        both_missing = before.isNull() & inside.isNull()
        total = F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))
        return F.when(~both_missing, total)
    return F.least(before, inside) if kind == "min" else F.greatest(before, inside)


def before_each_row(
    df: DataFrame, keys: list[str], order: list[str], aggregates: dict[str, tuple[str, str]], check: bool = True
) -> DataFrame:
    """Running aggregates over the rows of the same key strictly before each row.

    ``aggregates`` maps an output column to ``(kind, input column)`` with kind sum, min or max. ``check`` is
    False only where the caller has already found that no key is long.
    """
    return _running(df, keys, order, aggregates, end=-1, check=check)


def up_to_each_row(
    df: DataFrame, keys: list[str], order: list[str], aggregates: dict[str, tuple[str, str]]
) -> DataFrame:
    """As ``before_each_row``, with the row itself included."""
    return _running(df, keys, order, aggregates, end=0)


def _running(df, keys, order, aggregates, end, check=True):
    def framed(rows, group):
        w = Window.partitionBy(*[F.col(k) for k in group]).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
        return rows.withColumns({out: _WINDOW[k](c).over(w) for out, (k, c) in aggregates.items()})

    divided = divide_long_groups(df, keys, order) if check else None
    if divided is None:
        return framed(df, keys)
    rest, hot = divided
    group = [*keys, CHUNK]
    inside = framed(hot, group)
    totals = hot.groupBy(*group).agg(*[_WINDOW[k](c).alias(out) for out, (k, c) in aggregates.items()])
    cw = Window.partitionBy(*[F.col(k) for k in keys]).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(g).alias(f"_k_{g}") for g in group],
        *[_WINDOW[k](out).over(cw).alias(f"_before_{out}") for out, (k, _) in aggregates.items()],
    )
    match = reduce(lambda a, b: a & b, [inside[g].eqNullSafe(carried[f"_k_{g}"]) for g in group])
    combined = {out: _combine(k, F.col(f"_before_{out}"), F.col(out)) for out, (k, _) in aggregates.items()}
    whole = inside.join(carried, match, "left").withColumns(combined).select(*df.columns, *aggregates)
    return whole if rest is None else framed(rest, keys).select(*df.columns, *aggregates).unionByName(whole)


def last_rows_before(
    df: DataFrame, keys: list[str], order: list[str], event: Column, n: int, out: str, check: bool = True
) -> DataFrame:
    """An array of the last ``n`` events of the same key strictly before each row, oldest first."""

    def framed(rows, group):
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-n, -1)
        return rows.withColumn(out, F.collect_list(event).over(w))

    divided = divide_long_groups(df, keys, order) if check else None
    if divided is None:
        return framed(df, keys)
    rest, hot = divided
    group = [*keys, CHUNK]
    inside = framed(hot, group)
    back = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    tails = (
        hot.withColumn("_event", event)
        .withColumn("_back", F.row_number().over(back))
        .filter(F.col("_back") <= n)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("p"), F.col("_event").alias("e")))).alias("_tail"))
    )
    # every chunk holds a row, so the n chunks before this one hold at least n events
    cw = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(-n, -1)
    carried = (
        tails.withColumn("_lists", F.collect_list(F.transform("_tail", lambda t: t["e"])).over(cw))
        .select(*[F.col(g).alias(f"_k_{g}") for g in group], F.flatten("_lists").alias("_carried"))
        .filter(F.size("_carried") > 0)
    )
    match = reduce(lambda a, b: a & b, [inside[g].eqNullSafe(carried[f"_k_{g}"]) for g in group])
    both = F.when(F.col("_carried").isNull(), F.col(out)).otherwise(F.concat("_carried", out))
    joined = inside.join(carried, match, "left").withColumn("_both", both)
    size = F.size("_both")
    last = F.slice("_both", F.greatest(size - n + 1, F.lit(1)), F.least(size, F.lit(n)))
    whole = joined.withColumn(out, last).select(*df.columns, out)
    return whole if rest is None else framed(rest, keys).select(*df.columns, out).unionByName(whole)


def top_rows(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key. Spark drops rows past ``k`` before the shuffle, per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def quantiles(
    df: DataFrame, by: list[str], value: str, probabilities: dict[str, float], few_values: bool = False
) -> DataFrame:
    """Exact interpolated quantiles per group, computed from counts of distinct values.

    ``few_values`` says that a group has few distinct values by nature (such as counts per entity).
    Otherwise groups with more distinct values than a task may hold are ranked in pieces.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    if few_values or not has_long_keys(counted, by):
        aggs = [F.expr(f"percentile(`{value}`, {p}D, _n)").alias(name) for name, p in probabilities.items()]
        return counted.groupBy(*by).agg(*aggs) if by else counted.agg(*aggs)
    ranked = before_each_row(counted, by, [value], {"_below": ("sum", "_n")}).withColumn(
        "_below", F.coalesce("_below", F.lit(0))
    )
    totals = counted.groupBy(*[F.col(k).alias(f"_t_{k}") for k in by]).agg(F.sum("_n").alias("_total"))
    match = reduce(lambda a, b: a & b, [ranked[k].eqNullSafe(totals[f"_t_{k}"]) for k in by], F.lit(True))
    rows = ranked.join(totals, match, "inner")
    aggs = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_total") - 1)
        lower, upper = F.floor(position), F.ceil(position)
        holds = lambda r: (F.col("_below") <= r) & (r < F.col("_below") + F.col("_n"))
        at_lower = F.max(F.when(holds(lower), F.col(value)))
        at_upper = F.max(F.when(holds(upper), F.col(value)))
        share = F.max(position - lower)
        aggs.append((at_lower + (at_upper - at_lower) * share).alias(name))
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
