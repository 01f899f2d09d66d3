"""Reproducible global shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.session import durable, one_row

PRIME = 2147483647  # 2^31 - 1: products of two residues stay below 2^62
ROUNDS = 6


def global_row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """Number the rows of ``df`` from 0 without gaps by the ``order`` columns (nulls first), without one task seeing all rows.

    Rows that tie in all of ``order`` get neighbouring numbers in the order in which they were read; where ``order``
    holds all columns, such rows are alike and the result does not depend on it. Only the columns of ``df`` travel,
    so keep it narrow. Tied rows are spread over range partitions too, since the read order is the last sort key.
    """
    spark = df.sparkSession
    at, place = "__at", "__place"
    keyed = df.withColumn(at, F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*[F.col(f"`{c}`").asc_nulls_first() for c in order], F.col(at)).sortWithinPartitions(
        *[F.col(f"`{c}`").asc_nulls_first() for c in order], F.col(at)
    )
    placed = durable(ranged.drop(at).withColumn(place, F.monotonically_increasing_id()))  # partition << 33 | row within it
    partition, within = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(partition.alias("__part")).count().collect()  # one number per range partition
    first, starts = 0, []
    for part, rows in sorted((r["__part"], r["count"]) for r in counts):
        starts.append((part, first))
        first += rows
    offsets = spark.createDataFrame(starts, "__part long, __first long")
    return placed.withColumn("__part", partition).join(F.broadcast(offsets), "__part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__first") + within).alias(name))


def whole(x: Column, divisor: int) -> Column:
    """Exact whole-number quotient of a long, without the detour over doubles."""
    return F.call_function("div", x, F.lit(divisor).cast("long"))


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """Multiplier, addend and shift of each round, below ``PRIME``, by a linear congruence from ``seed``."""
    keys, state = [], seed % PRIME
    for _ in range(ROUNDS):
        key = []
        for _ in range(3):
            state = (state * 48271 + 11) % PRIME
            key.append(1 + state % (PRIME - 1))
        keys.append(tuple(key))
    return keys


def feistel(x: Column, rows: int, seed: int) -> Column:
    """A permutation of 0 .. ``rows`` - 1, seeded; ``x`` in that range.

    The number is split into a pair (left, right) of the domain a x b, the least such square-like domain that holds
    ``rows``; each round adds a keyed quadratic residue of one half to the other, modulo that half's size. Results
    outside the range walk on along their cycle. At most a x b - rows numbers lie outside, fewer than a, so a walk
    that meets them all is bounded by that; 64 steps leave a chance below (1/64)^64 where the bound is larger, and an
    unfinished walk is an error, never a wrong number.
    """
    if rows <= 1:
        return F.lit(0).cast("long")
    a = math.isqrt(rows - 1) + 1
    b = -(-rows // a)
    keys = round_keys(seed)

    def residue(v: Column, key: tuple[int, int, int]) -> Column:
        multiplier, addend, shift = (F.lit(k).cast("long") for k in key)
        return ((v * multiplier + addend) % PRIME) * ((v + shift) % PRIME) % PRIME

    def rounded(state: Column, left: bool, key: tuple[int, int, int]) -> Column:
        """One round; the state is bound once, so that the expression stays linear in the rounds."""
        if left:
            step = lambda s: F.struct(((s["l"] + residue(s["r"], key)) % a).alias("l"), s["r"].alias("r"))
        else:
            step = lambda s: F.struct(s["l"].alias("l"), ((s["r"] + residue(s["l"], key)) % b).alias("r"))
        return F.transform(F.array(state), step)[0]

    def once(y: Column) -> Column:
        state = F.struct(whole(y, b).alias("l"), (y % b).alias("r"))
        for i, key in enumerate(keys):
            state = rounded(state, i % 2 == 0, key)
        return F.transform(F.array(state), lambda s: s["l"] * b + s["r"])[0]

    walks = min(a * b - rows, 64)
    number = once(x.cast("long"))
    if walks:
        number = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), number, lambda y, _: F.when(y < rows, y).otherwise(once(y)))
    return F.transform(F.array(number), lambda y: F.when(y < rows, y).otherwise(F.raise_error(F.lit("cycle walk did not end"))))[0]


def shuffle_into_shards(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """Add ``row_number``, ``place``, ``shard`` and ``slot`` to the rows of ``df``.

    ``place`` is the Feistel image of the row number; shard = place % ``shards`` and slot = place div ``shards``, so
    shards differ by one row at most, slots have no gaps, and both can be computed from the row number alone.
    An empty table gives an empty table. Columns of ``df`` with these four names are replaced.
    """
    df = df.drop("row_number", "place", "shard", "slot")
    numbered = global_row_numbers(df, order)
    rows = one_row(numbered.agg(F.count("*").alias("n")))["n"]
    placed = numbered.withColumn("place", feistel(F.col("row_number"), rows, seed))
    return placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", whole(F.col("place"), shards))


def shard_documents(documents: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """Deal documents into shards by the law ``rows``: counts at most one apart.

    One row per row of ``documents`` (repeated rows included): doc_id, size (UTF-8 bytes of the text plus 8), text_crc32,
    law, shard, slot, grown_shard (null: this law does not name one). A null text counts as no bytes; a null doc_id
    sorts first. Rows are numbered by doc_id, checksum and size; the texts themselves are never shuffled.
    """
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    narrow = documents.select("doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = shuffle_into_shards(narrow, ["doc_id", "text_crc32", "size"], shards, seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
