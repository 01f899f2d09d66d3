"""Connected components of an edge table by alternating star operations, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.session import durable, one_row


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = one_row(edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0).cast("long")).alias("x")))
    return row["n"], row["x"]


def connected_components(edges: DataFrame) -> DataFrame:
    """Label (u: node, v: smallest node of its component) of every node but the smallest of each component.

    ``edges`` has long columns u and v; direction and repeats do not matter. Each round hangs the larger neighbours of a node on its
    smallest neighbour (large star), then the smaller ones (small star); stars are the fixed point, reached in a number
    of rounds that grows with the logarithm of the size. Grouped minima are combined before they are shuffled, and the
    joins have one row per node on one side, so that a hub is divided by adaptive execution. Each round is checkpointed.
    """
    now = durable(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = _digest(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = durable(small.select("e.*").where("u <> v").distinct())
        before, seen = seen, _digest(now)
        if before == seen:
            return now
