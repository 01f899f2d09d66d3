"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists, block by block."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starloom.session import durable, one_row

BLOCK_QUERIES = 2048
BLOCK_CANDIDATES = 8192
FIRST_DEPTH = 32  # list places read before the first look at the threshold


def whole_vectors(df: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and x = floor(``scale`` * component) as array<long>, for the vectors that take part: not null, without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.where(x.isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("long")).alias("x"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as a matrix; shorter vectors end in zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class SortedLists:
    """The candidates of a block, with one list of candidates per dimension, sorted by that component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(self.vectors, axis=0, kind="stable").T  # [dimension, place]
        self.sorted = np.take_along_axis(self.vectors.T, self.lists, axis=1)
        self.doubles = self.vectors.astype(np.float64)
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def top(self, query_id: int | None, query: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """The ``k`` best (score, vec_id), ties to the smaller id, and the list places read.

        Each list is read from its good end: from above where the query's component is positive, from below where it is
        negative; dimensions where it is zero are left out. Every candidate met for the first time is scored in full. The
        search ends when the sum of the components at the places reached, weighted by the query, is below
        the k-th score: no candidate still unmet can reach it. Between two looks the depth doubles.
        """
        size = len(self.ids)
        used = np.flatnonzero(query)
        ascending = query[used] < 0
        seen = np.zeros(size, bool)
        scores = np.zeros(0, np.int64)
        places = np.zeros(0, np.int64)
        exact = float(self.largest) * float(np.abs(query).sum()) < 2.0**53  # then doubles hold every sum exactly
        vectors = self.doubles if exact else self.vectors.astype(object)
        weights = query.astype(np.float64 if exact else object)
        depth, step = 0, FIRST_DEPTH
        if not len(used):
            seen[:] = True
            new = np.arange(size)
            depth = size
        while True:
            if len(used):
                to = min(size, depth + step)
                up = self.lists[used[ascending], depth:to]
                down = self.lists[used[~ascending], size - to : size - depth]
                met = np.zeros(size, bool)
                met[up.ravel()] = True
                met[down.ravel()] = True
                new = np.flatnonzero(met & ~seen)
                seen |= met
                depth, step = to, to
            own = self.ids[new] != query_id if query_id is not None else np.ones(len(new), bool)
            new = new[own]
            places = np.concatenate([places, new])
            scores = np.concatenate([scores, (vectors[new] @ weights).astype(np.int64)])
            if len(scores) > k:
                best = np.lexsort([places, -scores])[:k]
                places, scores = places[best], scores[best]
            if depth >= size:
                break
            if len(scores) == k:
                at = np.where(ascending, self.sorted[used, min(depth, size - 1)], self.sorted[used, max(size - depth - 1, 0)])
                bound = at.astype(weights.dtype) @ weights[used]
                if bound < min(scores):
                    break
        order = np.lexsort([places, -scores])
        return [(int(scores[i]), int(self.ids[places[i]])) for i in order], depth


def _search_block(k: int):
    def run(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(candidates):
            width = max(int(queries["x"].map(len).max()), int(candidates["x"].map(len).max()))
            lists = SortedLists(candidates["vec_id"].to_numpy(), _matrix(candidates["x"], width))
            asked = _matrix(queries["x"], width)
            for query_id, query in zip(queries["vec_id"], asked):
                rows += [(int(query_id), v, s) for s, v in lists.top(int(query_id), query, k)[0]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype("int64")

    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` highest inner products of each query (vec_id, x) among ``candidates`` (vec_id, x), but those with its own id.

    Columns: query_id, rank (int, from 1), vec_id, score; all candidates where there are fewer than ``k``. Ties go to the
    smaller vec_id. Exact. Queries whose vec_id repeats, with equal or different vectors, are answered once per id, by the
    largest vector in sorting order; candidates that repeat compete as rows of their own. Rows with a null vec_id take no
    part. Empty tables give an empty result. Scores beyond 64 bits are an error of the cast.

    Blocks of at most some ``BLOCK_QUERIES`` queries and ``BLOCK_CANDIDATES`` candidates meet in tasks, each pair of
    blocks once; a task sorts its candidates' lists once for all of its queries. The best k of each pair of blocks are
    ranked again: rows shuffled grow with blocks, not with pairs of vectors.
    """
    queries = queries.where("vec_id is not null").groupBy("vec_id").agg(F.max("x").alias("x"))
    candidates = candidates.where("vec_id is not null")
    queries, candidates = durable(queries), durable(candidates)
    many = lambda df: one_row(df.agg(F.count("*").alias("n")))["n"]
    query_blocks, candidate_blocks = max(1, math.ceil(many(queries) / BLOCK_QUERIES)), max(1, math.ceil(many(candidates) / BLOCK_CANDIDATES))
    # every row is dealt evenly to a block, whatever its id, and copied to all blocks of the other side
    block = lambda n: F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("vec_id", "x", block(query_blocks).alias("qb")).withColumn("cb", copies(candidate_blocks))
    offered = candidates.select("vec_id", "x", block(candidate_blocks).alias("cb")).withColumn("qb", copies(query_blocks))
    found = asked.groupBy("qb", "cb").cogroup(offered.groupBy("qb", "cb")).applyInPandas(_search_block(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
