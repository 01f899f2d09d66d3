"""Nearest neighbours by an inverted file: rows lie in the list of their nearest centre, and a query looks into few lists.

The centres come from a bounded sample; every row is listed, and what the probed lists hold is ranked by its exact cosine. ``tuned`` raises the number of
probed lists until the recall against the exact search reaches a bound. ``embeddings.nearest`` is the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import vectors
from starloom.operators.embeddings import nearest
from starloom.operators.skew import top_rows
from starloom.operators.splits import sample_rows
from starloom.session import durable

SAMPLE_ROWS = 50_000  # rows that the centres are fitted to
MOST_LISTS = 4096  # their centres go to every task
MAX_QUERY_ROWS = 20_000  # in a crowd
MAX_ITEM_ROWS = 20_000  # in a piece of a list


def _unit(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), vectors.unit(F.col("embedding").cast("array<double>")).alias("u"))


class InvertedIndex:
    """``lists``: number of lists, by default the square root of the number of rows, at most ``MOST_LISTS``."""

    def __init__(self, lists: int | None = None, sample: int = SAMPLE_ROWS, seed: int = 42):
        self.lists, self.sample, self.seed = lists, sample, seed

    def fit(self, items: DataFrame, key: str) -> "InvertedIndex":
        rows = durable(_unit(items.where("embedding is not null"), key))
        n = rows.count()
        lists = min(self.lists or max(1, int(np.sqrt(n))), MOST_LISTS)
        some = sample_rows(rows, F.col("id"), self.sample, self.seed)
        model = KMeans(k=max(2, lists), seed=self.seed, maxIter=10, featuresCol="f").fit(durable(some.select(array_to_vector("u").alias("f")))) if n > 1 else None
        centers = np.array(model.clusterCenters()) if model else np.ones((1, 1 if not n else len(rows.first()["u"])))
        self.centers = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        listed = self._nearest_lists(rows, 1)
        # a long list is cut by a hash, so that no task has to hold it whole
        sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / MAX_ITEM_ROWS).cast("int").alias("pieces"))
        self.pieces = durable(sizes)
        self.items = durable(listed.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), "id", "u"))
        return self

    def _nearest_lists(self, rows: DataFrame, probes: int) -> DataFrame:
        """``rows`` (id, u) once for each of the ``probes`` lists with the nearest centres."""
        centers, probes = self.centers, min(probes, len(self.centers))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    close = np.stack(part.column("u").to_pylist()) @ centers.T
                    best = np.argpartition(-close, probes - 1, axis=1)[:, :probes]
                    rows = np.repeat(np.arange(part.num_rows), probes)
                    yield pa.RecordBatch.from_arrays([pa.array(best.ravel().astype(np.int32)), part.column("id").take(pa.array(rows)), part.column("u").take(pa.array(rows))], ["list", "id", "u"])

        return rows.mapInArrow(run, "list int, id string, u array<double>")

    def search(self, queries: DataFrame, key: str, k: int, probes: int) -> DataFrame:
        """anchor, neighbour, cosine, rank: the best ``k`` of the ``probes`` nearest lists, the query's own id left out."""

        def best(_, asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(offered):
                return pd.DataFrame({"anchor": [], "neighbour": [], "cosine": []}).astype({"anchor": str, "neighbour": str, "cosine": float})
            offered = offered.sort_values("id", kind="stable")
            ids, matrix = offered["id"].to_numpy(dtype=object), np.stack(offered["u"].to_numpy())
            take, parts = min(k + 1, len(ids)), []
            for at in range(0, len(asked), 1_000):
                some = asked.iloc[at : at + 1_000]
                cos = np.stack(some["u"].to_numpy()) @ matrix.T
                top = np.argsort(-np.round(cos, 12), axis=1, kind="stable")[:, :take]
                parts.append(pd.DataFrame({"anchor": np.repeat(some["id"].to_numpy(dtype=object), take), "neighbour": ids[top].ravel(), "cosine": np.take_along_axis(cos, top, axis=1).ravel()}))
            return pd.concat(parts)

        asked = self._nearest_lists(_unit(queries.where("embedding is not null"), key), probes).join(F.broadcast(self.pieces), "list")
        crowds = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / MAX_QUERY_ROWS).cast("int").alias("crowds"))  # many queries of one list
        asked = asked.join(F.broadcast(crowds), "list").withColumn("crowd", F.pmod(F.xxhash64("id"), F.col("crowds")).cast("int"))
        asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("list", "piece", "crowd", "id", "u")
        offered = self.items.join(F.broadcast(crowds), "list").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).select("list", "piece", "crowd", "id", "u")
        by = ["list", "piece", "crowd"]
        found = asked.groupBy(*by).cogroup(offered.groupBy(*by)).applyInPandas(best, "anchor string, neighbour string, cosine double")
        return top_rows(found.where("anchor <> neighbour"), ["anchor"], [F.round("cosine", 12).desc(), F.col("neighbour")], k)

    def recall(self, queries: DataFrame, items: DataFrame, key: str, k: int, probes: int) -> float:
        """Share of the exact ``k`` nearest that the index finds, for all ``queries``."""
        exact = durable(nearest(queries, items, key, k).select("anchor", "neighbour"))
        found = self.search(queries, key, k, probes).select("anchor", "neighbour")
        return exact.join(found, ["anchor", "neighbour"]).count() / max(exact.count(), 1)

    def tuned(self, items: DataFrame, key: str, k: int, least: float = 0.9, queries: int = 500) -> int:
        """The number of probes, doubled from one, that reaches a recall of ``least`` on a sample of ``queries`` rows; all lists at last."""
        some = durable(sample_rows(items.where("embedding is not null"), F.col(key), queries, self.seed + 1))
        probes = 1
        while probes < len(self.centers) and self.recall(some, items, key, k, probes) < least:
            probes *= 2
        return min(probes, len(self.centers))
