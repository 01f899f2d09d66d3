"""Health and structure of embedding spaces: norms, neighbours, centroids, consistency, clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions import vectors
from starloom.operators.skew import quantiles, top_rows
from starloom.session import durable, one_row


def width_of(df: DataFrame, column: str = "embedding") -> int:
    return df.select(F.size(column).alias("w")).first()["w"]


def top_categories(df: DataFrame, column: str, at_least: int, n: int) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= at_least)
    return counts.orderBy(F.col("n").desc(), column).limit(n)


def dominant_category(train: DataFrame, business_categories: DataFrame) -> DataFrame:
    """The category each user reviews most; ties by name."""
    joined = train.join(business_categories, train["item"] == business_categories["business_id"], "left")
    counts = joined.groupBy("user", F.coalesce("macro_category", F.lit("Other")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    best = top_rows(counts, ["user"], [F.col("n").desc(), F.col("c")], 1)
    return best.select(F.col("user").alias("user_id"), F.col("c").alias("dominant_macro_category"), F.col("n").alias("dominant_macro_count"))


def dense_health(df: DataFrame) -> DataFrame:
    """Rows, width, norm statistics, zero norms, dead dimensions and explained variance, over all rows.

    The mean cosine of all pairs needs no pairs: it follows from the length of the sum of unit vectors.
    """
    width = width_of(df)
    rows = df.select("embedding", vectors.norm(F.col("embedding")).alias("norm"), vectors.unit(F.col("embedding")).alias("u"))
    e, u = F.col("embedding"), F.col("u")
    f = one_row(
        rows.agg(
            F.count(F.lit(1)).alias("n"), F.avg("norm").alias("m"), F.stddev_pop("norm").alias("s"), F.sum((F.col("norm") < 1e-8).cast("bigint")).alias("zero"),
            F.array(*[F.var_pop(e[i]) for i in range(width)]).alias("var"), vectors.sum_vectors(u, width).alias("sum"), F.sum(vectors.dot(u, u)).alias("self"),
        )
    )
    n = f["n"]
    total = float(np.dot(f["sum"], f["sum"]))
    q = one_row(quantiles(rows, [], "norm", {"p05": 0.05, "p50": 0.5, "p95": 0.95}))
    row = {
        "n_rows": n, "n_dims": width, "norm_mean": f["m"], "norm_std": f["s"], "norm_p05": q["p05"], "norm_p50": q["p50"], "norm_p95": q["p95"],
        "zero_norm_count": f["zero"], "dead_dimension_count": int(sum(v < 1e-8 for v in f["var"])),
        "pair_cosine_mean": (total - f["self"]) / (n * (n - 1)) if n > 1 else 0.0,
    }
    return df.sparkSession.createDataFrame([row])


def explained_variance(df: DataFrame, k: int = 8) -> list[float]:
    rows = df.select(array_to_vector("embedding").alias("v"))
    return [float(x) for x in PCA(k=k, inputCol="v", outputCol="p").fit(rows).explainedVariance]


def pca(df: DataFrame, key: str, k: int, column: str = "embedding", out: str = "pca") -> DataFrame:
    """Principal components of the centred vectors. Spark's transform does not centre, so that is done here."""
    width = width_of(df, column)
    mean = one_row(df.agg(vectors.mean_vectors(F.col(column), width).alias("m")))["m"]
    centred = F.zip_with(column, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)
    rows = df.select(key, array_to_vector(centred).alias("_v"))
    model = PCA(k=min(k, width), inputCol="_v", outputCol="_p").fit(rows)
    return model.transform(rows).select(key, vector_to_array("_p").alias(out))


def sparse_health(long: DataFrame, key: str, n_dims: int) -> DataFrame:
    """Density, values per row and norms of a matrix in long form."""
    rows = long.groupBy(key).agg(F.count(F.lit(1)).alias("nnz"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    row = one_row(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("nnz").alias("_n"), F.avg("nnz").alias("row_nnz_mean"), F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std")))
    row["n_dims"] = n_dims
    row["density"] = row.pop("_n") / (row["n_rows"] * n_dims)
    row.update(one_row(quantiles(rows, [], "nnz", {"row_nnz_p50": 0.5, "row_nnz_p95": 0.95}, few_values=True)))
    row.update(one_row(quantiles(rows, [], "norm", {"norm_p05": 0.05, "norm_p50": 0.5, "norm_p95": 0.95})))
    return long.sparkSession.createDataFrame([row])


MAX_QUERY_ROWS = 50_000
MAX_ITEM_ROWS = 50_000
LEAST_QUERY_ROWS = 1_000
CENTROID_BLOCK = 1_000
QUERY_STEP, ITEM_STEP = 256, 2_048  # shape of the matrix of cosines that a task holds


def _best_places(queries: np.ndarray, items: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item place and cosine of the best ``take`` items of each query, by cosine to 12 digits, ties to the smaller place.

    The items are gone through in steps; after the first, only cosines that reach the worst kept one of their query are looked at.
    """
    row, place, cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    worst = np.full(len(queries), -np.inf)
    for at in range(0, len(items), ITEM_STEP):
        found = queries @ items[at : at + ITEM_STEP].T
        if not np.isfinite(found).all():
            found = np.where(np.isnan(found), -np.inf, found)  # comes last
        if at == 0 and found.shape[1] > take:
            worst = np.partition(found, -take, axis=1)[:, -take]
        r, c = np.nonzero(found >= (worst - 2e-12)[:, None])
        row, place, cos = np.concatenate([row, r]), np.concatenate([place, c + at]), np.concatenate([cos, found[r, c]])
        order = np.lexsort((place, -np.round(cos, 12), row))
        row, place, cos = row[order], place[order], cos[order]
        starts = np.searchsorted(row, np.arange(len(queries)))
        kept = np.arange(len(row)) - starts[row] < take
        row, place, cos = row[kept], place[kept], cos[kept]
        full = np.bincount(row, minlength=len(queries)) == take
        ends = np.searchsorted(row, np.arange(len(queries)), side="right") - 1
        worst = np.where(full, np.round(cos[np.maximum(ends, 0)], 12), -np.inf)
    return row, place, np.where(cos == -np.inf, np.nan, cos)


def _nearest_in_block(k: int):
    """The best ``k`` + 1 items of one block for each query of another; ties go to the smaller id."""

    def best(key, queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(items):
            return pd.DataFrame({"anchor": [], "neighbour": [], "cosine": []}).astype({"anchor": str, "neighbour": str, "cosine": float})
        items = items.sort_values("id", kind="stable")
        ids, vectors_, parts = items["id"].to_numpy(dtype=object), np.stack(items["u"].to_numpy()), []
        for at in range(0, len(queries), QUERY_STEP):
            some = queries.iloc[at : at + QUERY_STEP]
            row, place, cos = _best_places(np.stack(some["u"].to_numpy()), vectors_, min(k + 1, len(ids)))
            parts.append(pd.DataFrame({"anchor": some["id"].to_numpy(dtype=object)[row], "neighbour": ids[place], "cosine": cos}))
        return pd.concat(parts)

    return best


def nearest(queries: DataFrame, items: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` most similar items (cosine) of each query row, itself left out: ``anchor, neighbour, cosine, rank``.

    Blocks of bounded numbers of queries and of items meet in tasks, each pair of blocks once; a task multiplies them step by step and keeps
    ``k`` per query, and the partial lists are merged by a top-k window. Few queries are dealt into smaller blocks, so that all cores
    have some. No vector passes through the driver.
    """
    unit = lambda df: df.select(F.col(key).cast("string").alias("id"), vectors.unit(F.col("embedding")).alias("u"))
    asked, offered = durable(unit(queries)), durable(unit(items))
    n, item_blocks = asked.count(), max(1, -(-offered.count() // MAX_ITEM_ROWS))
    shares = -(-4 * queries.sparkSession.sparkContext.defaultParallelism // item_blocks)
    query_blocks = max(1, -(-n // MAX_QUERY_ROWS), min(shares, -(-n // LEAST_QUERY_ROWS)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_q", block(query_blocks)).withColumn("_i", copies(item_blocks))
    right = offered.withColumn("_i", block(item_blocks)).withColumn("_q", copies(query_blocks))
    found = left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInPandas(_nearest_in_block(k), "anchor string, neighbour string, cosine double")
    return top_rows(found.filter(F.col("anchor") != F.col("neighbour")), ["anchor"], [F.round("cosine", 12).desc(), F.col("neighbour")], k)


def neighbour_coherence(neighbours: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Per anchor the share of neighbours with its category and its city, and the entropy of their categories."""
    l = lambda n: labels.select(F.col("id").alias(f"_{n}"), F.col("category").alias(f"{n}_category"), F.col("city").alias(f"{n}_city"))
    a, b = l("a"), l("b")
    rows = neighbours.join(a, neighbours["anchor"] == a["_a"]).join(b, neighbours["neighbour"] == b["_b"])
    per = rows.groupBy("anchor", "a_category", "b_category").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a_city") == F.col("b_city")).cast("bigint")).alias("city"))
    p = F.col("n") / F.lit(float(k))
    return per.groupBy("anchor", F.col("a_category").alias("anchor_category")).agg(
        (F.sum(F.when(F.col("a_category") == F.col("b_category"), F.col("n")).otherwise(0)) / k).alias("same_category_ratio"),
        (F.sum("city") / k).alias("same_city_ratio"), F.sum(-p * F.log(p + 1e-12)).alias("category_entropy"),
    )


def coherence_summary(coherence: DataFrame, by: str | None = None) -> DataFrame:
    means = [F.avg(c).alias(c) for c in ("same_category_ratio", "same_city_ratio", "category_entropy")]
    return coherence.groupBy(by).agg(*means) if by else coherence.agg(*means)


def centroid_similarity(df: DataFrame, label: str, labels: list[str] | None = None) -> DataFrame:
    """Cosine between the mean unit vectors of every two of ``labels`` (all labels by default).

    Centroids come from one aggregate and stay a table. Their pairs are the result itself; each centroid meets the
    others through blocks, so that no side has to fit into one task.
    """
    width = width_of(df)
    rows = df.filter(F.col(label).isin(labels)) if labels else df
    rows = rows.filter(F.col(label).isNotNull())
    means = rows.groupBy(F.col(label).cast("string").alias("name")).agg(vectors.mean_vectors(vectors.unit(F.col("embedding")), width).alias("m"))
    centroids = durable(means.select("name", vectors.unit(F.col("m")).alias("m")))
    blocks = max(1, -(-centroids.count() // CENTROID_BLOCK))
    block = F.pmod(F.xxhash64("name"), F.lit(blocks))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    first = centroids.select(F.col("name").alias("first"), F.col("m").alias("_a"), block.alias("_p")).withColumn("_q", copies)
    second = centroids.select(F.col("name").alias("second"), F.col("m").alias("_b"), block.alias("_q")).withColumn("_p", copies)
    return first.join(second, ["_p", "_q"]).select("first", "second", vectors.dot(F.col("_a"), F.col("_b")).alias("cosine"))


def neighbour_overlap(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Mean share of neighbours that two spaces have in common."""
    both = first.join(second, ["anchor", "neighbour"], "inner").groupBy("anchor").agg((F.count(F.lit(1)) / k).alias("o"))
    anchors = first.select("anchor").distinct()
    return anchors.join(both, "anchor", "left").agg(F.avg(F.coalesce("o", F.lit(0.0))).alias("neighbour_overlap_mean"), F.count(F.lit(1)).alias("n_anchors"))


def distance_correlation(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Correlation of the cosine distances of the same pairs in two spaces."""
    def of(space, name):
        a = space.select(F.col("id").alias("_a"), F.col("embedding").alias("_x"))
        b = space.select(F.col("id").alias("_b"), F.col("embedding").alias("_y"))
        j = pairs.join(a, pairs["left"] == a["_a"]).join(b, pairs["right"] == b["_b"])
        return j.select("left", "right", (1 - vectors.cosine(F.col("_x"), F.col("_y"))).alias(name))

    return of(first, "d1").join(of(second, "d2"), ["left", "right"]).agg(F.corr("d1", "d2").alias("pairwise_corr"), F.count(F.lit(1)).alias("n_pairs"))


def cluster_population(df: DataFrame, key: str, clusters: int, components: int = 32, seed: int = 42) -> tuple[DataFrame, float]:
    """K-means labels on principal components of unit vectors, and their silhouette."""
    unit = durable(df.select(key, vectors.unit(F.col("embedding")).alias("embedding")))
    points = durable(pca(unit, key, components).select(key, array_to_vector("pca").alias("features")))
    model = KMeans(k=clusters, seed=seed).fit(points)
    labelled = durable(model.transform(points).select(key, F.col("prediction").alias("cluster_id"), "features"))
    silhouette = float("nan")
    if labelled.select("cluster_id").distinct().limit(2).count() > 1:
        silhouette = ClusteringEvaluator(predictionCol="cluster_id").evaluate(labelled)
    return labelled.select(key, "cluster_id"), silhouette


def cluster_profiles(users: DataFrame) -> DataFrame:
    """Size, typical history and metadata, dominant category and a label per cluster."""
    z = (F.col("metadata__fans_log1p_z") + F.col("metadata__useful_log1p_z") + F.col("metadata__cool_log1p_z")) / 3
    rows = users.withColumn("_z", z)
    base = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_users"), F.avg("metadata__tenure_days").alias("tenure_mean"), F.avg("metadata__elite_any").alias("elite_rate"),
        F.avg("metadata__fans_log1p_z").alias("fans_mean_z"), F.avg("_z").alias("social_capital_mean_z"),
    )
    median = quantiles(rows, ["cluster_id"], "history_count", {"history_median": 0.5}, few_values=True)
    counts = rows.groupBy("cluster_id", F.coalesce("dominant_macro_category", F.lit("No history")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    top = top_rows(counts, ["cluster_id"], [F.col("n").desc(), F.col("c")], 1).select("cluster_id", F.col("c").alias("dominant_macro"), F.col("n").alias("dominant_macro_support"))
    out = base.join(median, "cluster_id").join(top, "cluster_id")
    activity = F.when(F.col("history_median") >= 8, "very active").when(F.col("history_median") >= 3, "active").otherwise("light")
    social = F.when(F.col("social_capital_mean_z") >= 2, "well known").otherwise("low profile")
    return out.withColumn("cluster_label", F.concat_ws(" | ", "dominant_macro", activity, social))


def archetype_descriptors(profiles: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Scores of the profile columns over all archetypes, and high, mid or low labels for them."""
    from starloom.functions import numeric
    from starloom.functions.buckets import score_label

    fitted = numeric.fit_scores(profiles, columns)
    return profiles.select(
        key, *[numeric.score(c, fitted).alias(f"{c}_z") for c in columns], *[score_label(numeric.score(c, fitted)).alias(f"{c}_label") for c in columns]
    )
