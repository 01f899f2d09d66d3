"""Batch scoring run incrementally: new review files are scored with fitted tables as they arrive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from starloom.functions.buckets import history_band
from starloom.functions.numeric import round_half_up
from starloom.operators.priors import entity_priors, train_scalars
from starloom.plans.selection import tabular_baseline
from starloom.session import durable
from starloom.sources.tables import canonical_reviews


@dataclass
class Scorer:
    global_mean: float
    users: DataFrame
    items: DataFrame


def fit_scorer(train: DataFrame) -> Scorer:
    """Priors of the support-weighted baseline, stored so that every micro-batch joins the same tables."""
    s = train_scalars(train)
    u = entity_priors(train, "user", "user", s).select("user_id", "user_train_count", "user_train_mean")
    i = entity_priors(train, "item", "business", s).select("business_id", "business_train_count", "business_train_mean")
    return Scorer(s["global_mean"], durable(u), durable(i))


def score(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """Stars and history band per review; the same plan serves a table and a stream."""
    df = rows.join(scorer.users, rows["user"] == scorer.users["user_id"], "left")
    df = df.join(scorer.items, df["item"] == scorer.items["business_id"], "left")
    raw = tabular_baseline("user_train_mean", "user_train_count", "business_train_mean", "business_train_count", scorer.global_mean)
    band = history_band(F.coalesce("user_train_count", F.lit(0.0)))
    return df.select("review_id", raw.alias("prediction_raw"), round_half_up(raw).cast("bigint").alias("stars"), band.alias("history_band"))


def score_stream(spark: SparkSession, folder: str, schema: T.StructType, scorer: Scorer, out: str, state: str) -> StreamingQuery:
    """Score all review files in ``folder`` not seen before, exactly once, and stop."""
    rows = canonical_reviews(spark.readStream.schema(schema).parquet(folder))
    return score(rows, scorer).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
