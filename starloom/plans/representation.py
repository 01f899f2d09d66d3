"""The business representation: feature blocks, numbered features, summaries and integrity checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.operators import encoders
from starloom.operators.priors import train_aggregates
from starloom.operators.skew import maybe_broadcast
from starloom.session import durable, one_row
from starloom.sources import tables

VIEWS = {"content": ["geo", "categories", "attributes", "hours"], "prior": ["priors"], "full": encoders.BLOCKS}


@dataclass
class Representation:
    """Long matrix ``business_id, feature_index, value``, feature metadata and the clean business table."""

    businesses: DataFrame
    matrix: DataFrame
    features: DataFrame

    def select(self, view: str | None = None, blocks: list[str] | None = None) -> DataFrame:
        """The cells of a view (content, prior, full) or of named blocks."""
        wanted = blocks if blocks is not None else VIEWS[view or "full"]
        f = maybe_broadcast(self.features.filter(F.col("block_name").isin(wanted)).select("feature_index"))
        return self.matrix.join(f, "feature_index", "left_semi")

    def block_summary(self) -> DataFrame:
        """Width, offsets and share of businesses with a value, per block."""
        n = one_row(self.businesses.agg(F.count(F.lit(1)).alias("n")))["n"]
        f = maybe_broadcast(self.features.select("feature_index", "block_name"))
        filled = self.matrix.join(f, "feature_index").groupBy("block_name", "business_id").agg(F.count(F.lit(1)).alias("k"))
        coverage = filled.groupBy(F.col("block_name").alias("_b")).agg((F.count(F.lit(1)) / n).alias("coverage"), F.sum("k").alias("n_cells"))
        widths = self.features.groupBy("block_name").agg(F.count(F.lit(1)).alias("n_columns"), F.min("feature_index").alias("start_index"))
        rows = widths.join(coverage, widths["block_name"] == coverage["_b"], "left").drop("_b")
        return rows.withColumns({"end_index_exclusive": F.col("start_index") + F.col("n_columns"), "coverage": F.coalesce("coverage", F.lit(0.0)), "n_cells": F.coalesce("n_cells", F.lit(0))})

    def checks(self) -> DataFrame:
        """One row of integrity flags; each must be true."""
        ids = one_row(self.businesses.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("business_id").alias("d")))
        f = one_row(
            self.features.agg(
                F.count(F.lit(1)).alias("n"), F.countDistinct("feature_index").alias("d"), F.min("feature_index").alias("low"), F.max("feature_index").alias("high"),
                F.sum((F.col("feature_name").startswith("prior__") != (F.col("block_name") == "priors")).cast("int")).alias("misplaced"),
            )
        )
        stray = self.matrix.join(self.businesses.select("business_id"), "business_id", "left_anti").limit(1).count()
        repeated = tables.duplicate_keys(self.matrix, ["business_id", "feature_index"]).limit(1).count()
        outside = self.matrix.filter((F.col("feature_index") < 0) | (F.col("feature_index") >= f["n"])).limit(1).count()
        row = {
            "ids_unique": ids["n"] == ids["d"], "index_unique": f["n"] == f["d"], "index_contiguous": f["low"] == 0 and f["high"] == f["n"] - 1,
            "no_prior_in_content": f["misplaced"] == 0, "cells_have_business": stray == 0, "cells_unique": repeated == 0, "cells_in_range": outside == 0,
        }
        return self.matrix.sparkSession.createDataFrame([row])

    def require_valid(self) -> "Representation":
        bad = [k for k, ok in one_row(self.checks()).items() if not ok]
        if bad:
            raise tables.SchemaProblem(f"representation fails {bad}")
        return self

    def save(self, root: str) -> None:
        tables.save_tables({"businesses": self.businesses, "matrix": self.matrix, "features": self.features, "block_summary": self.block_summary()}, root)

    @staticmethod
    def load(spark, root: str) -> "Representation":
        t = tables.load_artifacts(spark, root, {"businesses": ["business_id"], "matrix": ["business_id", "feature_index", "value"], "features": ["feature_index", "feature_name", "block_name"]})
        return Representation(t["businesses"], t["matrix"], t["features"])


def clean_businesses(prepared: DataFrame, cells: dict[str, DataFrame], min_city: int) -> DataFrame:
    """Readable business table: cleaned places, kept categories joined by a pipe, hours and priors."""
    bucketed = encoders.city_buckets(prepared, min_city)
    counts = cells["attributes"].groupBy(F.col("business_id").alias("_b")).agg(F.count(F.lit(1)).alias("kept_attribute_count"))
    rows = bucketed.join(counts, bucketed["business_id"] == counts["_b"], "left").fillna(0, ["kept_attribute_count"])
    return rows.select(
        "business_id", "state_clean", "city_clean", "city_bucket", "is_open_clean", F.array_join("tokens", "|").alias("category_tokens"), F.size("tokens").alias("category_count"),
        "kept_attribute_count", *encoders.HOURS, "prior_seen_in_train", "prior_mean",
    )


def build_representation(businesses: DataFrame, train: DataFrame, min_city=20, min_category=20, min_attribute=20, max_values=12, priors=True, clusters=0, max_city_columns=200) -> Representation:
    """Geography, categories, attributes, hours and, unless left out, train priors."""
    tables.require_unique(businesses, ["business_id"])
    stats = train_aggregates(train, "item", "business_id")
    prepared = durable(encoders.prepare(businesses, stats))
    cells = encoders.block_cells(prepared, min_city=min_city, min_category=min_category, min_attribute=min_attribute, max_values=max_values, clusters=clusters, max_city_columns=max_city_columns)
    if not priors:
        cells["priors"] = cells["priors"].limit(0)
    features = durable(encoders.feature_metadata(cells))
    if not priors:
        features = features.filter(F.col("block_name") != "priors")
    names = maybe_broadcast(features.select("feature_name", "feature_index"))
    long = None
    for part in cells.values():
        long = part if long is None else long.unionByName(part)
    matrix = long.join(names, "feature_name").groupBy("business_id", "feature_index").agg(F.max("value").alias("value"))
    return Representation(clean_businesses(prepared, cells, min_city), matrix, features)


def safe_content(businesses: DataFrame, train: DataFrame, **options) -> Representation:
    """The prior-free block, for models that must not see train means."""
    return build_representation(businesses, train, priors=False, **options)
