"""Dataset profiles: sizes, concentration, support curves and qualitative risk labels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.operators.skew import quantiles, up_to_each_row
from starloom.session import one_row

PERCENTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def dataset_summary(df: DataFrame, rating: str | None = "rating") -> DataFrame:
    """Counts, density and rating statistics in one row."""
    spark = df.sparkSession
    base = [F.count(F.lit(1)).alias("n_interactions")]
    if rating:
        base += [
            F.avg(rating).alias("rating_mean"), F.coalesce(F.stddev_samp(rating), F.lit(0.0)).alias("rating_std"),
            F.min(rating).alias("rating_min"), F.max(rating).alias("rating_max"),
        ]
    found = one_row(df.agg(*base))
    users = one_row(df.select("user").distinct().agg(F.count("user").alias("n")))["n"]
    items = one_row(df.select("item").distinct().agg(F.count("item").alias("n")))["n"]
    n = found["n_interactions"]
    density = n / (users * items) if users and items else 0.0
    row = {
        **found, "n_users": users, "n_items": items, "density": density, "sparsity": 1.0 - density,
        "avg_interactions_per_user": n / users if users else 0.0, "avg_interactions_per_item": n / items if items else 0.0,
    }
    if rating:
        row["rating_median"] = one_row(quantiles(df, [], rating, {"m": 0.5}))["m"]
    return spark.createDataFrame([row])


def entity_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("entity")).agg(F.count(F.lit(1)).alias("n"))


def entity_profile(counts: DataFrame) -> DataFrame:
    """Percentiles, shares of small and large entities, head shares and Gini of interaction counts.

    Works on the histogram of counts (few distinct values, at most the square root of twice the rows), so
    ranking the entities needs no global sort.
    """
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("m")).cache()
    try:
        share = lambda cond: F.sum(F.when(cond, F.col("m")).otherwise(0)) / F.sum("m")
        n = F.col("n")
        row = one_row(
            hist.agg(
                F.sum("m").alias("n_entities"), F.min("n").alias("min_interactions"), F.max("n").alias("max_interactions"),
                (F.sum(n * F.col("m")) / F.sum("m")).alias("mean_interactions"),
                F.sum(n * n * F.col("m")).cast("double").alias("_squares"),
                *[F.expr(f"percentile(n, {p}D, m)").alias(f"{name}_interactions") for name, p in PERCENTILES.items()],
                share(n == 1).alias("share_with_1_interaction"),
                *[share(n <= k).alias(f"share_with_le_{k}_interactions") for k in (2, 5, 10)],
                *[share(n >= k).alias(f"share_with_ge_{k}_interactions") for k in (10, 20)],
                F.sum(n * F.col("m")).alias("total_interactions"),
            )
        )
        entities, total = row["n_entities"], row["total_interactions"]
        squares = row.pop("_squares")
        mean = row["mean_interactions"]
        row["std_interactions"] = ((squares - entities * mean * mean) / (entities - 1)) ** 0.5 if entities > 1 else 0.0
        # ranks of the largest entities, from the histogram: entities with more interactions come first
        ranked = up_to_each_row(
            hist.withColumns({"_key": -n, "_rows": n * F.col("m")}), [], ["_key"], {"_upto": ("sum", "m"), "_upto_rows": ("sum", "_rows")}
        )
        heads = {f"head_{int(f * 100)}pct_interaction_share": max(1, -(-entities * int(f * 100) // 100)) for f in (0.01, 0.05, 0.10)}
        taken = lambda k: F.greatest(F.least(F.lit(k) - (F.col("_upto") - F.col("m")), F.col("m")), F.lit(0)) * n
        # Gini: sum over entities in ascending order of (2 i - entities - 1) x, i being the ascending rank
        first = F.lit(entities) - F.col("_upto") + 1
        last = F.lit(entities) - F.col("_upto") + F.col("m")
        ranks = (first + last).cast("double") * F.col("m")
        row.update(
            one_row(
                ranked.agg(
                    *[(F.sum(taken(k)) / F.lit(total)).alias(name) for name, k in heads.items()],
                    (F.sum((ranks - F.col("m") * F.lit(entities + 1)) * n) / F.lit(float(entities) * total)).alias("gini_interaction_concentration"),
                )
            )
        )
    finally:
        hist.unpersist()
    return counts.sparkSession.createDataFrame([row])


def support_curve(counts: DataFrame, top: int = 100) -> DataFrame:
    """Share of entities with at least t interactions, for t = 1..top."""
    reach = F.least(F.col("n"), F.lit(top))
    hist = counts.groupBy(reach.alias("n")).agg(F.count(F.lit(1)).alias("m"))
    found = {r["n"]: r["m"] for r in hist.collect()}  # at most ``top`` rows
    total = sum(found.values())
    rows, left = [], total
    for t in range(1, top + 1):
        rows.append((t, left / total if total else 0.0))
        left -= found.get(t, 0)
    return counts.sparkSession.createDataFrame(rows, "threshold bigint, coverage double")


def frequency_of_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy(F.col("n").alias("n_interactions")).agg(F.count(F.lit(1)).alias("n_entities"))


def diagnostics(summary: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Sparsity, tail and cold-start labels and a matrix-factorization risk from the one-row profiles."""
    s, u, i = one_row(summary), one_row(users), one_row(items)

    def step(x, *bounds):
        for bound, label in bounds[:-1]:
            if x > bound:
                return label
        return bounds[-1]

    user_one, item_one = u["share_with_1_interaction"], i["share_with_1_interaction"]
    risk = step(s["sparsity"], (0.99, 2), (0.95, 1), 0) + step(user_one, (0.4, 1), 0) + step(item_one, (0.4, 2), (0.2, 1), 0)
    row = {
        "sparsity_level": step(s["sparsity"], (0.99, "very_high"), (0.95, "high"), (0.90, "moderate"), "low"),
        "item_tail_severity": step(item_one, (0.5, "extreme"), (0.3, "high"), "moderate_or_low"),
        "user_tail_severity": step(user_one, (0.5, "extreme"), (0.3, "high"), "moderate_or_low"),
        "matrix_factorization_risk": "high" if risk >= 4 else "moderate" if risk >= 2 else "low",
        "cold_start_risk_items": step(i["share_with_le_5_interactions"], (0.7, "high"), (0.4, "moderate"), "low"),
        "cold_start_risk_users": step(u["share_with_le_5_interactions"], (0.7, "high"), (0.4, "moderate"), "low"),
    }
    return summary.sparkSession.createDataFrame([row])


class DatasetProfiler:
    """One call builds all profiles of a rating table and keeps them as a report."""

    def fit(self, df: DataFrame) -> "DatasetProfiler":
        users, items = entity_counts(df, "user").cache(), entity_counts(df, "item").cache()
        try:
            summary = dataset_summary(df)
            self.user_profile, self.item_profile = entity_profile(users), entity_profile(items)
            self.report = {
                "dataset_summary": one_row(summary), "user_profile": one_row(self.user_profile), "item_profile": one_row(self.item_profile),
                "diagnostics": one_row(diagnostics(summary, self.user_profile, self.item_profile)),
                "user_support_curve": {r["threshold"]: r["coverage"] for r in support_curve(users).collect()},
                "item_support_curve": {r["threshold"]: r["coverage"] for r in support_curve(items).collect()},
            }
        finally:
            users.unpersist()
            items.unpersist()
        self._spark = df.sparkSession
        return self

    def to_table(self) -> DataFrame:
        """The report in long form: section, metric, value."""
        rows = [(section, str(metric), str(value)) for section, metrics in self.report.items() for metric, value in metrics.items()]
        return self._spark.createDataFrame(rows, "section string, metric string, value string")

    def save(self, path: str) -> None:
        self.to_table().write.mode("overwrite").parquet(path)

    def to_json(self) -> str:
        return json.dumps(self.report, indent=2, default=str)
