"""Temporal, random and frequency-band splits, samples and stratified caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions import buckets
from starloom.operators.skew import quantiles, top_rows
from starloom.session import one_row

HASH_STEPS = 1 << 60


def temporal_cut(df: DataFrame, validation: float, timestamp: str, tie: str) -> tuple:
    """The first ``(timestamp, tie)`` of the validation part, which starts at row ``round(n * (1 - validation))``.

    The day that holds the row is found from counts per day, then the row itself by ranking only that day.
    """
    from starloom.operators.skew import before_each_row

    if not 0.0 < validation < 1.0:
        raise ValueError("validation must lie between 0 and 1")
    days = df.groupBy(F.to_date(timestamp).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    per_day = [(r["d"], r["n"]) for r in days.collect()]  # one row per calendar day
    total = sum(n for _, n in per_day)
    if total < 2:
        raise ValueError("a split needs at least two rows")
    at = min(max(1, int(round(total * (1.0 - validation)))), total - 1)
    below = 0
    for day, n in sorted(per_day, key=lambda x: (x[0] is not None, x[0])):
        if below + n > at:
            break
        below += n
    inside = df.filter(F.to_date(timestamp).eqNullSafe(F.lit(day))).select(timestamp, tie).withColumn("_one", F.lit(1))
    ranked = before_each_row(inside, [], [timestamp, tie], {"_rank": ("sum", "_one")})
    row = ranked.filter(F.coalesce("_rank", F.lit(0)) == at - below).select(F.unix_micros(timestamp).alias("micros"), F.col(tie).alias("tie")).first()
    return row["micros"], row["tie"]


def temporal_split(df: DataFrame, validation: float = 0.2, timestamp: str = "timestamp", tie: str = "review_id"):
    """Train and validation part by time; the cut key becomes a filter, so no rows are moved."""
    micros, last = temporal_cut(df, validation, timestamp, tie)
    at = F.unix_micros(timestamp)
    is_train = F.coalesce((at < micros) | ((at == micros) & (F.col(tie) < F.lit(last))), F.lit(True))
    return df.filter(is_train), df.filter(~is_train)


def hash_number(column: Column, seed: int) -> Column:
    """A repeatable number of 60 bits from a key and a seed: the first 15 digits of an MD5 digest."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), column.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def random_split(df: DataFrame, key: Column, validation: float = 0.2, seed: int = 42):
    """Split by a hash of the row key: the same rows on every run and after every retry."""
    is_validation = hash_number(key, seed) < int(validation * HASH_STEPS)
    return df.filter(~is_validation), df.filter(is_validation)


def sample_rows(df: DataFrame, key: Column, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order (all rows if fewer)."""
    return df.withColumn("_h", hash_number(key, seed)).withColumn("_k", key).orderBy("_h", "_k").limit(n).drop("_h", "_k")


def sample_fraction(df: DataFrame, key: Column, fraction: float, seed: int = 42) -> DataFrame:
    return df.filter(hash_number(key, seed) < int(fraction * HASH_STEPS))


def grouped_cap(df: DataFrame, label: str, key: Column, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows per label, in hash order."""
    keyed = df.withColumns({"_h": hash_number(key, seed), "_k": key})
    return top_rows(keyed, [label], ["_h", "_k"], most, "_r").drop("_h", "_k", "_r")


class FrequencyBands:
    """Low, mid and high bands of users or items by how often they occur in train.

    ``mode`` quantile cuts at the thirds of the counts; threshold uses ``low`` and ``high``. Entities that
    train does not have go to ``unknown_as``, or are left out when that is None.
    """

    def __init__(self, entity="item", mode="quantile", low=None, high=None, unknown_as: str | None = "low"):
        if mode not in ("quantile", "threshold"):
            raise ValueError("mode is quantile or threshold")
        if mode == "threshold" and (low is None or high is None or low >= high):
            raise ValueError("threshold mode needs low < high")
        if unknown_as not in (None, "low", "mid", "high"):
            raise ValueError("unknown_as is None, low, mid or high")
        self.entity, self.mode, self.low, self.high, self.unknown_as = entity, mode, low, high, unknown_as

    def fit(self, train: DataFrame) -> "FrequencyBands":
        self.counts = train.groupBy(F.col(self.entity).alias("_entity")).agg(F.count(F.lit(1)).alias("entity_count"))
        if self.mode == "quantile":
            cuts = one_row(quantiles(self.counts, [], "entity_count", {"a": 1 / 3, "b": 2 / 3}, few_values=True))
            self.first, self.second = cuts["a"], cuts["b"]
        return self

    def band(self, n: Column) -> Column:
        if self.mode == "threshold":
            known = F.when(n <= self.low, "low").when(n >= self.high, "high").otherwise("mid")
        else:
            known = F.when(n <= self.first, "low").when(n <= self.second, "mid").otherwise("high")
        return F.when(n.isNull(), F.lit(self.unknown_as)).otherwise(known)

    def transform(self, df: DataFrame) -> DataFrame:
        joined = df.join(self.counts, df[self.entity] == self.counts["_entity"], "left").drop("_entity")
        out = joined.withColumn("band", self.band(F.col("entity_count")))
        return out if self.unknown_as else out.filter(F.col("band").isNotNull())

    def summary(self, df: DataFrame) -> DataFrame:
        """Rows, distinct entities and count range per band; bands without rows are kept."""
        per_entity = self.transform(df).groupBy("band", self.entity).agg(F.count(F.lit(1)).alias("rows"), F.max("entity_count").alias("c"))
        stats = per_entity.groupBy("band").agg(
            F.sum("rows").alias("n_rows"), F.count(F.lit(1)).alias("n_unique_entities"), F.min("c").alias("min_count"), F.max("c").alias("max_count"),
            (F.sum(F.col("c") * F.col("rows")) / F.sum(F.when(F.col("c").isNotNull(), F.col("rows")))).alias("mean_count"),
        )
        bands = df.sparkSession.createDataFrame([("low",), ("mid",), ("high",)], "band string")
        return bands.join(stats, "band", "left").fillna(0, ["n_rows", "n_unique_entities"])


def frequent_entities(df: DataFrame, key: str, at_least: int | None = None, at_most: int | None = None) -> DataFrame:
    """Rows whose entity has between ``at_least`` and ``at_most`` rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    if at_least is not None:
        counts = counts.filter(F.col("_n") >= at_least)
    if at_most is not None:
        counts = counts.filter(F.col("_n") <= at_most)
    return df.join(counts.select(key), key, "left_semi")


def cold_start_breakdown(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Evaluation rows by whether user and item occur in train: one wide row."""
    u = train.select(F.col("user").alias("_u")).distinct().withColumn("_ku", F.lit(1))
    i = train.select(F.col("item").alias("_i")).distinct().withColumn("_ki", F.lit(1))
    joined = evaluation.join(u, evaluation["user"] == u["_u"], "left").join(i, evaluation["item"] == i["_i"], "left")
    ku, ki = F.col("_ku").isNotNull(), F.col("_ki").isNotNull()
    n = lambda c: F.sum(c.cast("bigint"))
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"), n(ku & ki).alias("both_known"), n(~ku & ki).alias("new_user"), n(ku & ~ki).alias("new_item"), n(~ku & ~ki).alias("new_both"),
    )


def summarize_cases(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    wide = cold_start_breakdown(train, evaluation)
    cases = ["both_known", "new_user", "new_item", "new_both"]
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("case"), F.col(c).alias("n_rows")) for c in cases]))).filter("n_rows > 0")
