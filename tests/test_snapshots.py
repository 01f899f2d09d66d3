"""Reports on snapshots read their input once."""

from pyspark.sql import functions as F

from starloom.operators import metrics


def rows_read(spark, report):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    counted = F.udf(seen, "double").asNondeterministic()
    numbers = spark.range(40).select((F.col("id") / 7).alias("x"), (F.col("id") % 5).cast("double").alias("y"), (F.col("id") % 2 + 2).alias("history_count"))
    rows = numbers.select(
        "history_count", F.lit("v3").alias("snapshot"), F.lit("2-5").alias("history_band"), F.lit(True).alias("deep_available"), F.lit("known_item").alias("item_status"), F.lit("1").alias("item_support_bucket"),
        F.col("y").alias("incumbent_abs_error"), F.col("x").alias("deep_abs_error"), (F.col("x") - F.col("y")).alias("error_delta_vs_incumbent"), F.col("y").alias("abs_correction"),
        F.col("x").alias("incumbent_gap_abs"), F.col("y").alias("history_rating_std"), F.col("x").alias("known_prefix_history_similarity_mean"), counted(F.col("x")).alias("alpha"),
    )
    assert report(rows).count() > 0
    return read.value


def test_crosscuts_read_once(spark):
    assert rows_read(spark, lambda rows: metrics.crosscuts(rows.filter("alpha >= 0"))) == 40


def test_segments_read_once(spark):
    assert rows_read(spark, lambda rows: metrics.segment_metrics(rows.filter("alpha >= 0"))) == 40
