"""Review, user, business and embedding tables derived from the order tables.

The engine works on a review log with user and business metadata. These views give that shape to the
star-schema tables, over all of their rows: a line item is a review, a customer and order priority form
a reviewer, a part is a business. Reviewers with priority 4 have no profile and parts of type PROMO
have no business row, so that missing metadata occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_DATE = "2000-04-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores when the files are fewer than the cores; larger inputs are left where they are.

    By key and not round-robin, so that a repeated task gets the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _user_id(customer="o_custkey", priority="o_orderpriority"):
    return F.concat_ws("-", F.col(customer).cast("string"), F.substring(priority, 1, 1))


def reviews(spark: SparkSession, sf_dir: str, before: str | None = None, since: str | None = None) -> DataFrame:
    """The review log; ``before`` and ``since`` limit the day of the order, where Parquet can skip row groups."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"
    )
    lines = spread(lines, "l_orderkey")
    orders = table(spark, sf_dir, "orders")
    day = lambda text: F.lit(text).cast(orders.schema["o_orderdate"].dataType)
    if before:
        orders = orders.filter(F.col("o_orderdate") < day(before))
    if since:
        orders = orders.filter(F.col("o_orderdate") >= day(since))
    minutes = (F.col("l_linenumber") * 180 + F.col("l_quantity")).cast("bigint")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws(
            "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.col("l_quantity").cast("bigint").cast("string"),
        ).alias("review_id"),
        _user_id().alias("user_id"),
        F.col("l_partkey").cast("string").alias("business_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
        F.col("l_linenumber").cast("bigint").alias("useful"),
        (F.round(F.col("l_discount") * 100).cast("bigint") - 1).alias("funny"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("cool"),
        F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + minutes * F.lit(60_000_000)).alias("date"),
    )


def train_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir, before=SPLIT_DATE)


def test_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir, since=SPLIT_DATE)


COMPLIMENTS = ["hot", "more", "profile", "cute", "list", "note", "plain", "cool", "funny", "writer", "photos"]


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(F.substring("o_orderpriority", 1, 1) != "4")
    people = orders.select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("bigint").alias("p")).distinct()
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    c, p, nation, segment = F.col("c_custkey"), F.col("p"), F.col("c_nationkey").cast("bigint"), F.col("c_mktsegment")
    elite = (
        F.when(segment == "BUILDING", "2019,2020")
        .when(segment == "AUTOMOBILE", "2018;2019; 2021")
        .when(segment == "MACHINERY", "None")
        .when(segment == "HOUSEHOLD", "")
    )
    ids = F.concat_ws(
        ", ",
        F.concat((c + 1).cast("string"), F.lit("-1")),
        F.concat((c + nation + 2).cast("string"), F.lit("-2")),
        F.concat((c * 2).cast("string"), F.lit("-3")),
        F.concat(c.cast("string"), F.lit("-1")),
        F.concat(F.floor(c / 2).cast("string"), F.lit("-5")),
    )
    friends = F.when(segment == "MACHINERY", "None").when(nation == 5, F.lit(None)).otherwise(ids)
    compliment = {
        "hot": c % 3, "more": c % 2, "profile": c % 5, "cute": p % 2, "list": c % 7, "note": (c + p) % 4,
        "plain": c % 11, "cool": c % 13, "funny": c % 13, "writer": c % 6, "photos": c % 9,
    }
    return people.join(customers, F.col("o_custkey") == c).select(
        F.concat_ws("-", c.cast("string"), p.cast("string")).alias("user_id"),
        ((c * 3 + p) % 45).alias("review_count"),
        F.when(nation != 7, F.timestamp_seconds(F.lit(631152000) + (c * 37 % 3000) * 86400)).alias("yelping_since"),
        ((c * 7 + p) % 300).alias("useful"),
        ((c * 11 + p) % 50).alias("funny"),
        (c * 13 % 80).alias("cool"),
        elite.alias("elite"),
        friends.alias("friends"),
        ((c * 5 + p) % 20).alias("fans"),
        F.when(nation != 3, 1 + (c * 7 % 17) / F.lit(4.0)).alias("average_stars"),
        *[compliment[name].alias(f"compliment_{name}") for name in COMPLIMENTS],
    )


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("bigint")
    flag = lambda cond: F.when(cond, "True").otherwise("False")
    wifi = F.when(size % 3 == 0, "\"u'free'\"").when(size % 3 == 1, "'no'").otherwise("'paid'")
    attributes = F.concat(
        F.lit("{'WiFi': "), wifi,
        F.lit(", 'TakeOut': '"), flag(size % 2 == 1),
        F.lit("', 'Rank': "), (size % 4).cast("string"),
        F.lit(", 'BusinessParking': \"{'garage': "), flag(size % 5 < 2),
        F.lit(", 'lot': True, 'valet': None}\", 'Note': 'it\\'s '}"),
    )
    hours = F.concat(
        F.lit("{'Monday': '9:0-17:0', 'Tuesday': 'closed', 'Friday': '18:0-2:30', 'Saturday': '0:0-0:0', 'Sunday': '"),
        (size % 12).cast("string"), F.lit(":15-"), (size * 5 % 24).cast("string"), F.lit(":45'}"),
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").filter(F.col("p_type") != "PROMO").select(
        F.col("p_partkey").cast("string").alias("business_id"),
        F.when(size == 13, "  ").otherwise(F.col("p_brand")).alias("city"),
        F.col("p_type").alias("state"),
        F.when(size % 9 != 0, (10000 + size % 12).cast("string")).alias("postal_code"),
        F.when(size != 7, F.col("p_retailprice") / 100).alias("latitude"),
        F.when(size != 7, -F.col("p_retailprice") / 50).alias("longitude"),
        F.when(size != 11, 1 + (size % 9) / F.lit(2.0)).alias("stars"),
        size.alias("review_count"),
        (size % 2).alias("is_open"),
        F.when(size % 10 != 0, attributes).alias("attributes"),
        F.regexp_replace("p_name", " ", ", ").alias("categories"),
        F.when(size % 7 != 0, hours).alias("hours"),
    )


def item_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business vectors: the embedding with the id of the part; the others have none."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("business_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
