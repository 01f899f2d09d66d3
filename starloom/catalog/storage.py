"""Round trips of the given tables through the readers and sinks, in a run folder that all executors share."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import plain, query
from starloom.session import shared_folder
from starloom.sources import derived, tables


@query("io_reviews_csv", "SELECT review_id, user_id, business_id, stars, useful, funny, cool, epoch_us(date) AS micros FROM reviews", "reviews")
def _(spark, sf):
    path = f"{shared_folder(spark, 'reviews')}/review.csv"
    derived.reviews(spark, sf).select(*tables.REVIEW_SCHEMA.names).write.csv(path, header=True)
    back = tables.load_reviews(spark, path)
    return plain(back.select("review_id", "user_id", "business_id", "stars", "useful", "funny", "cool", F.unix_micros(F.to_timestamp("date")).alias("micros")))


@query("io_test_reviews_csv", "SELECT review_id, user_id, business_id, useful, funny, cool FROM test", "test")
def _(spark, sf):
    path = f"{shared_folder(spark, 'requests')}/test_review.csv"
    derived.test_reviews(spark, sf).select(*tables.TEST_REVIEW_SCHEMA.names).write.csv(path, header=True)
    return plain(tables.load_test_reviews(spark, path).drop("date"))


# an empty text and a missing one are alike in CSV
@query("io_users_csv", """
SELECT user_id, review_count, epoch_us(yelping_since) AS micros, useful, funny, cool, nullif(elite, '') AS elite, friends, fans, average_stars, compliment_hot + compliment_photos AS compliments FROM users""", "users")
def _(spark, sf):
    path = f"{shared_folder(spark, 'users')}/user.csv"
    derived.users(spark, sf).select(*tables.USER_SCHEMA.names).write.csv(path, header=True)
    u = tables.load_users(spark, path)
    names = ["user_id", "review_count", F.unix_micros(F.to_timestamp("yelping_since")).alias("micros"), "useful", "funny", "cool", "elite", "friends", "fans", "average_stars"]
    return plain(u.select(*names, (F.col("compliment_hot") + F.col("compliment_photos")).alias("compliments")))


@query("io_businesses_csv", "SELECT business_id, state, postal_code, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, stars, review_count, is_open, categories, has_attributes, has_hours FROM businesses", "businesses")
def _(spark, sf):
    path = f"{shared_folder(spark, 'businesses')}/business.csv"
    derived.businesses(spark, sf).write.csv(path, header=True, escape='"')
    b = tables.load_businesses(spark, path)
    parts = ["business_id", "state", "postal_code", "latitude", "longitude", "stars", "review_count", "is_open", "categories"]
    return plain(b.select(*parts, F.col("attributes").isNotNull().alias("has_attributes"), F.col("hours").isNotNull().alias("has_hours")))


@query("io_rating_request", 'SELECT review_id AS "ID", user_id AS "user", business_id AS item FROM test', "test")
def _(spark, sf):
    path = f"{shared_folder(spark, 'rating-test')}/test.csv"
    derived.test_reviews(spark, sf).select(F.col("review_id").alias("ID"), F.col("user_id").alias("user"), F.col("business_id").alias("item")).write.csv(path, header=True)
    return tables.load_rating_test(spark, path)


@query("io_submissions", "SELECT v AS name, review_id, stars + v AS stars FROM reviews, (SELECT unnest([0, 1]) AS v)", "reviews")
def _(spark, sf):
    root = shared_folder(spark, "submissions")
    reviews = derived.reviews(spark, sf)
    for v in (0, 1, 2):
        tables.write_submission(reviews.withColumn("p", F.col("stars") + v), f"{root}/run-{v}", "review_id", "p", "review_id", "stars")
    back = tables.read_submissions(spark, root, include=["run-"], exclude=["run-2"])
    return plain(back.select(F.regexp_extract("path", r"run-(\d)", 1).cast("bigint").alias("name"), "review_id", "stars"))


@query("io_stored_tables", "SELECT 'users' AS name, count(*) AS n, CAST(sum(fans) AS BIGINT) AS total FROM users UNION ALL SELECT 'businesses', count(*), CAST(sum(review_count) AS BIGINT) FROM businesses", "users businesses")
def _(spark, sf):
    root = shared_folder(spark, "tables")
    tables.save_tables({"users": derived.users(spark, sf), "businesses": derived.businesses(spark, sf)}, root)
    back = tables.load_artifacts(spark, root, {"users": ["user_id", "fans"], "businesses": ["business_id", "review_count"]})
    again = tables.load_tables(spark, root, ["users"])
    total = lambda name, df, c: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(c).alias("total"))
    return total("users", again["users"], "fans").unionByName(total("businesses", back["businesses"], "review_count"))


@query("io_scalars", "SELECT count(*) AS n, round(avg(stars), 6) AS mean FROM reviews", "reviews")
def _(spark, sf):
    path = shared_folder(spark, "scalars")
    row = derived.reviews(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.avg("stars").alias("mean")).first().asDict()
    tables.save_scalars(spark, row, path)
    return plain(spark.createDataFrame([tables.load_scalars(spark, path)]))


@query("io_embeddings", "SELECT CAST(vec_id AS BIGINT) AS vec_id, round(list_sum(embedding::DOUBLE[]), 6) AS total, len(embedding) AS width FROM embeddings")
def _(spark, sf):
    e = tables.load_embeddings(spark, f"{sf}/embeddings.parquet", "vec_id")
    return plain(e.select("vec_id", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("embedding").alias("width")))
