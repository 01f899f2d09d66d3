"""Reading, checking and writing tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("review_id", "user_id", "business_id")]
    + [T.StructField("stars", T.DoubleType())]
    + [T.StructField(c, T.LongType()) for c in ("useful", "funny", "cool")]
    + [T.StructField("date", T.StringType())]
)
TEST_REVIEW_SCHEMA = T.StructType([f for f in REVIEW_SCHEMA if f.name != "stars"])
USER_COLUMNS = [
    "review_count", "yelping_since", "useful", "funny", "cool", "elite", "friends", "fans", "average_stars",
    "compliment_hot", "compliment_more", "compliment_profile", "compliment_cute", "compliment_list", "compliment_note",
    "compliment_plain", "compliment_cool", "compliment_funny", "compliment_writer", "compliment_photos",
]
USER_TEXT = {"yelping_since", "elite", "friends"}
USER_SCHEMA = T.StructType(
    [T.StructField("user_id", T.StringType())]
    + [
        T.StructField(c, T.StringType() if c in USER_TEXT else T.DoubleType() if c == "average_stars" else T.LongType())
        for c in USER_COLUMNS
    ]
)
BUSINESS_COLUMNS = [
    "city", "state", "postal_code", "latitude", "longitude", "stars", "review_count", "is_open", "attributes",
    "categories", "hours",
]
BUSINESS_NUMBERS = {"latitude": T.DoubleType(), "longitude": T.DoubleType(), "stars": T.DoubleType(), "review_count": T.LongType(), "is_open": T.LongType()}
BUSINESS_SCHEMA = T.StructType(
    [T.StructField("business_id", T.StringType())]
    + [T.StructField(c, BUSINESS_NUMBERS.get(c, T.StringType())) for c in BUSINESS_COLUMNS]
)


class SchemaProblem(ValueError):
    """Raised with every problem found, not only the first."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes; no inference pass over the data."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table resolved by the suffix of its path."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV file needs a schema")
        return read_csv(spark, path, schema)
    raise ValueError(f"unsupported file type: {path}")


def load_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, REVIEW_SCHEMA)


def load_test_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TEST_REVIEW_SCHEMA)


def load_users(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, USER_SCHEMA)


def load_businesses(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, BUSINESS_SCHEMA)


def load_rating_test(spark: SparkSession, path: str) -> DataFrame:
    """A scoring request of a rating model: ``ID, user, item``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("ID", "user", "item")])
    df = read_table(spark, path, schema)
    require_columns(df, ["ID", "user", "item"])
    return df.select("ID", "user", "item")


def canonical_reviews(
    df: DataFrame, user="user_id", item="business_id", rating="stars", timestamp="date"
) -> DataFrame:
    """``user, item, rating, timestamp`` under either naming; bad ratings and dates become null."""
    names = {user: "user", item: "item", rating: "rating", timestamp: "timestamp"}
    out = df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})
    if "rating" in out.columns:
        out = out.withColumn("rating", F.col("rating").try_cast("double"))
    if "timestamp" in out.columns:
        out = out.withColumn("timestamp", F.col("timestamp").try_cast("timestamp"))
    return out


def column_problems(df: DataFrame, required: list[str], name: str = "table") -> list[str]:
    missing = [c for c in required if c not in df.columns]
    return [f"{name}: missing columns {missing}"] if missing else []


def require_columns(df: DataFrame, required: list[str], name: str = "table", not_empty: bool = False) -> DataFrame:
    problems = column_problems(df, required, name)
    if not problems and not_empty and df.isEmpty():
        problems = [f"{name}: no rows"]
    if problems:
        raise SchemaProblem("; ".join(problems))
    return df


def load_artifacts(spark: SparkSession, root: str, required: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Read ``root/name.parquet`` for every name; all missing tables and columns are reported at once."""
    loaded, problems = {}, []
    for name, columns in required.items():
        try:
            loaded[name] = spark.read.parquet(f"{root}/{name}.parquet")
        except Exception as error:  # an absent path is an AnalysisException; keep looking at the others
            problems.append(f"{name}: {type(error).__name__}")
            continue
        problems += column_problems(loaded[name], columns, name)
    if problems:
        raise SchemaProblem("; ".join(problems))
    return loaded


def save_tables(tables: dict[str, DataFrame], root: str) -> None:
    """One Parquet table per name: fitted priors, factors, levels, centres, representations."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def load_tables(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{root}/{name}.parquet") for name in names}


def save_scalars(spark: SparkSession, scalars: dict, path: str) -> None:
    """Fitted scalars as a one-row table."""
    spark.createDataFrame([scalars]).write.mode("overwrite").parquet(path)


def load_scalars(spark: SparkSession, path: str) -> dict:
    from starloom.session import one_row

    return one_row(spark.read.parquet(path))


def load_embeddings(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """An embedding table ``id, embedding``; fails when a part is missing or widths differ."""
    df = read_table(spark, path)
    require_columns(df, [id_column, "embedding"], path)
    df = df.select(F.col(id_column), F.col("embedding").cast("array<double>").alias("embedding"))
    widths = df.agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high")).first()
    if widths["low"] is None or widths["low"] != widths["high"] or widths["low"] <= 0:
        raise SchemaProblem(f"{path}: vectors must be present and of one width")
    return df


def with_missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Exactly the required columns, absent ones as null."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in required])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise SchemaProblem(f"keys {keys} are not unique")
    return df


def drop_null_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def write_submission(df: DataFrame, path: str, id_column: str, prediction: str, id_name: str, value_name: str) -> None:
    """A scored table as CSV with a header: ``ID, rating`` or ``review_id, stars``."""
    df.select(F.col(id_column).alias(id_name), F.col(prediction).alias(value_name)).write.mode("overwrite").csv(
        path, header=True
    )


def read_submissions(
    spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """All submissions below ``root`` as ``path, review_id, stars``; a star that is no number fails.

    Kept are files whose path has every ``include`` text and no ``exclude`` text.
    """
    schema = T.StructType([T.StructField("review_id", T.StringType()), T.StructField("stars", T.StringType())])
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").csv(root, header=True, pathGlobFilter="*.csv")
    # a submission written in parts is named by its folder
    df = df.withColumn("path", F.regexp_replace(F.input_file_name(), r"/part-[^/]*$", ""))
    keep = reduce(lambda a, b: a & b, [F.col("path").contains(t) for t in include or []], F.lit(True))
    keep = reduce(lambda a, b: a & b, [~F.col("path").contains(t) for t in exclude or []], keep)
    return df.filter(keep).select("path", "review_id", F.col("stars").cast("double").alias("stars"))
