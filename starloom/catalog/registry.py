"""Registered queries and the DuckDB statements they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# Views over the driver's tables, in the words of DuckDB. Each names the views it needs.
VIEWS: dict[str, tuple[list[str], str]] = {
    "reviews": ([], """
      SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS review_id,
             concat_ws('-', o_custkey, substr(o_orderpriority, 1, 1)) AS user_id,
             CAST(l_partkey AS VARCHAR) AS business_id,
             CAST(1 + floor((l_quantity - 1) / 10) AS DOUBLE) AS stars,
             CAST(l_linenumber AS BIGINT) AS useful,
             CAST(round(l_discount * 100) AS BIGINT) - 1 AS funny,
             CAST(round(l_tax * 100) AS BIGINT) AS cool,
             CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(l_linenumber * 180 + l_quantity AS BIGINT)) AS date
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "train": (["reviews"], "SELECT * FROM reviews WHERE date < TIMESTAMP '2000-04-01'"),
    "test": (["reviews"], "SELECT * FROM reviews WHERE date >= TIMESTAMP '2000-04-01'"),
    "users": ([], """
      SELECT concat_ws('-', c, p) AS user_id, (c * 3 + p) % 45 AS review_count,
             CASE WHEN n <> 7 THEN make_timestamp(CAST((631152000 + (c * 37 % 3000) * 86400) * 1000000 AS BIGINT)) END AS yelping_since,
             (c * 7 + p) % 300 AS useful, (c * 11 + p) % 50 AS funny, c * 13 % 80 AS cool,
             CASE s WHEN 'BUILDING' THEN '2019,2020' WHEN 'AUTOMOBILE' THEN '2018;2019; 2021' WHEN 'MACHINERY' THEN 'None' WHEN 'HOUSEHOLD' THEN '' END AS elite,
             CASE WHEN s = 'MACHINERY' THEN 'None' WHEN n = 5 THEN NULL ELSE
               concat_ws(', ', concat(c + 1, '-1'), concat(c + n + 2, '-2'), concat(c * 2, '-3'), concat(c, '-1'), concat(c // 2, '-5')) END AS friends,
             (c * 5 + p) % 20 AS fans, CASE WHEN n <> 3 THEN 1 + (c * 7 % 17) / 4.0::DOUBLE END AS average_stars,
             c % 3 AS compliment_hot, c % 2 AS compliment_more, c % 5 AS compliment_profile, p % 2 AS compliment_cute,
             c % 7 AS compliment_list, (c + p) % 4 AS compliment_note, c % 11 AS compliment_plain, c % 13 AS compliment_cool,
             c % 13 AS compliment_funny, c % 6 AS compliment_writer, c % 9 AS compliment_photos
      FROM (SELECT DISTINCT o_custkey AS c, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS p FROM orders
            WHERE substr(o_orderpriority, 1, 1) <> '4') o
      JOIN (SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS n, c_mktsegment AS s FROM customer) k ON o.c = k.c_custkey"""),
    # parsed attributes and hours are stated here directly from the columns the strings are made of
    "businesses": ([], """
      SELECT CAST(p_partkey AS VARCHAR) AS business_id, CASE WHEN z = 13 THEN '  ' ELSE p_brand END AS city, p_type AS state,
             CASE WHEN z % 9 <> 0 THEN CAST(10000 + z % 12 AS VARCHAR) END AS postal_code,
             CASE WHEN z <> 7 THEN p_retailprice / 100 END AS latitude, CASE WHEN z <> 7 THEN -p_retailprice / 50 END AS longitude,
             CASE WHEN z <> 11 THEN 1 + (z % 9) / 2.0::DOUBLE END AS stars, z AS review_count, z % 2 AS is_open,
             replace(p_name, ' ', ', ') AS categories, string_split(p_name, ' ') AS tokens,
             z % 10 <> 0 AS has_attributes, z % 7 <> 0 AS has_hours, z,
             CASE z % 3 WHEN 0 THEN 'u''free''' WHEN 1 THEN 'no' ELSE 'paid' END AS wifi,
             (z * 5 % 24) * 60 + 45 AS sunday_end, (z % 12) * 60 + 15 AS sunday_start
      FROM (SELECT *, CAST(p_size AS BIGINT) AS z FROM part WHERE p_type <> 'PROMO') x"""),
    "item_embeddings": ([], "SELECT CAST(vec_id AS VARCHAR) AS business_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"),
    "canonical": (["reviews"], "SELECT review_id, user_id AS \"user\", business_id AS item, stars AS rating, date AS timestamp, useful, funny, cool FROM reviews"),
}


def statement(body: str, *views: str) -> str:
    """``body`` preceded by the views it names and the ones those need."""
    ordered: list[str] = []

    def add(name):
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        add(name)
    body = body.strip()
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    if body[:4].upper() == "WITH" and body[4].isspace():
        parts.append(body[5:])
        return "WITH " + ",\n".join(parts)
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql)


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``sql`` is its DuckDB counterpart, on top of the named ``views``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = statement(sql, *views.split())
        return fn

    return register


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output types: whole numbers as bigint, fractions as doubles rounded at the end."""
    out = []
    for field in df.schema.fields:
        kind, col = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            col = F.round(col.cast("double"), digits) + F.lit(0.0)
        elif kind in ("integer", "short", "byte"):
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)
