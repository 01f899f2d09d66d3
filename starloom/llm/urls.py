"""URL filter lists: host suffixes and path prefixes, joined on short hash prefixes and confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000  # rule rows of some 150 bytes: 15 MB at most; a longer list is joined by shuffling
MOST_LENGTHS = 256  # different lengths of rule paths that become constants of the plan


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table for ``judge_urls``."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _hashed(expression: Column, prefix_digits: int) -> list[Column]:
    digest = F.sha2(expression, 256)
    return [digest.alias("digest"), F.substring(digest, 1, prefix_digits).alias("short")]


def prepared_rules(rules: DataFrame, prefix_digits: int) -> DataFrame:
    """Rules with expression, digest and short prefix, one per expression: of repeated rules ``block`` wins over ``allow``. Nulls name nothing and go."""
    named = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    named = named.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
    named = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    labels = F.size(F.split("host", r"\.", -1)).alias("labels")
    return named.select(rule.alias("rule"), F.length("host").alias("host_length"), labels, "verdict", *_hashed(F.concat_ws("\n", "host", "path"), prefix_digits))


def host_suffixes(host: Column, most_labels: int) -> Column:
    """The suffixes of ``host`` at label borders with at most ``most_labels`` labels."""
    labels = F.split(host, r"\.", -1)
    size = F.size(labels)
    return F.transform(F.sequence(F.greatest(size - most_labels + 1, F.lit(1)), size), lambda i: F.concat_ws(".", F.slice(labels, i, size)))


def expressions(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """All pairs of a host suffix and a path prefix of one of ``lengths``, as an array of ``suffix\\nprefix``."""
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)), lambda n: F.substring(path, 1, n))
    return F.flatten(F.transform(host_suffixes(host, most_labels), lambda s: F.transform(prefixes, lambda p: F.concat_ws("\n", s, p))))


def expanded_addresses(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """Each of ``addresses`` (host, path) once per expression that a rule may have: no more host labels than the longest rule host, and path lengths of rules only.

    A few lengths are constants of the plan; many are a table, joined to the lengths of a path's prefixes.
    """
    known = rules.select((F.length("rule") - F.col("host_length")).alias("n")).distinct()
    lengths = [r["n"] for r in known.limit(MOST_LENGTHS + 1).collect()]
    most_labels = rules.agg(F.max("labels").alias("m")).first()["m"] or 0
    host, path = F.col("host"), F.col("path")
    if len(lengths) <= MOST_LENGTHS:
        return addresses.select("host", "path", F.explode(F.array_distinct(expressions(host, path, sorted(lengths), most_labels))).alias("expression"))
    prefixes = addresses.select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).join(known, "n")
    return prefixes.select("host", "path", F.explode(F.transform(host_suffixes(host, most_labels), lambda s: F.concat_ws("\n", s, F.substring(path, F.lit(1), F.col("n"))))).alias("expression"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """Add host, path, rule and verdict to each row of ``pages`` (column ``url``); its own columns of those names are replaced.

    A rule fits a URL whose host is the rule's or a subdomain of it and whose path starts with the rule's path. The
    longest rule text wins, then the longer host. Without a fitting rule: rule null, verdict ``default``; so also for
    null and malformed URLs and for an empty rule table. Repeated rows stay repeated; an empty table gives an empty one. A very long URL takes time in
    proportion to its length and the number of rule path lengths.

    The distinct (host, path) pairs are expanded and joined with the rules on ``prefix_digits`` hexadecimal digits of
    SHA-256; equal full digests confirm. The best rule per pair comes back by an equi-join, in which a pair that many
    rows share is divided by adaptive execution. The rules are broadcast when they are few.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    rules = prepared_rules(rules, prefix_digits)
    few = rules.count() <= BROADCAST_RULES
    parsed = pages.withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    if rules.isEmpty():
        return parsed.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    addresses = parsed.select("host", "path").distinct()
    expanded = expanded_addresses(addresses, rules)
    hashed = expanded.select("host", "path", *_hashed(F.col("expression"), prefix_digits))
    theirs = rules.select(F.col("short"), F.col("digest").alias("rule_digest"), "rule", "host_length", "verdict")
    hits = hashed.join(F.broadcast(theirs) if few else theirs, "short").where(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule"), "host_length")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("won"))
    judged = parsed.join(best, ["host", "path"], "left")
    return judged.select(*[F.col(f"`{c}`") for c in parsed.columns], F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))
