"""The friend graph: edges, degrees, friends' ratings, and matched comparisons of friends with strangers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions import text, vectors
from starloom.operators.skew import before_each_row, quantiles, top_rows
from starloom.session import durable, one_row


def friend_edges(users: DataFrame) -> DataFrame:
    """Directed edges ``user_id, friend_id`` from the friend lists, as stated."""
    return users.select("user_id", F.explode(F.array_distinct(text.friend_list(F.col("friends")))).alias("friend_id"))


def valid_edges(users: DataFrame) -> DataFrame:
    """Edges to other users of the table."""
    e = friend_edges(users).filter(F.col("user_id") != F.col("friend_id"))
    known = users.select(F.col("user_id").alias("friend_id")).distinct()
    return e.join(known, "friend_id", "left_semi").select("user_id", "friend_id")


def graph_summary(users: DataFrame) -> DataFrame:
    """Users, edges and degree percentiles in one row."""
    e = valid_edges(users)
    degrees = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("d"), F.sum((F.col("user_id") < F.col("friend_id")).cast("bigint")).alias("up"))
    all_users = users.select("user_id").distinct().join(degrees, "user_id", "left").fillna(0, ["d", "up"])
    row = one_row(
        all_users.agg(
            F.count(F.lit(1)).alias("n_users"), F.sum((F.col("d") > 0).cast("bigint")).alias("n_users_with_edges"), F.sum("d").alias("directed_edges"),
            F.sum("up").alias("undirected_edge_estimate"), F.max("d").alias("degree_max"),
        )
    )
    row.update(one_row(quantiles(all_users, [], "d", {"degree_p50": 0.5, "degree_p90": 0.9, "degree_p99": 0.99}, few_values=True)))
    return users.sparkSession.createDataFrame([row])


def with_friend_ratings(frame: DataFrame, users: DataFrame, train: DataFrame, overall: float) -> DataFrame:
    """Mean and number of friends' train ratings of the same business.

    Edges and ratings meet on friend and item in one equi-join; the last rating of a repeated pair counts.
    """
    last = train.groupBy("user", "item").agg(F.max_by("rating", F.struct("timestamp", "review_id")).alias("_rating"))
    wanted = frame.select("user", "item").distinct()
    e = friend_edges(users)
    asked = wanted.join(e, wanted["user"] == e["user_id"]).select(F.col("user").alias("_u"), F.col("item").alias("_i"), "friend_id")
    hits = asked.join(last, (asked["friend_id"] == last["user"]) & (asked["_i"] == last["item"]))
    stats = hits.groupBy("_u", "_i").agg(F.avg("_rating").alias("_fm"), F.count(F.lit(1)).alias("_fn"))
    joined = frame.join(stats, (frame["user"] == stats["_u"]) & (frame["item"] == stats["_i"]), "left")
    mean = F.coalesce("_fm", F.lit(overall))
    return joined.withColumns(
        {
            "friend_business_mean": mean, "friend_business_count_log1p": F.log1p(F.coalesce("_fn", F.lit(0))), "friend_business_bias": mean - F.lit(overall),
        }
    ).drop("_u", "_i", "_fm", "_fn")


def matched_strangers(edges: DataFrame, strata: DataFrame, tries: int = 8, seed: int = 42) -> DataFrame:
    """For each edge one user of the friend's stratum who is neither the anchor nor a friend of the anchor.

    Members of a stratum are numbered by id. An edge draws a first number from a 60-bit hash of its key and seed and takes the next
    free number after it, going round. It proposes ``tries`` numbers at a time; edges still open propose as
    many again as they have proposed, until each is matched or has gone round its whole stratum. So an edge
    stays without a match only if its stratum holds nobody free.
    """
    keyed = strata.select("user_id", "stratum").withColumn("_one", F.lit(1))
    numbered = before_each_row(keyed, ["stratum"], ["user_id"], {"_before": ("sum", "_one")})
    numbered = durable(numbered.select(F.col("user_id").alias("candidate"), F.col("stratum").alias("_cs"), F.coalesce("_before", F.lit(0)).alias("_no")))
    sizes = strata.groupBy(F.col("stratum").alias("_ss")).agg(F.count(F.lit(1)).alias("_size"))
    e = edges.join(strata.select(F.col("user_id").alias("_f"), "stratum"), F.col("friend_id") == F.col("_f")).drop("_f")
    e = e.join(sizes, e["stratum"] == sizes["_ss"]).drop("_ss")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), "user_id", "friend_id"))
    still = durable(e.select("user_id", "friend_id", "stratum", "_size", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint").alias("_start")))
    friends = edges.select(F.col("user_id").alias("_u"), F.col("friend_id").alias("_v"))
    done, found = 0, None
    while True:
        upto = done + max(tries, done)
        some = still.withColumn("_try", F.explode(F.sequence(F.lit(done).cast("bigint"), F.least(F.lit(upto), F.col("_size")) - 1)))
        some = some.withColumn("_no", F.pmod(F.pmod("_start", "_size") + F.col("_try"), F.col("_size")))
        proposed = some.join(numbered, (some["stratum"] == numbered["_cs"]) & (some["_no"] == numbered["_no"])).select("user_id", "friend_id", "_try", "candidate")
        proposed = proposed.filter(F.col("candidate") != F.col("user_id"))
        fine = proposed.join(friends, (proposed["user_id"] == friends["_u"]) & (proposed["candidate"] == friends["_v"]), "left_anti")
        matched = durable(fine.groupBy("user_id", "friend_id").agg(F.min_by("candidate", "_try").alias("matched_non_friend")))
        found = matched if found is None else found.unionByName(matched)
        done = upto
        still = durable(still.filter(F.col("_size") > done).join(matched, ["user_id", "friend_id"], "left_anti"))
        if still.isEmpty():
            return found


def strata(users: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return users.select("user_id", F.concat_ws("|", *columns.values()).alias("stratum"))


def friend_uplift(matched: DataFrame, profiles: DataFrame) -> DataFrame:
    """Cosine of anchor and friend, of anchor and stranger, and their difference, per edge."""
    p = lambda name: profiles.select(F.col("user_id").alias(f"_{name}"), F.col("embedding").alias(f"_v_{name}"))
    rows = matched
    for name, column in (("a", "user_id"), ("f", "friend_id"), ("n", "matched_non_friend")):
        t = p(name)
        rows = rows.join(t, rows[column] == t[f"_{name}"]).drop(f"_{name}")
    friend, stranger = vectors.cosine(F.col("_v_a"), F.col("_v_f")), vectors.cosine(F.col("_v_a"), F.col("_v_n"))
    return rows.withColumns({"friend_cos": friend, "non_friend_cos": stranger}).withColumn("uplift", F.col("friend_cos") - F.col("non_friend_cos")).drop("_v_a", "_v_f", "_v_n")


def uplift_summary(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("friend_cos").alias("friend_mean_cos"), F.avg("non_friend_cos").alias("matched_non_friend_mean_cos"),
        F.avg("uplift").alias("uplift"), F.avg((F.col("uplift") > 0).cast("int")).alias("paired_win_rate"),
    )


def star_homophily(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Correlation and mean gap of average stars between friends."""
    s = lambda n: users.select(F.col("user_id").alias(f"_{n}"), F.col("average_stars").alias(f"{n}_stars"))
    a, b = s("a"), s("b")
    rows = edges.join(a, edges["user_id"] == a["_a"]).join(b, edges["friend_id"] == b["_b"])
    rows = rows.filter(F.col("a_stars").isNotNull() & F.col("b_stars").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("n_edges"), F.corr("a_stars", "b_stars").alias("correlation"), F.avg(F.abs(F.col("a_stars") - F.col("b_stars"))).alias("mean_gap"))


def shared_item_homophily(edges: DataFrame, ratings: DataFrame) -> DataFrame:
    """How close friends rate the businesses that both rated; found by equi-joins along the edges."""
    r = ratings.groupBy("user", "item").agg(F.avg("rating").alias("rating"))
    mine = edges.join(r, edges["user_id"] == r["user"]).select("user_id", "friend_id", "item", F.col("rating").alias("mine"))
    theirs = r.select(F.col("user").alias("_f"), F.col("item").alias("_i"), F.col("rating").alias("theirs"))
    both = mine.join(theirs, (mine["friend_id"] == theirs["_f"]) & (mine["item"] == theirs["_i"]))
    return both.agg(
        F.count(F.lit(1)).alias("n_shared"), F.avg(F.abs(F.col("mine") - F.col("theirs"))).alias("mean_gap"), F.avg((F.col("mine") == F.col("theirs")).cast("int")).alias("same_share"),
        F.corr("mine", "theirs").alias("correlation"),
    )
