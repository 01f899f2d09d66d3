"""Queries over histories: running statistics, affinities and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import plain, query, view
from starloom.operators import history
from starloom.plans.raw_features import prepare_businesses
from starloom.session import one_row
from starloom.sources import derived
from starloom.sources.tables import canonical_reviews


def enriched(spark, sf, reviews):
    """Canonical reviews with the facets that the affinities need."""
    b = prepare_businesses(derived.businesses(spark, sf)).select(
        F.col("business_id").alias("_b"), F.col("business_city").alias("business_city_top"), "business_state",
        F.coalesce(F.try_element_at("business_category_tokens", F.lit(1)), F.lit("__other__")).alias("business_primary_category_family"),
        "business_is_open", "business_stars",
    )
    r = canonical_reviews(reviews)
    return r.join(b, r["item"] == b["_b"], "left").drop("_b")


view("enriched", ["canonical", "businesses"], """
  SELECT c.*, coalesce(nullif(trim(city), ''), CASE WHEN business_id IS NULL THEN '__other__' ELSE '__missing__' END) AS city_k, coalesce(state, '__missing__') AS state_k,
    coalesce(tokens[1], '__other__') AS cat_k, coalesce(is_open, 0) AS open_k, b.stars AS business_stars
  FROM canonical c LEFT JOIN businesses b ON c.item = b.business_id""")
view("gmean", ["train"], "SELECT avg(stars) AS g FROM train")


def global_mean(spark, sf):
    return one_row(derived.train_reviews(spark, sf).agg(F.avg("stars").alias("g")))["g"]


@query("wn_mean_before", """
SELECT review_id, round(coalesce(avg(rating) OVER (PARTITION BY "user" ORDER BY timestamp, review_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g), 6) AS user_loo_average_stars
FROM canonical, gmean""", "canonical gmean")
def _(spark, sf):
    df = canonical_reviews(derived.reviews(spark, sf)).select("review_id", "user", "rating", "timestamp")
    return plain(history.mean_before(df, global_mean(spark, sf)).select("review_id", "user_loo_average_stars"))


STATS = """
  coalesce(n, 0)::DOUBLE AS tabular_history_count, round(coalesce(m, g), 6) AS tabular_history_mean, round(coalesce(sd, 0), 6) AS tabular_history_std,
  round(coalesce(lo, g), 6) AS tabular_history_min, round(coalesce(hi, g), 6) AS tabular_history_max, round(coalesce(md, g), 6) AS tabular_history_median,
  round(coalesce(pos, 0), 6) AS tabular_history_positive_rate, round(coalesce(neg, 0), 6) AS tabular_history_low_rate,
  round(coalesce(bs, g), 6) AS tabular_history_business_stars_mean, round(coalesce(m - coalesce(business_stars, g), 0), 6) AS tabular_history_business_star_gap,
  round(coalesce((la - fi) / 86400000000.0::DOUBLE, 0), 6) AS tabular_history_span_days, round(greatest(coalesce((epoch_us(timestamp) - la) / 86400000000.0::DOUBLE, 0), 0), 6) AS tabular_history_days_since_last"""
FACET_STATS = ", ".join(
    f"coalesce({a}_n, 0)::DOUBLE AS tabular_history_same_{name}_count, round(coalesce({a}_m, g), 6) AS tabular_history_same_{name}_mean, round(coalesce({a}_n / nullif(n, 0), 0), 6) AS tabular_history_same_{name}_ratio"
    for a, name in (("ci", "city"), ("st", "state"), ("ca", "category"), ("op", "is_open"))
)
COMPLETE = "((coalesce(ci_n, 0) > 0)::INT + (coalesce(st_n, 0) > 0)::INT + (coalesce(ca_n, 0) > 0)::INT + (coalesce(op_n, 0) > 0)::INT) / 4.0::DOUBLE AS tabular_history_feature_completeness"
BEFORE = "ORDER BY timestamp, review_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
view("prefix_stats", ["enriched", "gmean"], f"""
  SELECT e.*, g, count(*) OVER w AS n, avg(rating) OVER w AS m, stddev_pop(rating) OVER w AS sd, min(rating) OVER w AS lo, max(rating) OVER w AS hi,
   median(rating) OVER w AS md, avg((rating >= 4)::INT) OVER w AS pos, avg((rating <= 2)::INT) OVER w AS neg, avg(coalesce(business_stars, g)) OVER w AS bs,
   min(epoch_us(timestamp)) OVER w AS fi, max(epoch_us(timestamp)) OVER w AS la,
   {", ".join(f'count(*) OVER {a} AS {a}_n, avg(rating) OVER {a} AS {a}_m' for a in ("ci", "st", "ca", "op"))}
  FROM enriched e, gmean WINDOW w AS (PARTITION BY "user" {BEFORE}), ci AS (PARTITION BY "user", city_k {BEFORE}), st AS (PARTITION BY "user", state_k {BEFORE}),
   ca AS (PARTITION BY "user", cat_k {BEFORE}), op AS (PARTITION BY "user", open_k {BEFORE})""")


@query("wn_prefix_statistics", f"SELECT review_id, {STATS}, {FACET_STATS}, {COMPLETE} FROM prefix_stats", "prefix_stats")
def _(spark, sf):
    df = history.prefix_statistics(enriched(spark, sf, derived.reviews(spark, sf)), global_mean(spark, sf))
    return plain(df.select("review_id", *[c for c in df.columns if c.startswith("tabular_history_")]))


def facet_join(a, k):
    return f'LEFT JOIN (SELECT "user", {k}, count(*) AS {a}_n, avg(rating) AS {a}_m FROM ctx GROUP BY ALL) {a} ON t."user" = {a}."user" AND t.{k} = {a}.{k}'


@query("wn_context_statistics", f"""
WITH ctx AS (SELECT e.*, g FROM enriched e, gmean WHERE timestamp < TIMESTAMP '2000-04-01'), t AS (SELECT * FROM enriched WHERE timestamp >= TIMESTAMP '2000-04-01'),
u AS (SELECT "user", count(*) AS n, avg(rating) AS m, stddev_pop(rating) AS sd, min(rating) AS lo, max(rating) AS hi, median(rating) AS md, avg((rating >= 4)::INT) AS pos,
  avg((rating <= 2)::INT) AS neg, avg(coalesce(business_stars, g)) AS bs, min(epoch_us(timestamp)) AS fi, max(epoch_us(timestamp)) AS la FROM ctx GROUP BY 1)
SELECT t.review_id, {STATS}, {FACET_STATS}, {COMPLETE} FROM t CROSS JOIN gmean LEFT JOIN u ON t."user" = u."user"
{facet_join("ci", "city_k")} {facet_join("st", "state_k")} {facet_join("ca", "cat_k")} {facet_join("op", "open_k")}""", "enriched gmean")
def _(spark, sf):
    target, context = enriched(spark, sf, derived.test_reviews(spark, sf)), enriched(spark, sf, derived.train_reviews(spark, sf))
    df = history.context_statistics(target, context, global_mean(spark, sf))
    return plain(df.select("review_id", *[c for c in df.columns if c.startswith("tabular_history_")]))


@query("wn_prefix_aliases", f"""
SELECT review_id, round(coalesce(m, g), 6) AS prefix_user_mean, n::DOUBLE AS prefix_user_count, round(coalesce(m, g) - g, 6) AS prefix_user_bias_vs_global,
  round(coalesce(m, g) - coalesce(bm, business_stars, g), 6) AS prefix_user_business_gap, round(coalesce(ci_n / nullif(n, 0), 0), 6) AS prefix_same_city_ratio
FROM prefix_stats LEFT JOIN (SELECT business_id, avg(stars) AS bm FROM train GROUP BY 1) b ON item = b.business_id""", "prefix_stats train")
def _(spark, sf):
    g = global_mean(spark, sf)
    stats = derived.train_reviews(spark, sf).groupBy(F.col("business_id").alias("_b")).agg(F.avg("stars").alias("business_train_mean"))
    df = enriched(spark, sf, derived.reviews(spark, sf)).withColumn("user_train_mean", F.lit(1.0))
    df = history.prefix_statistics(history.drop_whole_history(df), g)
    df = df.join(stats, df["item"] == stats["_b"], "left").drop("_b")
    df = history.prefix_aliases(df, g)
    return plain(df.select("review_id", "prefix_user_mean", "prefix_user_count", "prefix_user_bias_vs_global", "prefix_user_business_gap", "prefix_same_city_ratio"))


SEQ = """
seq AS (SELECT t.review_id, t.timestamp AS now, e.item, e.rating, epoch_us(e.timestamp) AS micros,
   row_number() OVER (PARTITION BY t.review_id ORDER BY e.timestamp DESC, e.item DESC, e.review_id DESC) AS back, count(*) OVER (PARTITION BY t.review_id) AS total
  FROM canonical t JOIN canonical e ON t."user" = e."user" AND (e.timestamp, e.item, e.review_id) < (t.timestamp, t.item, t.review_id))"""
CTX_SEQ = """
seq AS (SELECT t.review_id, t.timestamp AS now, e.item, e.rating, epoch_us(e.timestamp) AS micros,
   row_number() OVER (PARTITION BY t.review_id ORDER BY e.timestamp DESC, e.item DESC, e.review_id DESC) AS back, count(*) OVER (PARTITION BY t.review_id) AS total
  FROM canonical t JOIN canonical e ON t."user" = e."user" AND e.timestamp < TIMESTAMP '2000-04-01' WHERE t.timestamp >= TIMESTAMP '2000-04-01')"""
SEQ_OUT = """
SELECT review_id, total AS exact_history_count, total - least(total, 20) + 1 + (least(total, 20) - back) AS position, item, rating,
  round(greatest((epoch_us(now) - micros) / 86400000000.0::DOUBLE, 0), 6) AS days FROM seq WHERE back <= 20"""


def exploded(df):
    out = df.select("review_id", "exact_history_count", F.size("events").alias("_s"), F.posexplode("events").alias("p", "e"))
    position = F.col("exact_history_count") - F.col("_s") + F.col("p") + 1
    return plain(out.select("review_id", "exact_history_count", position.alias("position"), "e.item", "e.rating", "e.days"))


@query("wn_event_sequences", "WITH " + SEQ + SEQ_OUT, "canonical")
def _(spark, sf):
    return exploded(history.event_sequences(canonical_reviews(derived.reviews(spark, sf))))


@query("wn_context_sequences", "WITH " + CTX_SEQ + SEQ_OUT, "canonical")
def _(spark, sf):
    target, context = canonical_reviews(derived.test_reviews(spark, sf)), canonical_reviews(derived.train_reviews(spark, sf))
    return exploded(history.context_sequences(target, context))


@query("wn_last_events", """
SELECT "user", item, rating, total AS exact_history_count, least(total, 20) - back + 1 AS position FROM (SELECT *, count(*) OVER (PARTITION BY "user") AS total,
 row_number() OVER (PARTITION BY "user" ORDER BY timestamp DESC, item DESC, review_id DESC) AS back FROM canonical WHERE timestamp < TIMESTAMP '2000-04-01') WHERE back <= 20""", "canonical")
def _(spark, sf):
    last = history.last_events(canonical_reviews(derived.train_reviews(spark, sf)))
    return plain(last.select("user", "exact_history_count", F.posexplode("events").alias("p", "e")).select("user", "e.item", "e.rating", "exact_history_count", (F.col("p") + 1).alias("position")))


@query("wn_sequence_statistics", "WITH " + SEQ + """,
k AS (SELECT *, greatest((epoch_us(now) - micros) / 86400000000.0::DOUBLE, 0) AS days FROM seq WHERE back <= 20),
s AS (SELECT review_id, avg(rating) AS m, stddev_pop(rating) AS sd, min(rating) AS lo, max(rating) AS hi, arg_min(rating, back) AS la, avg((rating >= 4)::INT) AS p, avg((rating <= 2)::INT) AS n, avg(days) AS d FROM k GROUP BY 1)
SELECT c.review_id, round(coalesce(m, 0), 6) AS history_rating_mean, round(coalesce(sd, 0), 6) AS history_rating_std, coalesce(lo, 0) AS history_rating_min, coalesce(hi, 0) AS history_rating_max,
 coalesce(la, 0) AS history_last_rating, round(coalesce(p, 0), 6) AS history_positive_share, round(coalesce(n, 0), 6) AS history_negative_share, round(ln(1 + coalesce(d, 0)), 6) AS history_recency_days_log
FROM canonical c LEFT JOIN s USING (review_id)""", "canonical")
def _(spark, sf):
    df = history.event_sequences(canonical_reviews(derived.reviews(spark, sf)))
    stats = history.sequence_statistics()
    stats["history_recency_days_log"] = F.log1p(stats.pop("history_recency_days_mean"))
    return plain(df.select("review_id", *[c.alias(n) for n, c in stats.items()]))


@query("wn_event_features", "WITH " + CTX_SEQ + """,
k AS (SELECT *, greatest((epoch_us(now) - micros) / 86400000000.0::DOUBLE, 0) AS days FROM seq WHERE back <= 20), a AS (SELECT "user", avg(rating) AS um FROM canonical WHERE timestamp < TIMESTAMP '2000-04-01' GROUP BY 1)
SELECT k.review_id, k.item, total - back AS position, k.rating, round(k.rating - um, 6) AS user_centered, round(k.rating - g, 6) AS global_centered, (k.rating >= 4)::DOUBLE AS liked, (k.rating <= 2)::DOUBLE AS disliked,
 round(abs(k.rating - um), 6) AS abs_dev_user, round(days, 6) AS days, round(ln(1 + days), 6) AS log_days, round(exp(-ln(2) / 365 * days), 6) AS decay, round((k.rating - 1) / 4, 6) AS scaled, round((k.rating - g) / 4, 6) AS centered
FROM k JOIN canonical c ON k.review_id = c.review_id JOIN a ON c."user" = a."user", gmean""", "canonical gmean")
def _(spark, sf):
    g = global_mean(spark, sf)
    target, context = canonical_reviews(derived.test_reviews(spark, sf)), canonical_reviews(derived.train_reviews(spark, sf))
    means = context.groupBy(F.col("user").alias("_u")).agg(F.avg("rating").alias("um"))
    df = history.context_sequences(target, context)
    df = df.join(means, df["user"] == means["_u"])
    f = history.event_features(F.col("um"), g, 365.0)
    s = history.scaled_event_ratings(1, 5, g)
    both = F.zip_with(F.zip_with("events", f, lambda e, x: F.struct(e["item"].alias("item"), x.alias("f"))), s, lambda a, b: F.struct(a["item"].alias("item"), a["f"].alias("f"), b.alias("s")))
    out = df.select("review_id", "exact_history_count", F.size("events").alias("_n"), F.posexplode(both).alias("p", "x"))
    return plain(out.select("review_id", "x.item", (F.col("exact_history_count") - F.col("_n") + F.col("p")).alias("position"), "x.f.*", "x.s.*"))


@query("wn_recency_weights", """
SELECT review_id, round(exp(-((epoch_us(max(timestamp) OVER (PARTITION BY "user")) - epoch_us(timestamp)) / 86400000000.0::DOUBLE) / 365), 6) AS weight FROM canonical WHERE timestamp < TIMESTAMP '2000-04-01'""", "canonical")
def _(spark, sf):
    from starloom.plans.profiles import interaction_weights

    return plain(interaction_weights(canonical_reviews(derived.train_reviews(spark, sf)), "recency", 365.0).select("review_id", "weight"))


POOL = CTX_SEQ + """,
k AS (SELECT s.review_id, s.rating, e.embedding AS v, least(total, 20) - back + 1 AS p FROM seq s JOIN item_embeddings e ON s.item = e.business_id WHERE back <= 20),
c AS (SELECT t.review_id, (SELECT count(*) FROM canonical x WHERE x."user" = t."user" AND x.timestamp < TIMESTAMP '2000-04-01') AS n, e.embedding AS cv FROM canonical t LEFT JOIN item_embeddings e ON t.item = e.business_id WHERE t.timestamp >= TIMESTAMP '2000-04-01')"""


@query("wn_prefix_vector_features", "WITH " + POOL + """,
d AS (SELECT c.review_id, n, coalesce(cv, list_transform(range(64), lambda i: 0.0::DOUBLE)) AS cv, cv IS NOT NULL AS known FROM c WHERE n BETWEEN 2 AND 20),
s AS (SELECT d.review_id, k.rating, k.p, k.v, list_inner_product(k.v, d.cv) AS dp, list_inner_product(k.v, d.cv) / greatest(sqrt(list_inner_product(k.v, k.v)) * sqrt(list_inner_product(d.cv, d.cv)), 1e-8) AS cos FROM d JOIN k USING (review_id)),
a AS (SELECT review_id, count(*) AS m, avg(rating) AS rm, stddev_pop(rating) AS rs, min(rating) AS lo, max(rating) AS hi, arg_max(rating, p) AS la, avg((rating >= 4)::INT) AS pos, avg((rating <= 2)::INT) AS neg, max(cos) AS smax, avg(cos) AS smean, arg_max(cos, p) AS slast, arg_max(v, p) AS vlast FROM s GROUP BY 1),
w AS (SELECT *, exp(dp - max(dp) OVER (PARTITION BY review_id)) AS ex FROM s),
x AS (SELECT review_id, p, dp, ex, unnest(v) AS y, unnest(range(64)) AS i FROM w),
pv AS (SELECT review_id, i, avg(y) AS mean_y, sum(p * y) / sum(p) AS rec_y, sum(ex * y) / sum(ex) AS att_y FROM x GROUP BY 1, 2),
pl AS (SELECT review_id, list(mean_y ORDER BY i) AS mv, list(rec_y ORDER BY i) AS rv, list(att_y ORDER BY i) AS av FROM pv GROUP BY 1),
f AS (SELECT d.*, a.* EXCLUDE (review_id), z.* FROM d LEFT JOIN a USING (review_id) LEFT JOIN (SELECT review_id AS rid, mv, rv, av FROM pl) z ON d.review_id = z.rid)
SELECT review_id, known::DOUBLE AS known_prefix_candidate_embedding_known, n::DOUBLE AS known_prefix_history_count, (n = 2)::DOUBLE AS known_prefix_count_is_2,
 round(coalesce(rm, 0), 5) AS known_prefix_history_rating_mean, round(coalesce(rs, 0), 5) AS known_prefix_history_rating_std, coalesce(hi - lo, 0) AS known_prefix_history_rating_range, coalesce(la, 0) AS known_prefix_history_last_rating,
 round(coalesce(pos, 0), 5) AS known_prefix_history_positive_share, round(coalesce(neg, 0), 5) AS known_prefix_history_negative_share, round(coalesce(smax, 0), 5) AS known_prefix_history_similarity_max, round(coalesce(smean, 0), 5) AS known_prefix_history_similarity_mean,
 round(coalesce(slast, 0), 5) AS known_prefix_last_item_similarity, round(coalesce(smean, 0) * n, 5) AS known_prefix_history_similarity_mean_x_count,
 round(coalesce(list_distance(vlast, cv), 0), 5) AS known_prefix_last_item_l2,
 round(coalesce(list_inner_product(mv, cv), 0), 5) AS known_prefix_mean_dot, round(coalesce(list_inner_product(rv, cv), 0), 5) AS known_prefix_recency_dot, round(coalesce(list_inner_product(av, cv), 0), 5) AS known_prefix_attn_dot,
 round(coalesce(list_distance(mv, cv), sqrt(list_inner_product(cv, cv))), 5) AS known_prefix_mean_l2, round(coalesce(list_distance(av, cv), sqrt(list_inner_product(cv, cv))), 5) AS known_prefix_attn_l2,
 round(coalesce(list_inner_product(rv, cv) / greatest(sqrt(list_inner_product(rv, rv)) * sqrt(list_inner_product(cv, cv)), 1e-8), 0), 5) AS known_prefix_recency_cosine
FROM f""", "canonical item_embeddings")
def _(spark, sf):
    from starloom.plans.known_user import prefix_vector_table

    target, context = canonical_reviews(derived.test_reviews(spark, sf)), canonical_reviews(derived.train_reviews(spark, sf))
    df = prefix_vector_table(target, derived.item_embeddings(spark, sf), ["2-5", "6-20"], context=context)
    p = "known_prefix_"
    names = ["candidate_embedding_known", "history_count", "count_is_2", "history_rating_mean", "history_rating_std", "history_rating_range", "history_last_rating", "history_positive_share", "history_negative_share", "history_similarity_max", "history_similarity_mean", "last_item_similarity", "history_similarity_mean_x_count", "last_item_l2", "mean_dot", "recency_dot", "attn_dot", "mean_l2", "attn_l2", "recency_cosine"]
    return plain(df.select("review_id", *[p + n for n in names]), 5)
