"""Queries over feature tables, encoders, representations, vectors and the friend graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.aggregates import test, train
from starloom.catalog.history import CTX_SEQ
from starloom.catalog.registry import plain, query, view
from starloom.catalog.routing import evals, preds
from starloom.catalog.scalars import ATTRIBUTE_ROWS, CONTEXT, CONTEXT_COLUMNS
from starloom.functions import numeric, text, vectors
from starloom.operators import bias, embeddings, encoders, graph, history, priors, splits
from starloom.operators.priors import train_aggregates
from starloom.plans import known_user, pair_features, profiles, raw_features, representation, router_features, stackers
from starloom.session import durable, one_row
from starloom.sources import derived
from starloom.sources.tables import canonical_reviews

# user and business metadata as the raw feature table sees them
view("prep_users", ["users", "ctrain"], """
  SELECT user_id, greatest(coalesce((e - epoch_us(yelping_since)) / 86400000000.0::DOUBLE, 0), 0) AS tenure, (yelping_since IS NULL)::DOUBLE AS since_missing, review_count, useful, funny, cool, fans, average_stars,
   CASE WHEN elite = '2019,2020' THEN 2 WHEN elite = '2018;2019; 2021' THEN 3 ELSE 0 END AS elite_n, CASE WHEN friends IS NULL OR friends = 'None' THEN 0 ELSE 5 END AS friends_n,
   compliment_hot + compliment_more + compliment_profile + compliment_cute + compliment_list + compliment_note + compliment_plain + compliment_cool + compliment_funny + compliment_writer + compliment_photos AS comp,
   (compliment_hot > 0)::INT + (compliment_more > 0)::INT + (compliment_profile > 0)::INT + (compliment_cute > 0)::INT + (compliment_list > 0)::INT + (compliment_note > 0)::INT + (compliment_plain > 0)::INT + 2 * (compliment_cool > 0)::INT + (compliment_writer > 0)::INT + (compliment_photos > 0)::INT AS comp_nz
  FROM users, (SELECT epoch_us(max(timestamp)) AS e FROM ctrain)""")
view("prep_biz", ["businesses"], """
  SELECT business_id, coalesce(nullif(trim(city), ''), '__missing__') AS city, state, coalesce(postal_code, '__missing__') AS postal, latitude, longitude, stars, review_count, is_open, tokens, has_attributes, has_hours, z, sunday_end,
   CASE WHEN NOT has_hours THEN 0 ELSE 2430 + CASE WHEN sunday_end = sunday_start THEN 1440 WHEN sunday_end < sunday_start THEN sunday_end + 1440 - sunday_start ELSE sunday_end - sunday_start END END AS weekly FROM businesses""")


@query("ft_prepared_users", """
SELECT user_id, round(tenure, 5) AS user_tenure_days, round(tenure / 365.25::DOUBLE, 6) AS user_tenure_years, since_missing AS user_yelping_since_missing, review_count::DOUBLE AS user_review_count, average_stars AS user_average_stars, round(ln(1 + useful + funny + cool), 6) AS user_total_votes_log1p,
 round(ln(1 + useful + funny + cool + fans), 6) AS user_engagement_log1p, elite_n::DOUBLE AS user_elite_years_count, (elite_n > 0)::DOUBLE AS user_elite_any, friends_n::DOUBLE AS user_friends_count, comp::DOUBLE AS user_compliment_total, comp_nz::DOUBLE AS user_compliment_nonzero_count FROM prep_users""", "prep_users")
def _(spark, sf):
    u = raw_features.prepare_users(derived.users(spark, sf), priors.train_scalars(train(spark, sf))["end"])
    u = u.withColumn("user_tenure_days", F.round("user_tenure_days", 5))
    return plain(u.select("user_id", "user_tenure_days", "user_tenure_years", "user_yelping_since_missing", "user_review_count", "user_average_stars", "user_total_votes_log1p", "user_engagement_log1p", "user_elite_years_count", "user_elite_any", "user_friends_count", "user_compliment_total", "user_compliment_nonzero_count"))


@query("ft_prepared_businesses", """
SELECT business_id, city AS business_city, state AS business_state, postal AS business_postal_code, latitude AS business_latitude, stars AS business_stars, round(ln(1 + review_count), 6) AS business_review_count_log1p, (latitude IS NOT NULL)::DOUBLE AS business_has_latitude, len(tokens)::DOUBLE AS business_categories_count,
 CASE WHEN has_attributes THEN 7 ELSE 0 END::DOUBLE AS business_attributes_count, (NOT has_attributes)::DOUBLE AS business_attributes_missing, CASE WHEN has_attributes THEN 2 ELSE 0 END::DOUBLE AS business_attribute_string_count, CASE WHEN has_hours THEN 4 ELSE 0 END::DOUBLE AS business_open_days_count,
 weekly::DOUBLE AS business_weekly_open_minutes, (has_hours)::DOUBLE AS business_has_hours, round(stars / greatest(review_count, 1), 6) AS business_rating_per_review, round(coalesce(abs(latitude), 0) + coalesce(abs(longitude), 0), 6) AS business_geo_abs FROM prep_biz""", "prep_biz")
def _(spark, sf):
    b = raw_features.prepare_businesses(derived.businesses(spark, sf))
    names = ["city", "state", "postal_code", "latitude", "stars", "review_count_log1p", "has_latitude", "categories_count", "attributes_count", "attributes_missing", "attribute_string_count", "open_days_count", "weekly_open_minutes", "has_hours", "rating_per_review", "geo_abs"]
    return plain(b.select("business_id", *[f"business_{n}" for n in names]))


view("raw_ft", ["ctrain", "ctest", "prep_users", "prep_biz"], """
  SELECT t.*, g, u.user_id IS NOT NULL AS has_u, b.business_id IS NOT NULL AS has_b, coalesce(average_stars, g) AS ua, coalesce(b.stars, g) AS bst, u.review_count AS urc, b.review_count AS brc, b.city, b.state, b.postal, pu.n AS un, pu.m AS um, coalesce(pu.s, 0) AS us, pi.n AS inn, pi.m AS im, coalesce(pi.s, 0) AS iss, epoch_us(t.timestamp) AS ep, mn, mx, pu.l AS ul, pu.f AS uf
  FROM ctest t LEFT JOIN prep_users u ON t."user" = u.user_id LEFT JOIN prep_biz b ON t.item = b.business_id
  LEFT JOIN (SELECT "user", count(*) AS n, avg(rating) AS m, stddev_samp(rating) AS s, epoch_us(max(timestamp)) AS l, epoch_us(min(timestamp)) AS f FROM ctrain GROUP BY 1) pu ON t."user" = pu."user"
  LEFT JOIN (SELECT item, count(*) AS n, avg(rating) AS m, stddev_samp(rating) AS s FROM ctrain GROUP BY 1) pi ON t.item = pi.item, (SELECT avg(rating) AS g, epoch_us(min(timestamp)) AS mn, epoch_us(max(timestamp)) AS mx FROM ctrain)""")
PLACES = """
j AS (SELECT rating, CASE WHEN b.business_id IS NULL THEN NULL ELSE b.city END AS city, b.state, CASE WHEN b.business_id IS NULL THEN NULL ELSE b.postal END AS postal FROM ctrain c LEFT JOIN prep_biz b ON c.item = b.business_id),
ci AS (SELECT city, count(*) AS n, avg(rating) AS m FROM j GROUP BY 1), st AS (SELECT state, count(*) AS n, avg(rating) AS m FROM j GROUP BY 1), po AS (SELECT postal, count(*) AS n, avg(rating) AS m FROM j GROUP BY 1)"""
BUCKET = "CASE WHEN {n} <= 0 THEN '0' WHEN {n} <= 1 THEN '1' WHEN {n} <= 2 THEN '2' WHEN {n} <= 3 THEN '3' WHEN {n} <= 5 THEN '4-5' WHEN {n} <= 10 THEN '6-10' WHEN {n} <= 20 THEN '11-20' ELSE '>20' END"


@query("ft_raw_features", f"""
WITH {PLACES} SELECT review_id, (un IS NOT NULL)::DOUBLE AS user_known_in_train, (inn IS NOT NULL)::DOUBLE AS business_known_in_train, round(greatest((ep - mx) / 86400000000.0::DOUBLE, 0), 5) AS review_days_since_train_end, ua AS user_average_stars_r, coalesce(un, 0)::DOUBLE AS user_train_count, round(coalesce(um, r.g), 6) AS user_train_mean, round(us, 6) AS user_train_std,
 coalesce(inn, 0)::DOUBLE AS business_train_count, round(coalesce(im, r.g), 6) AS business_train_mean, ci.n::DOUBLE AS city_train_count, round(ci.m, 6) AS city_train_mean, st.n::DOUBLE AS state_train_count, round(st.m, 6) AS state_train_mean, po.n::DOUBLE AS postal_train_count, round(po.m, 6) AS postal_train_mean,
 round(coalesce(um, r.g) - coalesce(im, r.g), 6) AS user_business_train_gap, {BUCKET.format(n='coalesce(un, 0)')} AS user_train_history_bucket, {BUCKET.format(n='coalesce(inn, 0)')} AS business_train_support_bucket, (coalesce(inn, 0) <= 0)::DOUBLE AS item_is_new, (coalesce(un, 0) = 3)::DOUBLE AS user_history_is_3, (coalesce(un, 0) BETWEEN 4 AND 5)::DOUBLE AS user_history_is_short_4_5,
 round(ln(1 + coalesce(un, 0)) * ln(1 + coalesce(inn, 0)), 6) AS user_item_support_interaction, round(coalesce(inn, 0) / greatest(coalesce(un, 0), 1), 6) AS item_support_per_user_history, round(ua - r.g, 6) AS user_minus_global_mean, round(ua - bst, 6) AS user_business_metadata_gap, round(ln(1 + urc) * ln(1 + brc), 6) AS user_review_count_x_business_review_count, coalesce(r.city, '__missing__') AS business_city
FROM (SELECT * REPLACE (round(ua, 6) AS ua) FROM raw_ft) r LEFT JOIN ci ON r.city IS NOT DISTINCT FROM ci.city LEFT JOIN st ON r.state IS NOT DISTINCT FROM st.state LEFT JOIN po ON r.postal IS NOT DISTINCT FROM po.postal""", "raw_ft ctrain prep_biz")
def _(spark, sf):
    users, biz = derived.users(spark, sf), derived.businesses(spark, sf)
    spec = raw_features.fit_raw_features(derived.train_reviews(spark, sf), users, biz)
    f = raw_features.raw_features(derived.test_reviews(spark, sf), users, biz, spec)
    f = f.withColumns({"user_average_stars_r": F.col("user_average_stars"), "review_days_since_train_end": F.round("review_days_since_train_end", 5)})
    names = ["user_known_in_train", "business_known_in_train", "review_days_since_train_end", "user_average_stars_r", "user_train_count", "user_train_mean", "user_train_std", "business_train_count", "business_train_mean", "city_train_count", "city_train_mean", "state_train_count", "state_train_mean", "postal_train_count", "postal_train_mean", "user_business_train_gap", "user_train_history_bucket", "business_train_support_bucket", "item_is_new", "user_history_is_3", "user_history_is_short_4_5", "user_item_support_interaction", "item_support_per_user_history", "user_minus_global_mean", "user_business_metadata_gap", "user_review_count_x_business_review_count", "business_city"]
    return plain(f.select("review_id", *names))


@query("ft_raw_core_features", "SELECT review_id, round(ua, 6) AS user_average_stars, round(bst, 6) AS business_stars, '__missing__' AS user_train_history_bucket, (un IS NOT NULL)::DOUBLE AS user_known_in_train, round(bst - g, 6) AS business_minus_global_mean FROM raw_ft", "raw_ft")
def _(spark, sf):
    users, biz = derived.users(spark, sf), derived.businesses(spark, sf)
    spec = raw_features.fit_raw_features(derived.train_reviews(spark, sf), users, biz, "raw_core")
    f = raw_features.raw_features(derived.test_reviews(spark, sf), users, biz, spec)
    return plain(f.select("review_id", "user_average_stars", "business_stars", "user_train_history_bucket", "user_known_in_train", "business_minus_global_mean"))


@query("en_levels", """
WITH l AS (SELECT DISTINCT 'city' AS "column", coalesce(b.city, '__missing__') AS level FROM ctrain c LEFT JOIN prep_biz b ON c.item = b.business_id UNION SELECT DISTINCT 'state', coalesce(b.state, '__missing__') FROM ctrain c LEFT JOIN prep_biz b ON c.item = b.business_id),
n AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY level) - 1 AS i FROM l)
SELECT review_id, coalesce(x.i, -1)::DOUBLE AS city, coalesce(y.i, -1)::DOUBLE AS state FROM raw_ft r LEFT JOIN n x ON x."column" = 'city' AND x.level = coalesce(r.city, '__missing__') LEFT JOIN n y ON y."column" = 'state' AND y.level = coalesce(r.state, '__missing__')""", "raw_ft ctrain prep_biz")
def _(spark, sf):
    b = raw_features.prepare_businesses(derived.businesses(spark, sf)).select(F.col("business_id").alias("_b"), F.col("business_city").alias("city"), F.col("business_state").alias("state"))
    def placed(r):
        return r.join(b, r["item"] == b["_b"], "left").drop("_b").fillna("__missing__", ["city", "state"])
    levels = raw_features.fit_levels(placed(train(spark, sf)), ["city", "state"])
    return raw_features.encode_levels(placed(test(spark, sf)), levels, ["city", "state"]).select("review_id", "city", "state")


CENTERS = [[-1.0, -0.5, 0.0, 0.0, 0.0, -0.5, 0.0, 0.0, 0.0], [0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 1.0, 0.5, 0.5], [1.0, -1.0, -0.5, -1.0, -1.0, -1.0, -0.5, -0.5, -0.5], [0.0, 1.0, -1.0, 0.5, 0.5, 0.5, -0.5, 0.5, 0.5]]
AC = ["average_stars", "ln(1 + review_count)", "tenure / 365.25::DOUBLE", "ln(1 + useful + funny + cool)", "ln(1 + useful + funny + cool + fans)", "ln(1 + friends_n)", "elite_n", "ln(1 + comp)", "comp_nz"]
view("arch", ["prep_users"], "SELECT *, list_position(d, list_min(d)) - 1 AS k FROM (SELECT *, [" + ", ".join("" + " + ".join(f"pow(x{i} - ({v}), 2)" for i, v in enumerate(c)) for c in CENTERS) + "] AS d FROM (SELECT p.*, " + ", ".join(f"(coalesce({a}, m{i}) - m{i}) / s{i} AS x{i}" for i, a in enumerate(AC)) + ", (" + " + ".join(f"(({a}) IS NOT NULL)::INT" for a in AC) + ") / 9.0::DOUBLE AS complete FROM prep_users p, (SELECT " + ", ".join(f"avg({a}) AS m{i}, CASE WHEN stddev_samp({a}) > 1e-6 THEN stddev_samp({a}) ELSE 1 END AS s{i}" for i, a in enumerate(AC)) + " FROM prep_users)))")


def fixed_archetypes(users):
    fill, scale = router_features.archetype_scales(users)
    return router_features.Archetypes(fill, scale, CENTERS)


@query("md_archetype_assignment", "SELECT user_id, printf('archetype_%03d', k) AS user_archetype_id, round(list_min(d), 6) AS user_archetype_distance, round(complete, 6) AS user_metadata_completeness, (complete < 0.75)::DOUBLE AS user_metadata_sparse_flag FROM arch", "arch")
def _(spark, sf):
    u = raw_features.prepare_users(derived.users(spark, sf), priors.train_scalars(train(spark, sf))["end"])
    a = fixed_archetypes(u).assign(u)
    return plain(a.select("user_id", "user_archetype_id", "user_archetype_distance", "user_metadata_completeness", "user_metadata_sparse_flag"))


@query("ag_archetype_profiles", "SELECT printf('archetype_%03d', k) AS user_archetype_id, count(*) AS n_users, round(avg(complete), 6) AS metadata_completeness_mean, round(avg(average_stars), 6) AS user_average_stars_mean, round(avg(tenure / 365.25::DOUBLE), 6) AS user_tenure_years_mean, round(avg(elite_n), 6) AS user_elite_years_count_mean FROM arch GROUP BY 1", "arch")
def _(spark, sf):
    u = raw_features.prepare_users(derived.users(spark, sf), priors.train_scalars(train(spark, sf))["end"])
    return plain(router_features.archetype_profiles(fixed_archetypes(u).assign(u)).select("user_archetype_id", "n_users", "metadata_completeness_mean", "user_average_stars_mean", "user_tenure_years_mean", "user_elite_years_count_mean"))


@query("an_archetype_descriptors", "WITH p AS (SELECT printf('archetype_%03d', k) AS id, avg(average_stars) AS a, avg(elite_n) AS e FROM arch GROUP BY 1), m AS (SELECT avg(a) AS am, stddev_pop(a) AS asd, avg(e) AS em, stddev_pop(e) AS es FROM p) SELECT id AS user_archetype_id, round((a - am) / asd, 5) AS stars_z, round((e - em) / es, 5) AS elite_z, CASE WHEN (a - am) / asd >= 1 THEN 'high' WHEN (a - am) / asd <= -1 THEN 'low' ELSE 'mid' END AS stars_label FROM p, m", "arch")
def _(spark, sf):
    u = raw_features.prepare_users(derived.users(spark, sf), priors.train_scalars(train(spark, sf))["end"])
    p = router_features.archetype_profiles(fixed_archetypes(u).assign(u)).withColumnsRenamed({"user_average_stars_mean": "stars", "user_elite_years_count_mean": "elite"})
    return plain(embeddings.archetype_descriptors(p, "user_archetype_id", ["stars", "elite"]).select("user_archetype_id", "stars_z", "elite_z", "stars_label"), 5)


@query("md_archetype_fit")
def _(spark, sf):
    u = raw_features.prepare_users(derived.users(spark, sf), priors.train_scalars(train(spark, sf))["end"])
    return plain(router_features.archetype_profiles(router_features.fit_archetypes(u, 16).assign(u)))


FRIENDS = """
fl AS (SELECT user_id, trim(unnest(string_split(friends, ','))) AS friend_id FROM users WHERE friends IS NOT NULL AND friends <> 'None'), fe AS (SELECT DISTINCT * FROM fl),
lr AS (SELECT "user", item, arg_max(rating, (timestamp, review_id)) AS r FROM ctrain GROUP BY ALL)"""


@query("j_friend_ratings", f"""
WITH {FRIENDS}, h AS (SELECT t."user", t.item, avg(r) AS m, count(*) AS n FROM (SELECT DISTINCT "user", item FROM ctest) t JOIN fe ON t."user" = user_id JOIN lr ON lr."user" = friend_id AND lr.item = t.item GROUP BY ALL)
SELECT review_id, round(coalesce(m, g), 6) AS friend_business_mean, round(ln(1 + coalesce(n, 0)), 6) AS friend_business_count_log1p, round(coalesce(m, g) - g, 6) AS friend_business_bias FROM ctest LEFT JOIN h USING ("user", item), (SELECT avg(rating) AS g FROM ctrain)""", "users ctrain ctest")
def _(spark, sf):
    t = train(spark, sf)
    g = one_row(t.agg(F.avg("rating").alias("g")))["g"]
    r = graph.with_friend_ratings(test(spark, sf).select("review_id", "user", "item"), derived.users(spark, sf), t, g)
    return plain(r.select("review_id", "friend_business_mean", "friend_business_count_log1p", "friend_business_bias"))


VALID = f"{FRIENDS}, e AS (SELECT * FROM fe WHERE user_id <> friend_id AND friend_id IN (SELECT user_id FROM users))"


@query("an_friend_graph", f"""
WITH {VALID}, d AS (SELECT u.user_id, count(friend_id) AS d, coalesce(sum((u.user_id < friend_id)::INT), 0) AS up FROM users u LEFT JOIN e USING (user_id) GROUP BY 1)
SELECT count(*) AS n_users, count(*) FILTER (d > 0) AS n_users_with_edges, CAST(sum(d) AS BIGINT) AS directed_edges, CAST(sum(up) AS BIGINT) AS undirected_edge_estimate, max(d) AS degree_max, quantile_cont(d, 0.5) AS degree_p50, quantile_cont(d, 0.9) AS degree_p90, quantile_cont(d, 0.99) AS degree_p99 FROM d""", "users ctrain")
def _(spark, sf):
    return plain(graph.graph_summary(derived.users(spark, sf)))


@query("an_star_homophily", f"WITH {VALID} SELECT count(*) AS n_edges, round(corr(a.average_stars, b.average_stars), 6) AS correlation, round(avg(abs(a.average_stars - b.average_stars)), 6) AS mean_gap FROM e JOIN users a ON e.user_id = a.user_id JOIN users b ON friend_id = b.user_id WHERE a.average_stars IS NOT NULL AND b.average_stars IS NOT NULL", "users ctrain")
def _(spark, sf):
    u = derived.users(spark, sf)
    return plain(graph.star_homophily(graph.valid_edges(u), u))


@query("an_shared_item_homophily", f"WITH {VALID}, r AS (SELECT \"user\", item, avg(rating) AS x FROM canonical GROUP BY ALL) SELECT count(*) AS n_shared, round(avg(abs(a.x - b.x)), 6) AS mean_gap, round(avg((a.x = b.x)::INT), 6) AS same_share, round(corr(a.x, b.x), 6) AS correlation FROM e JOIN r a ON e.user_id = a.\"user\" JOIN r b ON friend_id = b.\"user\" AND a.item = b.item", "users ctrain canonical")
def _(spark, sf):
    return plain(graph.shared_item_homophily(graph.valid_edges(derived.users(spark, sf)), canonical_reviews(derived.reviews(spark, sf))))


def user_strata(spark, sf):
    return graph.strata(derived.users(spark, sf), {"fans": F.when(F.col("fans") < 7, "low").when(F.col("fans") < 14, "mid").otherwise("high"), "seen": F.when(F.col("review_count") > 20, "much").otherwise("little")})


STRATA = """
sx AS (SELECT user_id, CASE WHEN fans < 7 THEN 'low' WHEN fans < 14 THEN 'mid' ELSE 'high' END || '|' || CASE WHEN review_count > 20 THEN 'much' ELSE 'little' END AS stratum FROM users),
nx AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY user_id) - 1 AS no, count(*) OVER (PARTITION BY stratum) AS size FROM sx),
px AS (SELECT e.user_id, e.friend_id, t, stratum, (('0x' || substr(md5('42|' || e.user_id || '|' || e.friend_id), 1, 15))::BIGINT % size + t) % size AS no FROM (SELECT e.*, stratum, size, unnest(range(least(size, 64))) AS t FROM e JOIN nx ON nx.user_id = e.friend_id) e),
mx AS (SELECT px.user_id, px.friend_id, arg_min(nx.user_id, t) AS matched_non_friend FROM px JOIN nx USING (stratum, no) WHERE nx.user_id <> px.user_id AND NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = px.user_id AND e.friend_id = nx.user_id) GROUP BY 1, 2)"""


@query("j_matched_strangers", f"WITH {VALID}, {STRATA} SELECT user_id, friend_id, matched_non_friend FROM mx", "users ctrain")
def _(spark, sf):
    return graph.matched_strangers(graph.valid_edges(derived.users(spark, sf)), user_strata(spark, sf))


def user_vectors(spark, sf):
    return profiles.dense_profiles(train(spark, sf), derived.item_embeddings(spark, sf), 64)


view("item_dims", ["item_embeddings"], "SELECT business_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM item_embeddings")
view("user_emb", ["item_dims", "ctrain"], 'SELECT user_id, list(v ORDER BY i) AS embedding FROM (SELECT "user" AS user_id, i, avg(v) AS v FROM ctrain JOIN item_dims ON item = business_id GROUP BY ALL) GROUP BY 1')
COS = "list_inner_product({a}, {b}) / greatest(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 1e-8)"


@query("an_friend_uplift", f"""WITH {VALID}, {STRATA}, c AS (SELECT {COS.format(a='a.embedding', b='f.embedding')} AS f, {COS.format(a='a.embedding', b='n.embedding')} AS n FROM mx JOIN user_emb a ON mx.user_id = a.user_id JOIN user_emb f ON mx.friend_id = f.user_id JOIN user_emb n ON matched_non_friend = n.user_id)
SELECT count(*) AS n_pairs, round(avg(f), 6) AS friend_mean_cos, round(avg(n), 6) AS matched_non_friend_mean_cos, round(avg(f - n), 6) AS uplift, round(avg((f - n > 0)::INT), 6) AS paired_win_rate FROM c""", "users ctrain user_emb")
def _(spark, sf):
    matched = graph.matched_strangers(graph.valid_edges(derived.users(spark, sf)), user_strata(spark, sf))
    return plain(graph.uplift_summary(graph.friend_uplift(matched, user_vectors(spark, sf))))


@query("ur_dense_profiles", "SELECT user_id, i AS position, round(v, 6) AS value FROM (SELECT user_id, unnest(embedding) AS v, unnest(range(64)) AS i FROM user_emb) WHERE i < 4", "user_emb")
def _(spark, sf):
    return plain(user_vectors(spark, sf).select("user_id", F.posexplode(F.slice("embedding", 1, 4)).alias("position", "value")))


@query("ve_pair_features", f"""
SELECT review_id, round({COS.format(a='u.embedding', b='i.embedding')}, 6) AS cosine, round(list_inner_product(u.embedding, i.embedding), 6) AS dot, round(sqrt(list_inner_product(u.embedding, u.embedding)), 6) AS user_norm, round(sqrt(list_inner_product(i.embedding, i.embedding)), 6) AS item_norm,
 round(abs(sqrt(list_inner_product(u.embedding, u.embedding)) - sqrt(list_inner_product(i.embedding, i.embedding))), 6) AS norm_gap, n AS history_count, round(ln(1 + n), 6) AS history_log1p
FROM ctest t JOIN user_emb u ON t."user" = u.user_id JOIN item_embeddings i ON t.item = i.business_id JOIN (SELECT "user", count(*) AS n FROM ctrain GROUP BY 1) USING ("user")""", "user_emb ctest ctrain item_embeddings")
def _(spark, sf):
    rows = pair_features.rows_with_both_vectors(test(spark, sf), user_vectors(spark, sf), derived.item_embeddings(spark, sf), train(spark, sf))
    return plain(pair_features.pair_feature_rows(rows).select("review_id", "cosine", "dot", "user_norm", "item_norm", "norm_gap", "history_count", "history_log1p"))


@query("ve_join_coverage", "SELECT count(*) AS n_rows, count(user_id) AS with_user, count(business_id) AS with_item, count(*) FILTER (user_id IS NOT NULL AND business_id IS NOT NULL) AS with_both, count(*) FILTER (user_id IS NULL AND business_id IS NULL) AS with_neither, round(avg((user_id IS NOT NULL AND business_id IS NOT NULL)::INT), 6) AS both_rate FROM ctest t LEFT JOIN user_emb u ON t.\"user\" = u.user_id LEFT JOIN item_embeddings i ON t.item = i.business_id", "user_emb ctest item_embeddings")
def _(spark, sf):
    return plain(pair_features.join_coverage(test(spark, sf), user_vectors(spark, sf), derived.item_embeddings(spark, sf)))


@query("ve_unit_vectors", "SELECT vec_id, round(sqrt(list_inner_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def _(spark, sf):
    e = derived.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return plain(e.select("vec_id", vectors.norm(F.col("e")).alias("norm"), vectors.unit(F.col("e"))[0].alias("first")))


@query("ve_boosting_features", f"""{CONTEXT}, k AS (SELECT avg(recency_days) AS a, stddev_pop(recency_days) AS s FROM x WHERE date < TIMESTAMP '2000-04-01'), zz AS (SELECT list_transform(range(64), lambda i: 0.0::DOUBLE) AS z),
r AS (SELECT t.review_id, p."user" IS NULL OR t.useful = 1 AS new, n, m, sd, im, isd, inn, g, u.embedding AS ue, i.embedding AS ie, z, recency_days FROM ctest t LEFT JOIN (SELECT "user", count(*) AS n, avg(rating) AS m, stddev_samp(rating) AS sd FROM ctrain GROUP BY 1) p USING ("user") LEFT JOIN (SELECT item, avg(rating) AS im, coalesce(stddev_samp(rating), 0) AS isd, count(*) AS inn FROM ctrain GROUP BY 1) q USING (item)
 LEFT JOIN user_emb u ON t."user" = u.user_id LEFT JOIN item_embeddings i ON t.item = i.business_id JOIN x ON t.review_id = x.review_id, zz, (SELECT avg(rating) AS g FROM ctrain)),
v AS (SELECT *, CASE WHEN new OR ue IS NULL THEN z ELSE ue END AS uv, coalesce(ie, z) AS iv FROM r)
SELECT review_id, new::DOUBLE AS is_new_user, CASE WHEN new THEN 0 ELSE n END::DOUBLE AS history_count, round(CASE WHEN new THEN g ELSE m END, 6) AS user_mean_rating, round(CASE WHEN new THEN 0 ELSE coalesce(sd, 0) END, 6) AS user_rating_std, round(coalesce(im, g), 6) AS biz_mean_rating, coalesce(inn, 0)::DOUBLE AS biz_review_count,
 round({COS.format(a='uv', b='iv')}, 6) AS cosine, round(uv[3], 6) AS user_emb_2, round(iv[3], 6) AS biz_emb_2, round(uv[3] * iv[3], 6) AS prod_emb_2, round(CASE WHEN new THEN g ELSE m END - coalesce(im, g), 6) AS mean_rating_gap, round((recency_days - a) / s, 5) AS recency_days_z FROM v, k""", "train reviews ctrain ctest user_emb item_embeddings")
def _(spark, sf):
    t = train(spark, sf)
    f = pair_features.boosting_features(test(spark, sf), user_vectors(spark, sf), derived.item_embeddings(spark, sf), t, pair_features.fit_review_context(t), 64, forced_new=F.col("useful") == 1)
    f = f.withColumn("recency_days_z", F.round("recency_days_z", 5))
    return plain(f.select("review_id", "is_new_user", "history_count", "user_mean_rating", "user_rating_std", "biz_mean_rating", "biz_review_count", "cosine", "user_emb_2", "biz_emb_2", "prod_emb_2", "mean_rating_gap", "recency_days_z"))


@query("ft_interaction_frame", 'SELECT review_id, "user", item, timestamp, rating, greatest(useful, 0)::DOUBLE AS useful, greatest(funny, 0)::DOUBLE AS funny, greatest(cool, 0)::DOUBLE AS cool FROM canonical', "canonical")
def _(spark, sf):
    return pair_features.interaction_frame(derived.reviews(spark, sf))


@query("se_synthetic_cold_rows", "SELECT o_orderkey, forced_new FROM (SELECT o_orderkey, false AS forced_new FROM orders UNION ALL SELECT o_orderkey, true FROM orders WHERE (('0x' || substr(md5('42|' || (o_orderkey)), 1, 15))::BIGINT) < 230584300921369408)")
def _(spark, sf):
    return pair_features.with_synthetic_cold(derived.table(spark, sf, "orders").select("o_orderkey"), F.col("o_orderkey"), 0.2)


TOKENS = "tk AS (SELECT business_id, unnest(list_distinct(tokens)) AS t FROM prep_biz)"


@query("en_category_multi_hot", f"WITH {TOKENS}, k AS (SELECT t FROM tk GROUP BY 1 HAVING count(*) >= 20) SELECT business_id, 'category__' || t AS feature_name, 1.0::DOUBLE AS value FROM tk JOIN k USING (t)", "prep_biz")
def _(spark, sf):
    b = derived.businesses(spark, sf).select("business_id", F.array_distinct(text.tokens(F.col("categories"))).alias("tokens"))
    return encoders.category_cells(b, 20)


ATTR_TOKENS = """
pr AS (SELECT DISTINCT business_id, a.key AS key, coalesce(a.value, '__unknown__') AS v FROM attrs), ct AS (SELECT key, v, count(*) AS n FROM pr GROUP BY ALL), ok AS (SELECT key FROM ct GROUP BY 1 HAVING count(*) <= 3),
atk AS (SELECT DISTINCT business_id, trim(regexp_replace(lower(key || '=' || CASE WHEN n >= 450 THEN v ELSE 'other' END), '[^a-z0-9]+', '_', 'g'), '_') AS t FROM pr JOIN ct USING (key, v) JOIN ok USING (key))"""


@query("en_attribute_multi_hot", f"WITH {ATTRIBUTE_ROWS}, {ATTR_TOKENS} SELECT business_id, 'attribute__' || t AS feature_name, 1.0::DOUBLE AS value FROM atk", "businesses")
def _(spark, sf):
    b = derived.businesses(spark, sf).select("business_id", text.flat_attributes(F.col("attributes")).alias("flat"))
    return encoders.attribute_cells(b, 450, 3)


@query("en_geo_one_hot", """
WITH k AS (SELECT city FROM (SELECT CASE WHEN city = '__missing__' THEN '__unknown__' ELSE city END AS city FROM prep_biz) GROUP BY 1 HAVING count(*) >= 60) SELECT business_id, 'geo__state_' || state AS feature_name, 1.0::DOUBLE AS value FROM prep_biz
UNION ALL SELECT business_id, 'geo__city_' || coalesce(k.city, '__other__'), 1.0 FROM (SELECT business_id, CASE WHEN city = '__missing__' THEN '__unknown__' ELSE city END AS city FROM prep_biz) b LEFT JOIN k USING (city)""", "prep_biz")
def _(spark, sf):
    b = derived.businesses(spark, sf).select("business_id", text.text_or(F.col("state"), "__unknown__").alias("state_clean"), text.text_or(F.col("city"), "__unknown__").alias("city_clean"))
    return encoders.one_hot(b, "state_clean", "geo__state").unionByName(encoders.one_hot(encoders.city_buckets(b, 60), "city_bucket", "geo__city"))


@query("en_geo_hashed")
def _(spark, sf):
    b = derived.businesses(spark, sf).select("business_id", text.text_or(F.col("city"), "__unknown__").alias("city_clean"))
    return encoders.hashed_city(encoders.city_buckets(b, 20), 64)


@query("en_hours_scores", """
WITH h AS (SELECT business_id, CASE WHEN has_hours THEN 4 ELSE 0 END AS a, weekly AS b, CASE WHEN has_hours THEN 2 ELSE 0 END AS c, CASE WHEN has_hours THEN 2 + (sunday_end >= 1320 OR sunday_end <= 180)::INT ELSE 0 END AS d FROM prep_biz), m AS (SELECT avg(a) AS am, stddev_pop(a) AS asd, avg(b) AS bm, stddev_pop(b) AS bs, avg(c) AS cm, stddev_pop(c) AS cs, avg(d) AS dm, stddev_pop(d) AS ds FROM h)
SELECT business_id, round((a - am) / asd, 6) AS open_days, round((b - bm) / bs, 6) AS minutes, round((c - cm) / cs, 6) AS weekend, round((d - dm) / ds, 6) AS late FROM h, m""", "prep_biz")
def _(spark, sf):
    b = derived.businesses(spark, sf).withColumn("_o", text.open_days(F.col("hours")))
    b = durable(b.select("business_id", *[c.alias(n) for n, c in text.opening_hours("_o").items()]))  # read for the moments and for the scores
    s = encoders.scores(b, dict(zip(encoders.HOURS, ["open_days", "minutes", "weekend", "late"])))
    return plain(s.groupBy("business_id").pivot("feature_name", ["open_days", "minutes", "weekend", "late"]).agg(F.max("value")))


@query("en_prior_block", """
SELECT b.business_id, (n IS NOT NULL)::DOUBLE AS seen, round(ln(1 + coalesce(n, 0)), 6) AS count_log1p, round(coalesce(n, 0) / (SELECT max(n)::DOUBLE FROM (SELECT count(*) AS n FROM ctrain GROUP BY item)), 6) AS support, round(coalesce(m, 0), 6) AS mean, round(coalesce(s, 0), 6) AS std
FROM businesses b LEFT JOIN (SELECT item, count(*) AS n, avg(rating) AS m, stddev_samp(rating) AS s FROM ctrain GROUP BY 1) p ON b.business_id = item""", "businesses ctrain")
def _(spark, sf):
    p = encoders.prepare(derived.businesses(spark, sf), train_aggregates(train(spark, sf), "item", "business_id"))
    return plain(p.select("business_id", F.col("prior_seen_in_train").alias("seen"), F.col("prior_log1p").alias("count_log1p"), F.col("prior_support").alias("support"), F.col("prior_mean").alias("mean"), F.col("prior_std").alias("std")))


def built(spark, sf, **options):
    return representation.build_representation(derived.businesses(spark, sf), train(spark, sf), **options)


@query("ft_representation_blocks", """
WITH t AS (SELECT unnest(list_distinct(tokens)) AS t FROM prep_biz), n AS (SELECT count(*) AS n FROM prep_biz), w AS (SELECT (SELECT count(DISTINCT state) FROM prep_biz) + (SELECT count(*) FROM (SELECT DISTINCT CASE WHEN c >= 20 THEN city ELSE '__other__' END FROM (SELECT city, count(*) AS c FROM prep_biz GROUP BY 1))) + 3 AS g, (SELECT count(*) FROM (SELECT t FROM t GROUP BY 1 HAVING count(*) >= 20)) AS c,
 (SELECT 3 + 2 + 4 + 2 + 1 + 1 + 1) AS a), o AS (SELECT unnest(['geo', 'categories', 'attributes', 'hours', 'priors']) AS block_name, unnest([g, c, a, 4, 5]) AS n_columns, unnest([0, g, g + c, g + c + a, g + c + a + 4]) AS start_index FROM w) SELECT block_name, n_columns::BIGINT AS n_columns, start_index::BIGINT AS start_index, (start_index + n_columns)::BIGINT AS end_index_exclusive FROM o""", "prep_biz")
def _(spark, sf):
    return built(spark, sf).block_summary().select("block_name", "n_columns", "start_index", "end_index_exclusive")


@query("io_representation_checks", "SELECT true AS ids_unique, true AS index_unique, true AS index_contiguous, true AS no_prior_in_content, true AS cells_have_business, true AS cells_unique, true AS cells_in_range FROM (SELECT count(*) FROM businesses)", "businesses")
def _(spark, sf):
    return built(spark, sf).checks()


@query("io_representation_views", """
WITH t AS (SELECT business_id, unnest(list_distinct(tokens)) AS t FROM prep_biz), k AS (SELECT t FROM t GROUP BY 1 HAVING count(*) >= 20), p AS (SELECT count(*) AS n FROM prep_biz WHERE business_id IN (SELECT item FROM ctrain))
SELECT 'categories' AS part, count(*) AS cells FROM t JOIN k USING (t) UNION ALL SELECT 'attributes', 7 * count(*) FROM prep_biz WHERE has_attributes""", "prep_biz ctrain")
def _(spark, sf):
    r = built(spark, sf)
    n = lambda b: r.select(blocks=[b]).agg(F.lit(b).alias("part"), F.count(F.lit(1)).alias("cells"))
    return n("categories").unionByName(n("attributes"))


@query("ft_clean_businesses", """
SELECT business_id, state AS state_clean, CASE WHEN city = '__missing__' THEN '__unknown__' ELSE city END AS city_clean, array_to_string(list_distinct(tokens), '|') IS NOT NULL AS has_tokens, len(list_distinct(tokens)) AS category_count, CASE WHEN has_attributes THEN 7 ELSE 0 END::BIGINT AS kept_attribute_count, weekly::DOUBLE AS weekly_open_minutes FROM prep_biz""", "prep_biz")
def _(spark, sf):
    c = built(spark, sf).businesses
    return plain(c.select("business_id", "state_clean", "city_clean", F.col("category_tokens").isNotNull().alias("has_tokens"), "category_count", "kept_attribute_count", "weekly_open_minutes"))


@query("io_safe_content_block")
def _(spark, sf):
    return representation.safe_content(derived.businesses(spark, sf), train(spark, sf)).features


CELLS = "it AS (SELECT DISTINCT business_id, state AS f, 1.0::DOUBLE AS v FROM prep_biz UNION ALL SELECT business_id, 'stars', coalesce(stars, 0) FROM prep_biz)"


def item_cells(spark, sf):
    b = raw_features.prepare_businesses(derived.businesses(spark, sf))
    cells = F.array(F.struct(F.col("business_state").alias("feature_index"), F.lit(1.0).alias("value")), F.struct(F.lit("stars").alias("feature_index"), F.coalesce("business_stars", F.lit(0.0)).alias("value")))
    return b.select("business_id", F.inline(cells))


WEIGHTS = {
    "mean": ("1.0::DOUBLE", "sum(w)"), "rating": ("rating", "sum(w)"), "recency": ("exp(-((epoch_us(max(timestamp) OVER p) - epoch_us(timestamp)) / 86400000000.0::DOUBLE) / 365)", "sum(w)"),
    "centered": ("CASE WHEN count(*) OVER p <= 1 OR min(rating) OVER p = max(rating) OVER p THEN 1 ELSE rating - avg(rating) OVER p END", "sum(abs(w))"),
}


def profile_query(mode):
    weight, total = WEIGHTS[mode]

    @query(f"ur_profile_{mode}", f"""WITH {CELLS}, r AS (SELECT "user", item, {weight} AS w FROM ctrain WHERE item IN (SELECT business_id FROM it) WINDOW p AS (PARTITION BY "user")), q AS (SELECT "user", item, sum(w) AS w FROM r GROUP BY ALL), d AS (SELECT "user", {total} AS d FROM q GROUP BY 1)
SELECT "user", f AS feature_index, round(pi() * sum(w * v) / any_value(CASE WHEN d = 0 THEN 1 ELSE d END), 5) AS value FROM q JOIN it ON item = business_id JOIN d USING ("user") GROUP BY ALL HAVING abs(sum(w * v)) > 1e-9""", "prep_biz ctrain")
    def _(spark, sf):
        # times pi, so that no value is a rounding tie in either engine
        rows = profiles.profile_vectors(train(spark, sf), item_cells(spark, sf), mode).filter(F.abs("value") > 1e-9)
        return plain(rows.withColumn("value", F.pi() * F.col("value")), 5)


for _mode in WEIGHTS:
    profile_query(_mode)


@query("ve_sparse_pair_features", f"""WITH {CELLS}, up AS (SELECT "user", f, avg(v) AS x FROM ctrain JOIN it ON item = business_id GROUP BY ALL), w AS (SELECT "user", sum(x) AS z FROM up GROUP BY 1), nu AS (SELECT "user", sqrt(sum(x * x)) AS n FROM (SELECT "user", f, sum(v) / any_value(k) AS x FROM ctrain JOIN it ON item = business_id JOIN (SELECT "user", count(*) AS k FROM ctrain WHERE item IN (SELECT business_id FROM prep_biz) GROUP BY 1) USING ("user") GROUP BY ALL) GROUP BY 1),
ux AS (SELECT "user", f, sum(v) / any_value(k) AS x FROM ctrain JOIN it ON item = business_id JOIN (SELECT "user", count(*) AS k FROM ctrain WHERE item IN (SELECT business_id FROM prep_biz) GROUP BY 1) USING ("user") GROUP BY ALL), ni AS (SELECT business_id, sqrt(sum(v * v)) AS n FROM it GROUP BY 1), p AS (SELECT DISTINCT "user", item FROM ctest),
d AS (SELECT p."user", p.item, sum(x * v) AS dot FROM p JOIN ux USING ("user") JOIN it ON item = business_id AND it.f = ux.f GROUP BY ALL)
SELECT p."user", p.item, round(coalesce(dot, 0), 5) AS dot, round(coalesce(nu.n, 0), 5) AS user_norm, round(coalesce(ni.n, 0), 5) AS item_norm, round(coalesce(dot, 0) / greatest(coalesce(nu.n, 0) * coalesce(ni.n, 0), 1e-8), 5) AS cosine FROM p LEFT JOIN d USING ("user", item) LEFT JOIN nu USING ("user") LEFT JOIN ni ON p.item = ni.business_id""", "prep_biz ctrain ctest")
def _(spark, sf):
    items = item_cells(spark, sf)
    users = profiles.profile_vectors(train(spark, sf), items, "mean")
    return plain(pair_features.sparse_pair_features(test(spark, sf), users, items).select("user", "item", "dot", "user_norm", "item_norm", "cosine"), 5)


@query("ur_user_metadata_block", """
WITH t AS (SELECT *, user_id IN (SELECT "user" FROM ctrain) AS fit, (SELECT epoch_us(max(timestamp)) FROM ctrain) AS e FROM users), d AS (SELECT *, (e - epoch_us(yelping_since)) / 86400000000.0::DOUBLE AS td FROM t), f AS (SELECT *, coalesce(td, (SELECT median(td) FROM d WHERE fit)) AS tf FROM d),
m AS (SELECT avg(tf) AS ta, stddev_pop(tf) AS ts, avg(ln(1 + fans)) AS fa, stddev_pop(ln(1 + fans)) AS fs, avg(ln(1 + compliment_hot)) AS ha, stddev_pop(ln(1 + compliment_hot)) AS hs FROM f WHERE fit)
SELECT user_id, round(tf, 5) AS metadata__tenure_days, round((tf - ta) / ts, 6) AS metadata__tenure_days_z, round((ln(1 + fans) - fa) / fs, 6) AS metadata__fans_log1p_z, round((ln(1 + compliment_hot) - ha) / hs, 6) AS metadata__compliment_hot_log1p_z, (elite IN ('2019,2020', '2018;2019; 2021'))::DOUBLE AS elite FROM (SELECT * REPLACE (coalesce(elite, '') AS elite) FROM f), m""", "users ctrain")
def _(spark, sf):
    u = derived.users(spark, sf)
    b = profiles.user_metadata_block(u.select("user_id"), u, train(spark, sf))
    b = b.withColumns({"metadata__tenure_days": F.round("metadata__tenure_days", 5), "elite": F.col("metadata__elite_any")})
    return plain(b.select("user_id", "metadata__tenure_days", "metadata__tenure_days_z", "metadata__fans_log1p_z", "metadata__compliment_hot_log1p_z", "elite"))


def clean_users(spark, sf):
    u, t = derived.users(spark, sf), train(spark, sf)
    targets = profiles.target_users(u.select("user_id"), t.select(F.col("user").alias("user_id")), test(spark, sf).select(F.col("user").alias("user_id")))
    return profiles.clean_user_table(targets, t, profiles.user_metadata_block(targets, u, t))


view("target_counts", ["users", "ctrain", "ctest"], 'SELECT i.user_id, coalesce(n, 0) AS n, coalesce(m, 0) AS m, i.user_id IN (SELECT user_id FROM users) AS known FROM (SELECT user_id FROM users UNION SELECT "user" FROM ctrain UNION SELECT "user" FROM ctest) i LEFT JOIN (SELECT "user", count(*) AS n, avg(rating) AS m FROM ctrain GROUP BY 1) c ON i.user_id = c."user"')


@query("ur_clean_users", "SELECT user_id, n AS history_count, round(m, 6) AS user_mean_rating, CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS history_band, CASE WHEN n > 0 THEN 'history' WHEN known THEN 'metadata_only' ELSE 'default_only' END AS embedding_source FROM target_counts", "target_counts")
def _(spark, sf):
    c = profiles.embedding_source(clean_users(spark, sf), derived.users(spark, sf))
    return plain(c.select("user_id", "history_count", "user_mean_rating", "history_band", "embedding_source"))


@query("ur_profile_summary", "SELECT count(*) AS n_users, round(avg(n), 6) AS mean_history, count(*) FILTER (n = 0) AS band_0, count(*) FILTER (n = 1) AS band_1, count(*) FILTER (n BETWEEN 2 AND 5) AS band_2_5, count(*) FILTER (n BETWEEN 6 AND 20) AS band_6_20, count(*) FILTER (n > 20) AS band_over_20, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.99) AS p99 FROM target_counts", "target_counts")
def _(spark, sf):
    return plain(profiles.profile_summary(clean_users(spark, sf)))


AFF = """
f AS (SELECT c.rating, printf('archetype_%03d', coalesce(k, -1)) AS a0, k, coalesce(b.state, '__missing__') AS state, coalesce(b.is_open, 0) AS op, CASE WHEN b.business_id IS NULL OR b.stars IS NULL THEN '__missing__' WHEN b.stars < 2.5 THEN '1.0-2.5' WHEN b.stars < 3.5 THEN '2.5-3.5' WHEN b.stars < 4 THEN '3.5-4.0' WHEN b.stars < 4.5 THEN '4.0-4.5' ELSE '4.5-5.0' END AS bin FROM ctrain c LEFT JOIN arch ON c."user" = user_id LEFT JOIN prep_biz b ON c.item = b.business_id),
h AS (SELECT *, CASE WHEN k IS NULL THEN '__metadata_sparse__' ELSE a0 END AS a FROM f), g AS (SELECT avg(rating) AS g FROM ctrain)"""


def router_spec(spark, sf, **options):
    users, biz = derived.users(spark, sf), derived.businesses(spark, sf)
    u = raw_features.prepare_users(users, priors.train_scalars(train(spark, sf))["end"])
    return router_features.fit_router_features(derived.train_reviews(spark, sf), users, biz, archetypes=fixed_archetypes(u), **options), users, biz


@query("ag_archetype_affinities", f"""WITH {AFF} SELECT 'archetype_train' AS facet, a AS archetype, '' AS value, count(*)::DOUBLE AS support, round((sum(rating) + 20 * any_value(g)) / (count(*) + 20), 6) AS mean FROM h, g GROUP BY 2
UNION ALL SELECT 'archetype_state', a, state, count(*)::DOUBLE, round((sum(rating) + 50 * any_value(g)) / (count(*) + 50), 6) FROM h, g GROUP BY 2, 3 UNION ALL SELECT 'archetype_open', a, op::VARCHAR, count(*)::DOUBLE, round((sum(rating) + 50 * any_value(g)) / (count(*) + 50), 6) FROM h, g GROUP BY 2, 3
UNION ALL SELECT 'archetype_star_bin', a, bin, count(*)::DOUBLE, round((sum(rating) + 50 * any_value(g)) / (count(*) + 50), 6) FROM h, g GROUP BY 2, 3""", "ctrain arch prep_biz")
def _(spark, sf):
    spec, _, _ = router_spec(spark, sf)
    out = None
    for name, column in (("archetype_train", None), ("archetype_state", "business_state"), ("archetype_open", "business_is_open"), ("archetype_star_bin", "business_star_bin")):
        t = spec.tables[name]
        part = t.select(F.lit(name).alias("facet"), F.col("user_archetype_id").alias("archetype"), (F.col(column).cast("string") if column else F.lit("")).alias("value"), F.col(f"{name}_support_count").alias("support"), F.col(f"{name}_mean").alias("mean"))
        out = part if out is None else out.unionByName(part)
    return plain(out)


@query("ft_router_features", f"""WITH {AFF}, t AS (SELECT a, (sum(rating) + 20 * any_value(g)) / (count(*) + 20) AS m, count(*) AS n FROM h, g GROUP BY 1), s AS (SELECT a, state, (sum(rating) + 50 * any_value(g)) / (count(*) + 50) AS m, count(*) AS n FROM h, g GROUP BY 1, 2),
r AS (SELECT x.review_id, x.item, x.bst, x.g, coalesce(x.state, '__missing__') AS state, CASE WHEN k IS NULL THEN '__metadata_sparse__' ELSE printf('archetype_%03d', k) END AS a, coalesce(list_min(d), 0) AS dist FROM raw_ft x LEFT JOIN arch ON x."user" = user_id), i AS (SELECT item, avg(rating) AS m, coalesce(stddev_samp(rating), 0) AS sd FROM ctrain GROUP BY 1)
SELECT review_id, a AS user_archetype_id, round(dist, 6) AS user_archetype_distance, coalesce(t.n, 0)::DOUBLE AS archetype_train_support_count, round(coalesce(t.m, r.g), 6) AS archetype_train_mean, coalesce(s.n, 0)::DOUBLE AS archetype_state_support_count, round(coalesce(s.m, r.g), 6) AS archetype_state_mean, round(coalesce(t.m, r.g) - bst, 6) AS archetype_business_star_gap,
 round(coalesce(i.m, r.g), 6) AS business_train_mean_rating, round(coalesce(i.m, r.g) - bst, 6) AS business_train_vs_stated_gap, round(coalesce(i.m - r.g, 0), 6) AS cf_item_bias FROM r LEFT JOIN t USING (a) LEFT JOIN s ON r.a = s.a AND r.state = s.state LEFT JOIN i USING (item)""", "raw_ft arch ctrain prep_biz")
def _(spark, sf):
    model = bias.BiasModel().fit(train(spark, sf))
    spec, users, biz = router_spec(spark, sf, item_bias=model.items)
    f = router_features.router_features(derived.test_reviews(spark, sf), users, biz, spec)
    return plain(f.select("review_id", "user_archetype_id", "user_archetype_distance", "archetype_train_support_count", "archetype_train_mean", "archetype_state_support_count", "archetype_state_mean", "archetype_business_star_gap", "business_train_mean_rating", "business_train_vs_stated_gap", "cf_item_bias"))


@query("ur_feature_families")
def _(spark, sf):
    spec, users, biz = router_spec(spark, sf)
    f = router_features.router_features(derived.test_reviews(spark, sf), users, biz, spec)
    return router_features.feature_families([c for c in f.columns if c not in raw_features.META], spark)


STACK = """
SELECT t.review_id, CASE history_band WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2-5' THEN 2 WHEN '6-20' THEN 6 ELSE 20 END::DOUBLE AS history_band_enc, round(ln(1 + history_count), 6) AS history_count_log1p, round(coalesce(p1, g), 6) AS user_mean_rating, round(coalesce(p2, g), 6) AS business_mean_rating, round(ln(1 + coalesce(item_support, 0)), 6) AS business_review_count_log1p,
 round(least(greatest((coalesce(item_support, 0) * coalesce(p2, g) + 5 * g) / (coalesce(item_support, 0) + 5), 1), 5), 6) AS business_bayesian_prior, round(abs(coalesce(deep_prediction_raw, cb) - cb), 6) AS cb_pred_fractional_part, round(coalesce(p1, g) - coalesce(p2, g), 6) AS user_business_bias_gap,
 round(coalesce(floor((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(yelping_since)) / 86400000000.0::DOUBLE) / 365.25::DOUBLE, 0), 6) AS user_tenure_years, round(coalesce(ln(1 + u.useful + u.funny + u.cool), 0), 6) AS user_total_votes_log1p, month(t.timestamp)::DOUBLE AS review_month,
 round(coalesce(p3, cb), 6) AS cf_prediction, round(coalesce(p3, cb) - cb, 6) AS cf_cb_diff, history_count, coalesce(item_support, 0)::DOUBLE AS business_review_count, cb AS cb_prediction_raw,
 round(coalesce(history_rating_std, 0), 6) AS history_rating_std, round(coalesce(correction_hat, 0), 6) AS correction_hat, round(ln(1 + greatest(t.useful, 0)), 6) AS review_useful_log1p, isodow(t.timestamp)::DOUBLE - 1 AS review_weekday
FROM (SELECT *, round_even(incumbent_prediction_raw, 0) AS cb FROM preds) t LEFT JOIN users u ON t."user" = u.user_id"""
STACK_COLUMNS = ["history_band_enc", "history_count_log1p", "user_mean_rating", "business_mean_rating", "business_review_count_log1p", "business_bayesian_prior", "cb_pred_fractional_part", "user_business_bias_gap", "user_tenure_years", "user_total_votes_log1p", "review_month", "cf_prediction", "cf_cb_diff", "history_count", "business_review_count", "cb_prediction_raw", "history_rating_std", "correction_hat", "review_useful_log1p", "review_weekday"]


def stack_input(spark, sf):
    p = preds(spark, sf).withColumns({"cb_prediction_raw": F.rint("incumbent_prediction_raw"), "cf_prediction": F.col("p3")})
    return p.select("review_id", "user", "item", "rating", "timestamp", "useful", "funny", "cool", "history_band", "history_count", "history_rating_std", "correction_hat", "deep_prediction_raw", "cb_prediction_raw", "cf_prediction")


@query("rt_stack_rows", STACK, "preds users")
def _(spark, sf):
    t = train(spark, sf)
    g = one_row(t.agg(F.avg("rating").alias("g")))["g"]
    return plain(stackers.stack_rows(stack_input(spark, sf), t, derived.users(spark, sf), g).select("review_id", *STACK_COLUMNS))


@query("rt_cold_stack_rows", """
SELECT review_id, round(pr, 6) AS deep_prediction_raw, least(greatest(round_even(pr, 0), 1), 5) AS cb_prediction_raw, round(abs(pr - least(greatest(round_even(pr, 0), 1), 5)), 6) AS cb_pred_fractional_part, 0.0::DOUBLE AS history_band_enc FROM (SELECT *, least(greatest((coalesce(item_support, 0) * coalesce(p2, g) + 5 * g) / (coalesce(item_support, 0) + 5), 1), 5) AS pr FROM preds WHERE history_count = 0)""", "preds")
def _(spark, sf):
    t = train(spark, sf)
    g = one_row(t.agg(F.avg("rating").alias("g")))["g"]
    c = stackers.cold_stack_rows(test(spark, sf), t, derived.users(spark, sf), g)
    return plain(c.select("review_id", "deep_prediction_raw", "cb_prediction_raw", "cb_pred_fractional_part", "history_band_enc"))


@query("rt_side_predictions", "SELECT review_id, round(least(greatest(g + coalesce(p1 - g, 0) + coalesce(p2 - g, 0), 1), 5), 6) AS cf_prediction FROM preds", "preds")
def _(spark, sf):
    return plain(bias.BiasModel().fit(train(spark, sf)).predict(test(spark, sf), "cf_prediction").select("review_id", "cf_prediction"))


def emb(spark, sf):
    return derived.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("category"))


view("emb", [], "SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS e, CAST(label AS VARCHAR) AS category FROM embeddings")


@query("an_dense_health", """
WITH n AS (SELECT sqrt(list_inner_product(e, e)) AS n, e FROM emb), u AS (SELECT list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM emb), s AS (SELECT i, sum(v) AS s, var_pop(x) AS vp FROM (SELECT unnest(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))) AS v, unnest(e) AS x, unnest(range(64)) AS i FROM emb) GROUP BY 1), c AS (SELECT count(*) AS k FROM emb)
SELECT k AS n_rows, 64::BIGINT AS n_dims, round((SELECT avg(n) FROM n), 6) AS norm_mean, round((SELECT stddev_pop(n) FROM n), 6) AS norm_std, round((SELECT quantile_cont(n, 0.05) FROM n), 6) AS norm_p05, round((SELECT quantile_cont(n, 0.5) FROM n), 6) AS norm_p50, round((SELECT quantile_cont(n, 0.95) FROM n), 6) AS norm_p95, 0::BIGINT AS zero_norm_count,
 (SELECT count(*) FILTER (vp < 1e-8) FROM s) AS dead_dimension_count, round(((SELECT sum(s * s) FROM s) - k) / (k * (k - 1)), 6) AS pair_cosine_mean FROM c""", "emb")
def _(spark, sf):
    return plain(embeddings.dense_health(emb(spark, sf)))


@query("an_explained_variance")
def _(spark, sf):
    return spark.createDataFrame(list(enumerate(embeddings.explained_variance(emb(spark, sf)))), "component bigint, share double")


@query("en_pca")
def _(spark, sf):
    p = embeddings.pca(derived.item_embeddings(spark, sf), "business_id", 8)
    return plain(p.select("business_id", F.posexplode("pca").alias("component", "value")))


@query("an_sparse_health", """
WITH t AS (SELECT business_id, unnest(list_distinct(tokens)) AS t FROM prep_biz), k AS (SELECT t FROM t GROUP BY 1 HAVING count(*) >= 20), r AS (SELECT business_id, count(*) AS nnz, sqrt(count(*)) AS n FROM t JOIN k USING (t) GROUP BY 1), d AS (SELECT count(*) AS d FROM k)
SELECT count(*) AS n_rows, any_value(d) AS n_dims, round(sum(nnz) / (count(*) * any_value(d)), 6) AS density, round(avg(nnz), 6) AS row_nnz_mean, quantile_cont(nnz, 0.5) AS row_nnz_p50, quantile_cont(nnz, 0.95) AS row_nnz_p95, round(avg(n), 6) AS norm_mean, round(stddev_pop(n), 6) AS norm_std, round(quantile_cont(n, 0.05), 6) AS norm_p05, round(quantile_cont(n, 0.5), 6) AS norm_p50, round(quantile_cont(n, 0.95), 6) AS norm_p95 FROM r, d""", "prep_biz")
def _(spark, sf):
    b = derived.businesses(spark, sf).select("business_id", F.array_distinct(text.tokens(F.col("categories"))).alias("tokens"))
    cells = encoders.category_cells(b, 20)
    return plain(embeddings.sparse_health(cells, "business_id", cells.select("feature_name").distinct().count()))


KNN = "kn AS (SELECT a.id AS anchor, b.id AS neighbour, a.category AS ac, b.category AS bc, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS c, row_number() OVER (PARTITION BY a.id ORDER BY round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 12) DESC, b.id) AS r FROM emb a JOIN emb b ON a.id <> b.id)"


@query("an_nearest_neighbours", f"WITH {KNN} SELECT anchor, neighbour, round(c, 6) AS cosine, r AS rank FROM kn WHERE r <= 10", "emb")
def _(spark, sf):
    e = emb(spark, sf)
    return plain(embeddings.nearest(e, e, "id", 10))


@query("an_neighbour_coherence", f"WITH {KNN}, p AS (SELECT anchor, ac, bc, count(*) AS n, sum((length(anchor) = length(neighbour))::INT) AS ct FROM kn WHERE r <= 10 GROUP BY ALL) SELECT anchor, ac AS anchor_category, round(sum(CASE WHEN ac = bc THEN n ELSE 0 END) / 10, 6) AS same_category_ratio, round(sum(ct) / 10, 6) AS same_city_ratio, round(sum(-(n / 10) * ln(n / 10 + 1e-12)), 6) AS category_entropy FROM p GROUP BY 1, 2", "emb")
def _(spark, sf):
    e = emb(spark, sf)
    labels = e.select("id", "category", F.length("id").alias("city"))
    return plain(embeddings.neighbour_coherence(embeddings.nearest(e, e, "id", 10), labels, 10))


@query("an_centroid_similarity", "WITH d AS (SELECT category, i, avg(v) AS m FROM (SELECT category, unnest(list_transform(e, lambda x: x / sqrt(list_inner_product(e, e)))) AS v, unnest(range(64)) AS i FROM emb) GROUP BY ALL), c AS (SELECT category, list(m ORDER BY i) AS m FROM d GROUP BY 1) SELECT a.category AS first, b.category AS second, round(" + COS.format(a="a.m", b="b.m") + ", 6) AS cosine FROM c a, c b", "emb")
def _(spark, sf):
    return plain(embeddings.centroid_similarity(emb(spark, sf), "category"))


@query("an_space_consistency", f"""WITH h AS (SELECT id, list_slice(e, 1, 32) AS e, category FROM emb), {KNN}, k2 AS (SELECT a.id AS anchor, b.id AS neighbour, row_number() OVER (PARTITION BY a.id ORDER BY round({COS.format(a='a.e', b='b.e')}, 12) DESC, b.id) AS r FROM h a JOIN h b ON a.id <> b.id)
SELECT round(avg(o), 6) AS neighbour_overlap_mean, count(*) AS n_anchors FROM (SELECT x.anchor, count(y.neighbour) / 10 AS o FROM (SELECT * FROM kn WHERE r <= 10) x LEFT JOIN (SELECT * FROM k2 WHERE r <= 10) y ON x.anchor = y.anchor AND x.neighbour = y.neighbour GROUP BY 1)""", "emb")
def _(spark, sf):
    e = emb(spark, sf)
    half = e.withColumn("embedding", F.slice("embedding", 1, 32))
    return plain(embeddings.neighbour_overlap(embeddings.nearest(e, e, "id", 10), embeddings.nearest(half, half, "id", 10), 10))


@query("an_distance_correlation", f"WITH p AS (SELECT a.id AS l, b.id AS r, 1 - ({COS.format(a='a.e', b='b.e')}) AS d1, 1 - ({COS.format(a='list_slice(a.e, 1, 32)', b='list_slice(b.e, 1, 32)')}) AS d2 FROM emb a JOIN emb b ON b.id::INT = a.id::INT + 1) SELECT round(corr(d1, d2), 6) AS pairwise_corr, count(*) AS n_pairs FROM p", "emb")
def _(spark, sf):
    e = emb(spark, sf)
    pairs = e.select(F.col("id").alias("left"), (F.col("id").cast("int") + 1).cast("string").alias("right"))
    return plain(embeddings.distance_correlation(pairs, e, e.withColumn("embedding", F.slice("embedding", 1, 32))))


@query("an_cluster_profiles")
def _(spark, sf):
    t = train(spark, sf)
    clusters, silhouette = embeddings.cluster_population(user_vectors(spark, sf), "user_id", 8, components=8)
    b = derived.businesses(spark, sf).select("business_id", text.macro_category(text.tokens(F.col("categories"))).alias("macro_category"))
    rows = durable(clean_users(spark, sf).join(clusters, "user_id").join(embeddings.dominant_category(t, b), "user_id", "left"))
    return plain(embeddings.cluster_profiles(rows).withColumn("silhouette", F.lit(silhouette)))


@query("an_archetype_projection")
def _(spark, sf):
    u = raw_features.prepare_users(derived.users(spark, sf), priors.train_scalars(train(spark, sf))["end"])
    p = router_features.archetype_profiles(router_features.fit_archetypes(u, 8).assign(u))
    p = p.select("user_archetype_id", F.array(*[F.coalesce(f"{c}_mean", F.lit(0.0)) for c in router_features.ARCHETYPE_COLUMNS]).alias("embedding"))
    return plain(embeddings.pca(p, "user_archetype_id", 2).select("user_archetype_id", F.col("pca")[0].alias("x"), F.col("pca")[1].alias("y")))


KUT = CTX_SEQ + """,
k AS (SELECT * FROM seq WHERE back <= 20), s AS (SELECT review_id, any_value(total) AS n, avg(rating) AS m, stddev_pop(rating) AS sd, arg_min(rating, back) AS la FROM k GROUP BY 1)"""


@query("wn_known_user_eval_table", f"WITH {KUT}, sc AS (SELECT avg(x) AS a, stddev_pop(x) AS s FROM (SELECT ln(1 + n) AS x FROM ctrain JOIN (SELECT \"user\", count(*) AS n FROM ctrain GROUP BY 1) USING (\"user\"))) SELECT review_id, n AS exact_history_count, CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS history_band, round(m, 6) AS history_rating_mean, round(sd, 6) AS history_rating_std, la AS history_last_rating, least(n, 20) AS n_events, round((ln(1 + n) - a) / s, 5) AS user_history_count_log1p FROM s, sc", "canonical ctrain")
def _(spark, sf):
    users, biz = derived.users(spark, sf), derived.businesses(spark, sf)
    u = raw_features.prepare_users(users, priors.train_scalars(train(spark, sf))["end"])
    fitted = known_user.fit_known_context(derived.train_reviews(spark, sf), users, biz, archetypes=fixed_archetypes(u))
    rows = known_user.known_user_table(derived.test_reviews(spark, sf), users, biz, fitted, training=False, content=derived.item_embeddings(spark, sf))
    rows = rows.withColumn("user_history_count_log1p", F.round("user_history_count_log1p", 5))
    return plain(rows.select("review_id", "exact_history_count", "history_band", "history_rating_mean", "history_rating_std", "history_last_rating", F.size("event_features").alias("n_events"), "user_history_count_log1p"))


@query("wn_known_user_train_table")
def _(spark, sf):
    users, biz = derived.users(spark, sf), derived.businesses(spark, sf)
    fitted = known_user.fit_known_context(derived.train_reviews(spark, sf), users, biz, n_archetypes=8)
    rows = known_user.known_user_table(derived.train_reviews(spark, sf), users, biz, fitted, training=True)
    return plain(rows.groupBy("history_band").agg(F.count(F.lit(1)).alias("n"), F.avg("history_rating_mean").alias("mean"), F.avg(F.size("event_features")).alias("events")))
