"""Queries over aggregates, profiles, audits, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import plain, query, view
from starloom.operators import audits, bias, priors, profile, splits
from starloom.operators.metrics import preference_auc
from starloom.operators.skew import top_rows
from starloom.plans.raw_features import prepare_businesses
from starloom.session import one_row
from starloom.sources import derived, tables
from starloom.sources.tables import canonical_reviews


def train(spark, sf):
    return canonical_reviews(derived.train_reviews(spark, sf))


def test(spark, sf):
    return canonical_reviews(derived.test_reviews(spark, sf))


view("ctrain", ["canonical"], "SELECT * FROM canonical WHERE timestamp < TIMESTAMP '2000-04-01'")
view("ctest", ["canonical"], "SELECT * FROM canonical WHERE timestamp >= TIMESTAMP '2000-04-01'")
AGG = "count(rating) AS train_review_count, round(avg(rating), 6) AS train_average_stars, round(stddev_samp(rating), 6) AS train_rating_std, min(timestamp) AS train_first_review_date, max(timestamp) AS train_last_review_date"


@query("ag_user_train_aggregates", f'SELECT "user" AS user_id, {AGG} FROM ctrain GROUP BY 1', "ctrain")
def _(spark, sf):
    return plain(priors.train_aggregates(train(spark, sf), "user", "user_id"))


@query("ag_business_train_aggregates", f"SELECT item AS business_id, {AGG} FROM ctrain GROUP BY 1", "ctrain")
def _(spark, sf):
    return plain(priors.train_aggregates(train(spark, sf), "item", "business_id"))


def prior_sql(key, p):
    return f"""SELECT {key} AS {p}_id, count(*)::DOUBLE AS {p}_train_count, round(avg(rating), 6) AS {p}_train_mean, round(coalesce(stddev_samp(rating), 0), 6) AS {p}_train_std, round(avg(rating) - any_value(g), 6) AS {p}_train_bias,
  round((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000.0::DOUBLE, 5) AS {p}_train_span_days, round((any_value(e) - epoch_us(max(timestamp))) / 86400000000.0::DOUBLE, 5) AS {p}_train_days_since_last_review
  FROM ctrain, (SELECT avg(rating) AS g, epoch_us(max(timestamp)) AS e FROM ctrain) GROUP BY 1"""


def digits(df, n, suffixes):
    return df.withColumns({c: F.round(c, n) for c in df.columns if c.endswith(suffixes)})


@query("ag_user_priors", prior_sql('"user"', "user"), "ctrain")
def _(spark, sf):
    t = train(spark, sf)
    return plain(digits(priors.entity_priors(t, "user", "user", priors.train_scalars(t)), 5, ("days", "review")))


@query("ag_business_priors", prior_sql("item", "business"), "ctrain")
def _(spark, sf):
    t = train(spark, sf)
    return plain(digits(priors.entity_priors(t, "item", "business", priors.train_scalars(t)), 5, ("days", "review")))


@query("ag_place_priors", """
WITH j AS (SELECT rating, CASE WHEN b.business_id IS NULL THEN NULL ELSE coalesce(nullif(trim(city), ''), '__missing__') END AS city, state, CASE WHEN b.business_id IS NULL THEN NULL ELSE coalesce(postal_code, '__missing__') END AS postal
  FROM ctrain c LEFT JOIN businesses b ON c.item = b.business_id)
SELECT 'city' AS place, city AS name, count(*)::DOUBLE AS train_count, round(avg(rating), 6) AS train_mean FROM j GROUP BY 2
UNION ALL SELECT 'state', state, count(*)::DOUBLE, round(avg(rating), 6) FROM j GROUP BY 2 UNION ALL SELECT 'postal', postal, count(*)::DOUBLE, round(avg(rating), 6) FROM j GROUP BY 2""", "ctrain businesses")
def _(spark, sf):
    found = priors.place_priors(train(spark, sf), prepare_businesses(derived.businesses(spark, sf)).select("business_id", "business_city", "business_state", "business_postal_code"))
    parts = [t.select(F.lit(n).alias("place"), F.col(t.columns[0]).alias("name"), F.col(f"{n}_train_count").alias("train_count"), F.col(f"{n}_train_mean").alias("train_mean")) for n, t in found.items()]
    return plain(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("ag_scalar_priors", """
SELECT 'user' AS side, "user" AS id, round(avg(rating), 6) AS mean, round(coalesce(stddev_samp(rating), 0), 6) AS std, count(*)::DOUBLE AS n, round((SELECT avg(rating) FROM ctrain), 6) AS global_mean FROM ctrain GROUP BY 2
UNION ALL SELECT 'item', item, round(avg(rating), 6), round(coalesce(stddev_samp(rating), 0), 6), count(*)::DOUBLE, round((SELECT avg(rating) FROM ctrain), 6) FROM ctrain GROUP BY 2""", "ctrain")
def _(spark, sf):
    g, u, i = priors.scalar_priors(train(spark, sf))
    side = lambda t, s: t.select(F.lit(s).alias("side"), F.col(f"{s}_key").alias("id"), F.col(f"{s}_mean").alias("mean"), F.col(f"{s}_std").alias("std"), F.col(f"{s}_count").alias("n"), F.lit(g).alias("global_mean"))
    return plain(side(u, "user").unionByName(side(i, "item")))


@query("ag_smoothed_group_stats", """
SELECT state, count(*)::DOUBLE AS state_support_count, round((sum(rating) + 50 * any_value(g)) / (count(*) + 50), 6) AS state_mean FROM ctrain c LEFT JOIN businesses b ON item = business_id, (SELECT avg(rating) AS g FROM ctrain) GROUP BY 1""", "ctrain businesses")
def _(spark, sf):
    t = train(spark, sf)
    b = derived.businesses(spark, sf).select("business_id", "state")
    g = one_row(t.agg(F.avg("rating").alias("g")))["g"]
    return plain(priors.smoothed_group_stats(t.join(b, t["item"] == b["business_id"], "left"), ["state"], "state", g, 50.0))


@query("ag_duplicates_averaged", 'SELECT "user", item, round_even(avg(rating), 0) AS rating FROM canonical GROUP BY ALL', "canonical")
def _(spark, sf):
    return plain(priors.average_duplicates(canonical_reviews(derived.reviews(spark, sf)), rounded=True))


@query("ag_dataset_summary", """
WITH s AS (SELECT count(*) AS n, count(DISTINCT "user") AS u, count(DISTINCT item) AS i, avg(rating) AS m, stddev_samp(rating) AS sd, min(rating) AS lo, max(rating) AS hi, median(rating) AS md FROM canonical)
SELECT n AS n_interactions, u AS n_users, i AS n_items, round(n / (u::DOUBLE * i), 6) AS density, round(1 - n / (u::DOUBLE * i), 6) AS sparsity, round(n / u, 6) AS avg_interactions_per_user, round(n / i, 6) AS avg_interactions_per_item, round(m, 6) AS rating_mean, round(sd, 6) AS rating_std, lo AS rating_min, hi AS rating_max, md AS rating_median FROM s""", "canonical")
def _(spark, sf):
    return plain(profile.dataset_summary(canonical_reviews(derived.reviews(spark, sf))))


PROFILE = """
WITH c AS (SELECT "user", count(*) AS n FROM canonical GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS d, row_number() OVER (ORDER BY n) AS a, count(*) OVER () AS k FROM c)
SELECT count(*) AS n_entities, min(n) AS min_interactions, max(n) AS max_interactions, round(avg(n), 6) AS mean_interactions, round(stddev_samp(n), 6) AS std_interactions, median(n) AS median_interactions,
 quantile_cont(n, 0.25) AS p25_interactions, quantile_cont(n, 0.75) AS p75_interactions, quantile_cont(n, 0.9) AS p90_interactions, quantile_cont(n, 0.95) AS p95_interactions, quantile_cont(n, 0.99) AS p99_interactions,
 round(avg((n = 1)::INT), 6) AS share_with_1_interaction, round(avg((n <= 2)::INT), 6) AS share_with_le_2_interactions, round(avg((n <= 5)::INT), 6) AS share_with_le_5_interactions, round(avg((n <= 10)::INT), 6) AS share_with_le_10_interactions,
 round(avg((n >= 10)::INT), 6) AS share_with_ge_10_interactions, round(avg((n >= 20)::INT), 6) AS share_with_ge_20_interactions, CAST(sum(n) AS BIGINT) AS total_interactions,
 round(sum(CASE WHEN d <= greatest(1, ceil(k * 0.01)) THEN n END) / sum(n), 6) AS head_1pct_interaction_share, round(sum(CASE WHEN d <= ceil(k * 0.05) THEN n END) / sum(n), 6) AS head_5pct_interaction_share, round(sum(CASE WHEN d <= ceil(k * 0.1) THEN n END) / sum(n), 6) AS head_10pct_interaction_share,
 round(sum((2 * a - k - 1) * n) / (any_value(k)::DOUBLE * sum(n)), 6) AS gini_interaction_concentration FROM r"""


@query("ag_entity_profile", PROFILE, "canonical")
def _(spark, sf):
    return plain(profile.entity_profile(profile.entity_counts(canonical_reviews(derived.reviews(spark, sf)), "user")))


@query("ag_support_curve", """
WITH c AS (SELECT item, count(*) AS n FROM canonical GROUP BY 1) SELECT t AS threshold, round(avg((n >= t)::INT), 6) AS coverage FROM c, (SELECT unnest(range(1, 101)) AS t) GROUP BY 1""", "canonical")
def _(spark, sf):
    return plain(profile.support_curve(profile.entity_counts(canonical_reviews(derived.reviews(spark, sf)), "item")))


@query("ag_frequency_of_frequencies", "SELECT n AS n_interactions, count(*) AS n_entities FROM (SELECT item, count(*) AS n FROM canonical GROUP BY 1) GROUP BY 1", "canonical")
def _(spark, sf):
    return profile.frequency_of_frequencies(profile.entity_counts(canonical_reviews(derived.reviews(spark, sf)), "item"))


@query("ag_diagnostics", """
WITH u AS (SELECT avg((n = 1)::INT) AS one, avg((n <= 5)::INT) AS five FROM (SELECT count(*) AS n FROM canonical GROUP BY "user")), i AS (SELECT avg((n = 1)::INT) AS one, avg((n <= 5)::INT) AS five FROM (SELECT count(*) AS n FROM canonical GROUP BY item)),
d AS (SELECT 1 - count(*) / (count(DISTINCT "user")::DOUBLE * count(DISTINCT item)) AS s FROM canonical),
r AS (SELECT CASE WHEN s > 0.99 THEN 2 WHEN s > 0.95 THEN 1 ELSE 0 END + CASE WHEN u.one > 0.4 THEN 1 ELSE 0 END + CASE WHEN i.one > 0.4 THEN 2 WHEN i.one > 0.2 THEN 1 ELSE 0 END AS score FROM u, i, d)
SELECT CASE WHEN s > 0.99 THEN 'very_high' WHEN s > 0.95 THEN 'high' WHEN s > 0.9 THEN 'moderate' ELSE 'low' END AS sparsity_level, CASE WHEN i.one > 0.5 THEN 'extreme' WHEN i.one > 0.3 THEN 'high' ELSE 'moderate_or_low' END AS item_tail_severity,
 CASE WHEN u.one > 0.5 THEN 'extreme' WHEN u.one > 0.3 THEN 'high' ELSE 'moderate_or_low' END AS user_tail_severity, CASE WHEN score >= 4 THEN 'high' WHEN score >= 2 THEN 'moderate' ELSE 'low' END AS matrix_factorization_risk,
 CASE WHEN i.five > 0.7 THEN 'high' WHEN i.five > 0.4 THEN 'moderate' ELSE 'low' END AS cold_start_risk_items, CASE WHEN u.five > 0.7 THEN 'high' WHEN u.five > 0.4 THEN 'moderate' ELSE 'low' END AS cold_start_risk_users FROM u, i, d, r""", "canonical")
def _(spark, sf):
    r = canonical_reviews(derived.reviews(spark, sf))
    return profile.diagnostics(profile.dataset_summary(r), profile.entity_profile(profile.entity_counts(r, "user")), profile.entity_profile(profile.entity_counts(r, "item")))


@query("ag_profiler_report")
def _(spark, sf):
    return profile.DatasetProfiler().fit(canonical_reviews(derived.reviews(spark, sf))).to_table()


@query("ag_attribute_key_counts", """
SELECT k AS attribute_key, count(*) AS count FROM businesses, (SELECT unnest(['WiFi', 'TakeOut', 'Rank', 'BusinessParking.garage', 'BusinessParking.lot', 'BusinessParking.valet', 'Note']) AS k) WHERE has_attributes GROUP BY 1""", "businesses")
def _(spark, sf):
    return audits.attribute_key_counts(derived.businesses(spark, sf))


@query("ag_parser_summary", """
WITH h AS (SELECT *, CASE WHEN sunday_end = sunday_start THEN 1440 WHEN sunday_end < sunday_start THEN sunday_end + 1440 - sunday_start ELSE sunday_end - sunday_start END AS sunday FROM businesses)
SELECT count(*) AS n_businesses, round(avg((len(tokens) > 0)::INT), 6) AS categories_rate, round(avg(has_attributes::INT), 6) AS attributes_rate, round(avg(has_hours::INT), 6) AS hours_rate, count(DISTINCT state) AS n_states, count(DISTINCT city) AS n_cities,
 round(avg(CASE WHEN has_hours THEN 4 ELSE 0 END), 6) AS mean_open_days, round(avg(CASE WHEN has_hours THEN 2430 + sunday ELSE 0 END), 6) AS mean_weekly_minutes, round(avg(len(tokens)), 6) AS mean_categories, 7::BIGINT AS n_attribute_keys FROM h""", "businesses")
def _(spark, sf):
    return plain(audits.parser_summary(derived.businesses(spark, sf)))


@query("ag_top_tokens", """
SELECT * FROM (SELECT 'category' AS kind, t AS token, count(*) AS n FROM (SELECT unnest(tokens) AS t FROM ctrain JOIN businesses ON item = business_id) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'city', coalesce(nullif(trim(city), ''), '__missing__') AS c, count(*) FROM ctrain JOIN businesses ON item = business_id GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""", "ctrain businesses")
def _(spark, sf):
    from starloom.plans.router_features import top_values

    t = train(spark, sf)
    b = prepare_businesses(derived.businesses(spark, sf)).select("business_id", "business_city", "business_category_tokens")
    counts = t.groupBy("item").agg(F.count(F.lit(1)).alias("n")).join(b, F.col("item") == b["business_id"])
    tokens = top_values(counts.select(F.explode("business_category_tokens").alias("token"), "n"), "token", 8)
    cities = top_values(counts.withColumnRenamed("business_city", "token"), "token", 10)
    return tokens.select(F.lit("category").alias("kind"), "token", "n").unionByName(cities.select(F.lit("city").alias("kind"), "token", "n"))


@query("ag_dominant_category", """
SELECT "user" AS user_id, macro AS dominant_macro_category, n AS dominant_macro_count FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY n DESC, macro) AS r FROM
 (SELECT "user", CASE WHEN list_contains(tokens, 'widget') THEN 'widget' WHEN list_contains(tokens, 'gear') THEN 'gear' ELSE coalesce(tokens[1], 'Other') END AS macro, count(*) AS n FROM ctrain LEFT JOIN businesses ON item = business_id GROUP BY ALL)) WHERE r = 1""", "ctrain businesses")
def _(spark, sf):
    from starloom.functions import text
    from starloom.operators.embeddings import dominant_category

    b = derived.businesses(spark, sf).select("business_id", text.macro_category(text.tokens(F.col("categories")), ["widget", "gear"]).alias("macro_category"))
    return dominant_category(train(spark, sf), b)


@query("ag_branch_counts", """
SELECT history_band, count(*) FILTER (known) AS known_model, count(*) FILTER (NOT known) AS cold_model FROM (SELECT coalesce(n, 0) > 0 AS known, CASE WHEN coalesce(n, 0) = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS history_band
 FROM ctest LEFT JOIN (SELECT "user", count(*) AS n FROM ctrain GROUP BY 1) USING ("user")) GROUP BY 1""", "ctest ctrain")
def _(spark, sf):
    rows = priors.attach_history(test(spark, sf), train(spark, sf))
    branch = F.when(F.col("history_count") > 0, "known_model").otherwise("cold_model")
    return rows.withColumn("branch", branch).groupBy("history_band").pivot("branch", ["known_model", "cold_model"]).count().fillna(0)


@query("ag_correlation", 'SELECT round(corr(review_count, fans), 6) AS correlation, count(*) AS n FROM users', "users")
def _(spark, sf):
    return plain(derived.users(spark, sf).agg(F.corr("review_count", "fans").alias("correlation"), F.count(F.lit(1)).alias("n")))


COMPARE = """
SELECT {key}, review_count, {mean} AS stated_mean, n AS train_review_count, round(m, 6) AS train_average_stars, n IS NOT NULL AS seen_in_train, review_count - coalesce(n, 0) AS count_difference, abs(review_count - coalesce(n, 0)) AS abs_count_difference,
 review_count = coalesce(n, 0) AS exact_count_match, round({mean} - m, 6) AS mean_difference, round(abs({mean} - m), 6) AS abs_mean_difference FROM {table} LEFT JOIN (SELECT {col} AS id, count(*) AS n, avg(rating) AS m FROM ctrain GROUP BY 1) ON {key} = id"""
USERS = COMPARE.format(key="user_id", mean="average_stars", table="users", col='"user"')


@query("an_compare_users", USERS, "users ctrain")
def _(spark, sf):
    return plain(audits.user_audit(derived.users(spark, sf), train(spark, sf)))


@query("an_compare_businesses", COMPARE.format(key="business_id", mean="stars", table="businesses", col="item"), "businesses ctrain")
def _(spark, sf):
    return plain(audits.business_audit(derived.businesses(spark, sf), train(spark, sf)))


@query("an_comparison_summary", f"""
WITH c AS ({USERS}) SELECT count(*) AS total_rows, count(*) FILTER (seen_in_train) AS rows_seen_in_train, count(*) FILTER (NOT seen_in_train) AS rows_unseen_in_train, round(avg(exact_count_match::INT) FILTER (seen_in_train), 6) AS exact_count_match_rate,
 round(avg(abs_count_difference) FILTER (seen_in_train), 6) AS mean_abs_count_difference, round(avg(abs_mean_difference) FILTER (seen_in_train), 5) AS mean_abs_mean_difference, median(abs_count_difference) FILTER (seen_in_train) AS median_abs_count_difference, round(median(abs_mean_difference) FILTER (seen_in_train), 5) AS median_abs_mean_difference FROM c""", "users ctrain")
def _(spark, sf):
    s = audits.summarize_comparison(audits.user_audit(derived.users(spark, sf), train(spark, sf)))
    return plain(digits(s, 5, ("abs_mean_difference",)))


@query("an_leakage_check", """
WITH g AS (SELECT avg(rating) AS g FROM ctrain), cold AS (SELECT * FROM ctest WHERE "user" NOT IN (SELECT "user" FROM ctrain)), j AS (SELECT c.*, average_stars, review_count FROM cold c JOIN users ON "user" = user_id),
p AS (SELECT "user", count(*) AS n, avg(rating) AS m FROM cold GROUP BY 1), x AS (SELECT p.*, average_stars, review_count FROM p JOIN users ON "user" = user_id)
SELECT * FROM (SELECT count(*) AS n_rows, round(corr(average_stars, rating), 6) AS correlation, round(avg(abs(average_stars - rating)), 6) AS profile_mae, round(avg(abs(g - rating)), 6) AS global_mae FROM j, g),
 (SELECT count(*) AS n_cold_users, round(avg((review_count > n)::INT), 6) AS share_with_other_reviews, round(avg((abs(average_stars - m) < 0.01)::INT), 6) AS share_equal_means FROM x)""", "ctrain ctest users")
def _(spark, sf):
    return plain(audits.leakage_check(train(spark, sf), test(spark, sf), derived.users(spark, sf)))


@query("an_band_distribution", """
SELECT CASE WHEN coalesce(n, 0) = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS history_band, count(*) AS n_rows, count(DISTINCT "user") AS n_users FROM ctest LEFT JOIN (SELECT "user", count(*) AS n FROM ctrain GROUP BY 1) USING ("user") GROUP BY 1""", "ctest ctrain")
def _(spark, sf):
    rows = priors.attach_history(test(spark, sf), train(spark, sf))
    per_user = rows.groupBy("history_band", "user").agg(F.count(F.lit(1)).alias("n"))
    return per_user.groupBy("history_band").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_users"))


@query("so_temporal_split", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY timestamp, review_id) AS k, count(*) OVER () AS n FROM canonical)
SELECT CASE WHEN k <= round(n * 0.8) THEN 'train' ELSE 'validation' END AS part, count(*) AS n_rows, round(avg(rating), 6) AS mean, min(timestamp) AS first, max(timestamp) AS last, min(review_id) AS low_id, max(review_id) AS high_id FROM r GROUP BY 1""", "canonical")
def _(spark, sf):
    a, b = splits.temporal_split(canonical_reviews(derived.reviews(spark, sf)))
    both = a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("validation")))
    return plain(both.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("rating").alias("mean"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.min("review_id").alias("low_id"), F.max("review_id").alias("high_id")))


@query("so_random_split", """
SELECT CASE WHEN (('0x' || substr(md5('42|' || (l_orderkey * 100 + l_linenumber)), 1, 15))::BIGINT) < 230584300921369408 THEN 'validation' ELSE 'train' END AS part, count(*) AS n_rows, CAST(sum(l_partkey) AS BIGINT) AS key_sum FROM lineitem GROUP BY 1""")
def _(spark, sf):
    lines = derived.table(spark, sf, "lineitem")
    a, b = splits.random_split(lines, F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    both = a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("validation")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("l_partkey").alias("key_sum"))


BANDS_SQL = """
WITH c AS (SELECT item, count(*) AS n FROM ctrain GROUP BY 1), q AS (SELECT quantile_cont(n, 1/3.0::DOUBLE) AS a, quantile_cont(n, 2/3.0::DOUBLE) AS b FROM c),
t AS (SELECT x.*, n, CASE WHEN n IS NULL OR n <= a THEN 'low' WHEN n <= b THEN 'mid' ELSE 'high' END AS band FROM ctest x LEFT JOIN c USING (item), q)"""


@query("so_frequency_bands", BANDS_SQL + " SELECT review_id, n AS entity_count, band FROM t", "ctrain ctest")
def _(spark, sf):
    return splits.FrequencyBands("item").fit(train(spark, sf)).transform(test(spark, sf)).select("review_id", "entity_count", "band")


@query("so_frequency_band_summary", """
WITH c AS (SELECT "user", count(*) AS n FROM ctrain GROUP BY 1), t AS (SELECT x.*, n, CASE WHEN n <= 3 THEN 'low' WHEN n >= 500 THEN 'high' ELSE 'mid' END AS band FROM ctest x JOIN c USING ("user"))
SELECT b.band, count("user") AS n_rows, count(DISTINCT "user") AS n_unique_entities, min(n) AS min_count, max(n) AS max_count, round(avg(n), 6) AS mean_count FROM (SELECT unnest(['low', 'mid', 'high']) AS band) b LEFT JOIN t USING (band) GROUP BY 1""", "ctrain ctest")
def _(spark, sf):
    bands = splits.FrequencyBands("user", "threshold", low=3, high=500, unknown_as=None).fit(train(spark, sf))
    return plain(bands.summary(test(spark, sf)))


@query("so_grouped_cap", """
SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY (('0x' || substr(md5('42|' || (doc_id)), 1, 15))::BIGINT), doc_id) AS r FROM documents) WHERE r <= 50""")
def _(spark, sf):
    return splits.grouped_cap(derived.table(spark, sf, "documents").select("doc_id", "lang"), "lang", F.col("doc_id"), 50)


@query("so_sample_rows", """
SELECT * FROM (SELECT 'rows' AS kind, o_orderkey FROM orders ORDER BY (('0x' || substr(md5('42|' || (o_orderkey)), 1, 15))::BIGINT), o_orderkey LIMIT 100) UNION ALL SELECT 'fraction', o_orderkey FROM orders WHERE (('0x' || substr(md5('42|' || (o_orderkey)), 1, 15))::BIGINT) < 115292150460684704""")
def _(spark, sf):
    o = derived.table(spark, sf, "orders").select("o_orderkey")
    rows, part = splits.sample_rows(o, F.col("o_orderkey"), 100), splits.sample_fraction(o, F.col("o_orderkey"), 0.1)
    return rows.withColumn("kind", F.lit("rows")).unionByName(part.withColumn("kind", F.lit("fraction")))


@query("so_top_categories", "SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 250 ORDER BY 2 DESC, 1 LIMIT 4")
def _(spark, sf):
    from starloom.operators.embeddings import top_categories

    return top_categories(derived.table(spark, sf, "part").select(F.col("p_type").alias("category")), "category", 250, 4)


@query("fi_frequent_entities", """
SELECT review_id FROM canonical WHERE item IN (SELECT item FROM canonical GROUP BY 1 HAVING count(*) BETWEEN 25 AND 35) AND "user" IN (SELECT "user" FROM canonical GROUP BY 1 HAVING count(*) >= 5)""", "canonical")
def _(spark, sf):
    r = canonical_reviews(derived.reviews(spark, sf)).select("review_id", "user", "item")
    items, users = splits.frequent_entities(r, "item", 25, 35), splits.frequent_entities(r, "user", at_least=5)
    return items.join(users.select("review_id"), "review_id", "left_semi").select("review_id")


@query("fi_predicates", """
SELECT review_id, n BETWEEN 2 AND 5 AS short, CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END IN ('1', '2-5') AS in_bands, m IS NOT NULL AS available FROM
 (SELECT c.review_id, coalesce(k.n, 0) AS n, m FROM ctest c LEFT JOIN (SELECT "user", count(*) AS n, avg(rating) AS m FROM ctrain GROUP BY 1) k USING ("user")) WHERE n <= 20""", "ctest ctrain")
def _(spark, sf):
    t = train(spark, sf)
    means = t.groupBy(F.col("user").alias("_u")).agg(F.avg("rating").alias("m"))
    rows = tables.drop_null_rows(priors.attach_history(test(spark, sf), t), ["user", "item", "rating", "timestamp"])
    rows = rows.join(means, rows["user"] == means["_u"], "left")
    kept = rows.filter(F.col("history_band").isin("0", "1", "2-5", "6-20"))
    available = F.col("m").isNotNull() & ~F.isnan("m")
    return kept.select("review_id", F.col("history_count").between(2, 5).alias("short"), F.col("history_band").isin("1", "2-5").alias("in_bands"), F.coalesce(available, F.lit(False)).alias("available"))


@query("se_union_and_target_users", """
SELECT user_id, bool_or(s = 'users') AS in_users, bool_or(s = 'train') AS in_train, bool_or(s = 'test') AS in_test, coalesce(max(n), 0) AS train_count FROM (SELECT user_id, 'users' AS s, NULL AS n FROM users UNION ALL SELECT "user", 'train', count(*) FROM ctrain GROUP BY 1 UNION ALL SELECT DISTINCT "user", 'test', NULL FROM ctest) GROUP BY 1""", "users ctrain ctest")
def _(spark, sf):
    from starloom.plans.profiles import expand_to_targets, target_users

    t = train(spark, sf)
    u, a, b = derived.users(spark, sf).select("user_id"), t.select(F.col("user").alias("user_id")), test(spark, sf).select(F.col("user").alias("user_id"))
    ids = target_users(u, a, b)
    for name, d in (("users", u), ("train", a), ("test", b)):
        ids = ids.join(d.distinct().withColumn(f"in_{name}", F.lit(True)), "user_id", "left").fillna(False, [f"in_{name}"])
    return expand_to_targets(ids, a.groupBy("user_id").agg(F.count(F.lit(1)).alias("train_count")), "user_id", ["train_count"])


@query("se_split_remainder", "SELECT o_orderkey FROM orders WHERE NOT (('0x' || substr(md5('7|' || (o_orderkey)), 1, 15))::BIGINT) < 345876451382054080")
def _(spark, sf):
    o = derived.table(spark, sf, "orders").select("o_orderkey")
    return o.join(splits.sample_fraction(o, F.col("o_orderkey"), 0.3, seed=7), "o_orderkey", "left_anti")


@query("io_schema_and_unique_keys", """
SELECT (SELECT count(*) FROM (SELECT review_id FROM reviews GROUP BY 1 HAVING count(*) > 1)) AS duplicate_reviews, (SELECT count(*) FROM (SELECT user_id FROM users GROUP BY 1 HAVING count(*) > 1)) AS duplicate_users, (SELECT count(*) FROM (SELECT user_id, business_id FROM reviews GROUP BY ALL HAVING count(*) > 1)) AS repeated_pairs""", "reviews users")
def _(spark, sf):
    r = tables.require_columns(derived.reviews(spark, sf), ["review_id", "user_id", "business_id", "stars", "date"], not_empty=True)
    n = lambda df, keys, name: tables.duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias(name))
    counts = {**one_row(n(r, ["review_id"], "duplicate_reviews")), **one_row(n(derived.users(spark, sf), ["user_id"], "duplicate_users")), **one_row(n(r, ["user_id", "business_id"], "repeated_pairs"))}
    return spark.createDataFrame([counts])


@query("io_canonical_reviews", 'SELECT review_id, "user", item, rating, timestamp FROM canonical', "canonical")
def _(spark, sf):
    raw = derived.reviews(spark, sf).withColumns({"stars": F.col("stars").cast("string"), "date": F.col("date").cast("string")})
    return canonical_reviews(raw).select("review_id", "user", "item", "rating", "timestamp")
