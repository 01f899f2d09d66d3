"""Queries over scalar functions: rounding, buckets, dates, text and hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.registry import plain, query
from starloom.functions import buckets, dates, numeric, text
from starloom.session import one_row
from starloom.sources import derived, tables


def lines(spark, sf):
    return derived.table(spark, sf, "lineitem")


@query("sc_round_half_up", """
SELECT value, CAST(least(greatest(floor(value + 0.5), 1), 5) AS DOUBLE) AS rounded, count(*) AS n
FROM (SELECT l_quantity / 8.0 AS value FROM lineitem) GROUP BY ALL""")
def _(spark, sf):
    x = lines(spark, sf).select((F.col("l_quantity") / 8).alias("value"))
    return plain(x.groupBy("value", numeric.round_half_up(F.col("value")).alias("rounded")).agg(F.count("*").alias("n")))


@query("sc_round_half_even", """
SELECT value, round_even(value, 0) AS rounded, count(*) AS n
FROM (SELECT l_quantity / 4.0 AS value FROM lineitem) GROUP BY ALL""")
def _(spark, sf):
    x = lines(spark, sf).select((F.col("l_quantity") / 4).alias("value"))
    return plain(x.groupBy("value", numeric.round_half_even(F.col("value")).alias("rounded")).agg(F.count("*").alias("n")))


@query("sc_clip_floor_ceil", """
SELECT v AS value, CAST(least(greatest(v, 1.5), 4.5) AS DOUBLE) AS clipped, CAST(greatest(v, 2) AS DOUBLE) AS low_only,
       v AS open, CAST(least(greatest(floor(v), 1), 5) AS DOUBLE) AS floored,
       CAST(least(greatest(ceil(v), 1), 5) AS DOUBLE) AS ceiled, count(*) AS n
FROM (SELECT l_quantity / 8.0 AS v FROM lineitem) GROUP BY ALL""")
def _(spark, sf):
    v = F.col("value")
    x = lines(spark, sf).select((F.col("l_quantity") / 8).alias("value"))
    return plain(
        x.groupBy(
            v, numeric.clip(v, 1.5, 4.5).alias("clipped"), numeric.clip(v, 2, None).alias("low_only"),
            numeric.clip(v, None, None).alias("open"), numeric.floor_stars(v).alias("floored"),
            numeric.ceil_stars(v).alias("ceiled"),
        ).agg(F.count("*").alias("n"))
    )


@query("sc_numeric_coerce_and_missing_columns", """
SELECT user_id, CAST(review_count AS DOUBLE) AS review_count, coalesce(TRY_CAST(elite AS DOUBLE), -1) AS elite_number,
       coalesce(average_stars, 0) AS average_stars, CAST(NULL AS VARCHAR) AS absent
FROM users""", "users")
def _(spark, sf):
    u = tables.with_missing_columns(derived.users(spark, sf), ["user_id", "review_count", "elite", "average_stars", "absent"])
    return plain(
        u.select(
            "user_id", numeric.number_or("review_count").alias("review_count"), numeric.number_or("elite", -1.0).alias("elite_number"),
            numeric.number_or("average_stars").alias("average_stars"), F.col("absent").cast("string").alias("absent"),
        )
    )


@query("sc_log1p_clamped", """
SELECT review_id, round(ln(1 + greatest(useful, 0)), 6) AS useful_log1p, round(ln(1 + greatest(funny, 0)), 6) AS funny_log1p,
       round(ln(1 + greatest(cool, 0)), 6) AS cool_log1p FROM reviews""", "reviews")
def _(spark, sf):
    r = derived.reviews(spark, sf)
    return plain(r.select("review_id", *[numeric.log1p_nonnegative(F.col(c)).alias(f"{c}_log1p") for c in ("useful", "funny", "cool")]))


@query("sc_zscore", """
WITH m AS (SELECT avg(review_count) AS a, stddev_pop(review_count) AS s, avg(fans) AS fa, stddev_pop(fans) AS fs FROM users)
SELECT user_id, round((review_count - a) / s, 6) AS review_count_z, round((fans - fa) / fs, 6) AS fans_z, 0.0::DOUBLE AS constant_z
FROM users, m""", "users")
def _(spark, sf):
    u = derived.users(spark, sf).withColumn("constant", F.lit(3.0))
    fitted = numeric.fit_scores(u, ["review_count", "fans", "constant"])
    return plain(u.select("user_id", *[numeric.score(c, fitted).alias(f"{c}_z") for c in fitted]))


@query("sc_fit_aware_zscore", """
WITH known AS (SELECT *, user_id IN (SELECT user_id FROM train) AS fit FROM users),
m AS (SELECT avg(ln(1 + useful)) AS a, stddev_pop(ln(1 + useful)) AS s FROM known WHERE fit)
SELECT user_id, fit, round((ln(1 + useful) - a) / s, 6) AS useful_z FROM known, m""", "users train")
def _(spark, sf):
    u = derived.users(spark, sf)
    seen = derived.train_reviews(spark, sf).select("user_id").distinct().withColumn("fit", F.lit(True))
    u = u.join(seen, "user_id", "left").select("user_id", F.coalesce("fit", F.lit(False)).alias("fit"), F.log1p("useful").alias("useful"))
    fitted = numeric.fit_scores(u, ["useful"], fit_on=F.col("fit"))
    return plain(u.select("user_id", "fit", numeric.score("useful", fitted).alias("useful_z")))


@query("sc_standardize_block", """
WITH m AS (SELECT avg(useful) AS ua, stddev_pop(useful) AS us, avg(cool) AS ca, stddev_pop(cool) AS cs FROM train)
SELECT review_id, round((useful - ua) / us, 6) AS useful, round((cool - ca) / cs, 6) AS cool, 0.0::DOUBLE AS flat
FROM test, m""", "train test")
def _(spark, sf):
    flat = lambda df: df.withColumn("flat", F.lit(2.0))
    fitted = numeric.fit_scores(flat(derived.train_reviews(spark, sf)), ["useful", "cool", "flat"], smallest=1e-3, replaced_by=1.0)
    return plain(flat(derived.test_reviews(spark, sf)).select("review_id", *[numeric.score(c, fitted).alias(c) for c in fitted]))


@query("sc_guarded_std", """
SELECT user_id, round(CASE WHEN stddev_samp(stars) > 1e-6 THEN stddev_samp(stars) ELSE 1 END, 6) AS std FROM reviews GROUP BY 1""", "reviews")
def _(spark, sf):
    return plain(derived.reviews(spark, sf).groupBy("user_id").agg(numeric.guarded_std(F.col("stars")).alias("std")))


@query("sc_shrunk_and_bayesian_mean", """
WITH g AS (SELECT avg(stars) AS g FROM train), s AS (SELECT business_id, avg(stars) AS m, count(*) AS n FROM train GROUP BY 1),
b AS (SELECT DISTINCT business_id FROM reviews)
SELECT b.business_id, coalesce(n, 0) AS n, round(CASE WHEN n IS NULL THEN g ELSE (n * m + 10 * g) / (n + 10) END, 6) AS shrunk,
  round(least(greatest((coalesce(n, 0) * coalesce(m, g) + 5 * g) / (coalesce(n, 0) + 5), 1), 5), 6) AS bayesian
FROM b LEFT JOIN s USING (business_id), g""", "train reviews")
def _(spark, sf):
    train = derived.train_reviews(spark, sf)
    g = one_row(train.agg(F.avg("stars").alias("g")))["g"]
    stats = train.groupBy("business_id").agg(F.avg("stars").alias("m"), F.count("*").alias("n"))
    ids = derived.table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("business_id")).distinct()
    return plain(
        ids.join(stats, "business_id", "left").select(
            "business_id", F.coalesce("n", F.lit(0)).alias("n"), numeric.shrunk_mean(F.col("m"), F.col("n"), g, 10.0).alias("shrunk"),
            numeric.bayesian_prior(F.col("m"), F.col("n"), g).alias("bayesian"),
        )
    )


@query("sc_rating_scale_and_short_weight", """
SELECT review_id, (stars - 1) / 4 AS unit, stars AS back, CAST(least(greatest((6.0 - useful) / 4.0, 0.25), 0.85) AS DOUBLE) AS short_weight FROM reviews""", "reviews")
def _(spark, sf):
    r = derived.reviews(spark, sf)
    unit = numeric.scale_to_unit(F.col("stars"), 1, 5)
    return plain(r.select("review_id", unit.alias("unit"), numeric.scale_from_unit(unit, 1, 5).alias("back"), numeric.short_history_weight(F.col("useful")).alias("short_weight")))


@query("sc_validate_ratings", """
SELECT stars AS value FROM (SELECT DISTINCT l_quantity / 10 AS stars FROM lineitem)
WHERE abs(stars - round_even(stars, 0)) > 1e-8 OR stars < 0 OR stars > 5 ORDER BY 1 LIMIT 10""")
def _(spark, sf):
    df = lines(spark, sf).select((F.col("l_quantity") / 10).alias("stars"))
    return spark.createDataFrame([(v,) for v in numeric.bad_ratings(df, "stars", 5)], "value double")


@query("sc_binomial_pmf_and_mode", """
WITH p AS (SELECT business_id, (avg(stars) - 1) / 4 * 0.98 + 0.01 AS p FROM train GROUP BY 1),
d AS (SELECT business_id, p, r, CASE r WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 1 END * pow(p, r) * pow(1 - p, 4 - r) AS q
      FROM p, (SELECT unnest([0, 1, 2, 3, 4]) AS r))
SELECT business_id, CAST(arg_max(r, (q, -r)) AS BIGINT) AS mode, round(sum(q), 6) AS total, round(sum(q * r), 6) AS expected FROM d GROUP BY 1""", "train")
def _(spark, sf):
    p = derived.train_reviews(spark, sf).groupBy("business_id").agg(((F.avg("stars") - 1) / 4 * 0.98 + 0.01).alias("p"))
    pmf = numeric.binomial_pmf(F.col("p"), 4)
    return plain(
        p.select(
            "business_id", numeric.binomial_mode(F.col("p"), 4).alias("mode"),
            sum(pmf[r] for r in range(1, 5)).__add__(pmf[0]).alias("total"), (pmf[1] + 2 * pmf[2] + 3 * pmf[3] + 4 * pmf[4]).alias("expected"),
        )
    )


LADDERS = """
SELECT n, CASE WHEN n <= 0 THEN '0' WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS band,
  CASE WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS known_band,
  CASE WHEN n <= 0 THEN '0' WHEN n <= 1 THEN '1' WHEN n <= 20 THEN '2-20' ELSE '>20' END AS collapsed,
  CASE WHEN n <= 0 THEN '0' WHEN n <= 1 THEN '1' WHEN n <= 2 THEN '2' WHEN n <= 3 THEN '3' WHEN n <= 5 THEN '4-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' ELSE '>20' END AS support,
  CASE WHEN n <= 0 THEN '0' WHEN n <= 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS item_support,
  CASE WHEN n <= 0 THEN 0 WHEN n <= 1 THEN 1 WHEN n <= 5 THEN 2 WHEN n <= 20 THEN 6 ELSE 20 END::DOUBLE AS code,
  count(*) AS n_users
FROM (SELECT u.user_id, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT user_id FROM reviews) u LEFT JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY 1) c USING (user_id))
GROUP BY ALL"""


@query("bk_history_and_support_bands", LADDERS, "reviews train")
def _(spark, sf):
    everyone = derived.reviews(spark, sf).select("user_id").distinct()
    counts = derived.train_reviews(spark, sf).groupBy("user_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    u = everyone.join(counts, "user_id", "left").fillna(0, ["n"])
    band = buckets.history_band(n)
    return plain(
        u.groupBy(
            n, band.alias("band"), buckets.known_history_band(n).alias("known_band"), buckets.collapsed_band(n).alias("collapsed"),
            buckets.support_bucket(n).alias("support"), buckets.item_support_bucket(n).alias("item_support"), buckets.band_code(band).alias("code"),
        ).agg(F.count("*").alias("n_users"))
    )


@query("bk_user_buckets", """
SELECT user_id, CASE WHEN review_count <= 0 THEN '0' WHEN review_count = 1 THEN '1' WHEN review_count <= 5 THEN '2-5' WHEN review_count <= 20 THEN '6-20' WHEN review_count <= 100 THEN '21-100' ELSE '>100' END AS activity,
  CASE WHEN average_stars IS NULL THEN '__missing__' WHEN average_stars < 2.5 THEN '1.0-2.5' WHEN average_stars < 3.5 THEN '2.5-3.5' WHEN average_stars < 4 THEN '3.5-4.0' WHEN average_stars < 4.5 THEN '4.0-4.5' ELSE '4.5-5.0' END AS reputation,
  CASE WHEN y IS NULL THEN '__missing__' WHEN y < 1 THEN '<1y' WHEN y < 3 THEN '1-3y' WHEN y < 6 THEN '3-6y' ELSE '>6y' END AS tenure
FROM (SELECT *, (epoch_us(TIMESTAMP '2000-04-01') - epoch_us(yelping_since)) / 86400000000.0::DOUBLE / 365.25::DOUBLE AS y FROM users)""", "users")
def _(spark, sf):
    years = dates.days_between(F.lit(derived.SPLIT_DATE).cast("timestamp"), F.col("yelping_since")) / 365.25
    return derived.users(spark, sf).select(
        "user_id", buckets.activity_bucket(F.col("review_count")).alias("activity"),
        buckets.stars_bucket(F.col("average_stars")).alias("reputation"), buckets.tenure_bucket(years).alias("tenure"),
    )


@query("bk_business_star_bin", """
SELECT CASE WHEN stars IS NULL THEN '__missing__' WHEN stars < 2.5 THEN '1.0-2.5' WHEN stars < 3.5 THEN '2.5-3.5' WHEN stars < 4 THEN '3.5-4.0' WHEN stars < 4.5 THEN '4.0-4.5' ELSE '4.5-5.0' END AS star_bin, count(*) AS n
FROM businesses GROUP BY 1""", "businesses")
def _(spark, sf):
    b = derived.businesses(spark, sf)
    return b.groupBy(buckets.stars_bucket(F.col("stars")).alias("star_bin")).agg(F.count("*").alias("n"))


@query("bk_quantile_bucket", """
WITH q AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS business_id, CASE WHEN p_retailprice <= a THEN 'price_q1' WHEN p_retailprice <= b THEN 'price_q2' WHEN p_retailprice <= c THEN 'price_q3' ELSE 'price_q4' END AS bucket FROM part, q""")
def _(spark, sf):
    p = derived.table(spark, sf, "part")
    edges = buckets.quantile_edges(p, "p_retailprice")
    return p.select(F.col("p_partkey").cast("string").alias("business_id"), buckets.quantile_bucket(F.col("p_retailprice"), edges, "price").alias("bucket"))


@query("bk_fixed_edges_and_labels", """
WITH c AS (SELECT business_id, count(*) AS n FROM train GROUP BY 1), m AS (SELECT avg(n) AS a, stddev_pop(n) AS s FROM c)
SELECT business_id, CASE WHEN n < 0 THEN NULL WHEN n <= 5 THEN 'low' WHEN n <= 20 THEN 'mid' WHEN n <= 100 THEN 'high' WHEN n <= 1000000 THEN 'very_high' END AS confidence,
 CASE WHEN (n - a) / s >= 1 THEN 'high' WHEN (n - a) / s <= -1 THEN 'low' ELSE 'mid' END AS label FROM c, m""", "train")
def _(spark, sf):
    c = derived.train_reviews(spark, sf).groupBy("business_id").agg(F.count("*").alias("n"))
    fitted = numeric.fit_scores(c, ["n"])
    return c.select(
        "business_id", buckets.fixed_edges(F.col("n"), [0, 5, 20, 100, 1000000], ["low", "mid", "high", "very_high"]).alias("confidence"),
        buckets.score_label(numeric.score("n", fitted)).alias("label"),
    )


@query("bk_review_count_quartiles", """
WITH q AS (SELECT quantile_cont(review_count, 0.25) AS a, quantile_cont(review_count, 0.5) AS b, quantile_cont(review_count, 0.75) AS c FROM users)
SELECT CASE WHEN review_count <= a THEN 'q1' WHEN review_count <= b THEN 'q2' WHEN review_count <= c THEN 'q3' ELSE 'q4' END AS bucket, count(*) AS n, min(review_count) AS low, max(review_count) AS high
FROM users, q GROUP BY 1""", "users")
def _(spark, sf):
    u = derived.users(spark, sf)
    edges = buckets.quantile_edges(u, "review_count")
    rc = F.col("review_count")
    label = F.when(rc <= edges[1], "q1").when(rc <= edges[2], "q2").when(rc <= edges[3], "q3").otherwise("q4")
    return u.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"), F.min(rc).alias("low"), F.max(rc).alias("high"))


@query("dt_date_parts", """
SELECT review_id, year(date)::DOUBLE AS review_year, month(date)::DOUBLE AS review_month, (isodow(date) - 1)::DOUBLE AS review_weekday, hour(date)::DOUBLE AS review_hour,
  (isodow(date) >= 6)::DOUBLE AS review_weekend_flag, (hour(date) BETWEEN 18 AND 23)::DOUBLE AS review_evening_flag FROM reviews""", "reviews")
def _(spark, sf):
    r = derived.reviews(spark, sf)
    return plain(r.select("review_id", *[c.alias(n) for n, c in dates.date_parts(F.col("date")).items()]))


@query("dt_tenure", """
WITH m AS (SELECT epoch_us(max(date)) AS e FROM train), t AS (SELECT user_id, yelping_since, greatest(coalesce((e - epoch_us(yelping_since)) / 86400000000.0::DOUBLE, 0), 0) AS d,
  CASE WHEN user_id IN (SELECT user_id FROM train) THEN (e - epoch_us(yelping_since)) / 86400000000.0::DOUBLE END AS known FROM users, m),
f AS (SELECT median(known) AS fill FROM t)
SELECT user_id, round(d, 6) AS tenure_days, round(d / 365.25::DOUBLE, 6) AS tenure_years, CASE WHEN yelping_since IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS since_missing,
 round(coalesce(CASE WHEN yelping_since IS NOT NULL THEN (SELECT e FROM m) - epoch_us(yelping_since) END / 86400000000.0::DOUBLE, fill), 6) AS filled_days,
 round(floor((epoch_us(TIMESTAMP '2026-01-01') - epoch_us(yelping_since)) / 86400000000.0::DOUBLE) / 365.25::DOUBLE, 6) AS whole_years
FROM t, f""", "train users")
def _(spark, sf):
    from starloom.operators.skew import quantiles

    train = derived.train_reviews(spark, sf)
    end = one_row(train.agg(F.unix_micros(F.max("date")).alias("end")))["end"]
    u = derived.users(spark, sf).join(train.select("user_id").distinct().withColumn("known", F.lit(True)), "user_id", "left")
    raw = (F.lit(end) - F.unix_micros("yelping_since")) / F.lit(dates.DAY_MICROS)
    fill = one_row(quantiles(u.filter("known").select(raw.alias("d")), [], "d", {"m": 0.5}))["m"]
    days = dates.tenure_days(F.col("yelping_since"), end)
    return plain(
        u.select(
            "user_id", days.alias("tenure_days"), (days / 365.25).alias("tenure_years"), F.col("yelping_since").isNull().cast("double").alias("since_missing"),
            F.coalesce(raw, F.lit(fill)).alias("filled_days"), dates.whole_tenure_years(F.col("yelping_since")).alias("whole_years"),
        )
    )


@query("dt_train_window_days", """
WITH m AS (SELECT epoch_us(min(date)) AS a, epoch_us(max(date)) AS b FROM train)
SELECT review_id, round((epoch_us(date) - a) / 86400000000.0::DOUBLE, 6) AS since_start, round(greatest((epoch_us(date) - b) / 86400000000.0::DOUBLE, 0), 6) AS since_end FROM reviews, m""", "reviews train")
def _(spark, sf):
    m = one_row(derived.train_reviews(spark, sf).agg(F.unix_micros(F.min("date")).alias("a"), F.unix_micros(F.max("date")).alias("b")))
    return plain(
        derived.reviews(spark, sf).select(
            "review_id", dates.days_from_micros(F.col("date"), m["a"]).alias("since_start"),
            F.greatest(dates.days_from_micros(F.col("date"), m["b"]), F.lit(0.0)).alias("since_end"),
        )
    )


CONTEXT = """
WITH s AS (SELECT epoch_us(min(date)) AS a FROM train),
x AS (SELECT review_id, date, ln(1 + greatest(useful, 0)) AS useful_log1p, ln(1 + greatest(funny, 0)) AS funny_log1p, ln(1 + greatest(cool, 0)) AS cool_log1p,
 (epoch_us(date) - a) / 86400000000.0::DOUBLE AS recency_days, sin(2 * pi() * (month(date) - 1) / 12) AS month_sin, cos(2 * pi() * (month(date) - 1) / 12) AS month_cos,
 sin(2 * pi() * (isodow(date) - 1) / 7) AS weekday_sin, cos(2 * pi() * (isodow(date) - 1) / 7) AS weekday_cos, sin(2 * pi() * hour(date) / 24) AS hour_sin, cos(2 * pi() * hour(date) / 24) AS hour_cos FROM reviews, s)
"""
CONTEXT_COLUMNS = ["useful_log1p", "funny_log1p", "cool_log1p", "recency_days", "month_sin", "month_cos", "weekday_sin", "weekday_cos", "hour_sin", "hour_cos"]


@query(
    "dt_review_context_scaled",
    CONTEXT + ", m AS (SELECT " + ", ".join(f"avg({c}) AS {c}_a, stddev_pop({c}) AS {c}_s" for c in CONTEXT_COLUMNS)
    + " FROM x WHERE date < TIMESTAMP '2000-04-01') SELECT review_id, "
    + ", ".join(f"round(({c} - {c}_a) / CASE WHEN {c}_s < 1e-6 THEN 1 ELSE {c}_s END, 5) AS {c}" for c in CONTEXT_COLUMNS)
    + " FROM x, m WHERE date >= TIMESTAMP '2000-04-01'",
    "train reviews",
)
def _(spark, sf):
    from starloom.plans.pair_features import fit_review_context, scaled_review_context

    fitted = fit_review_context(tables.canonical_reviews(derived.train_reviews(spark, sf)))
    test = tables.canonical_reviews(derived.test_reviews(spark, sf))
    return plain(test.select("review_id", *[c.alias(n) for n, c in scaled_review_context(fitted).items()]), 5)


@query("dt_review_engagement", """
SELECT t.review_id, round(ln(1 + greatest(r.useful, 0)), 6) AS review_useful_log1p, round(ln(1 + greatest(r.funny, 0)), 6) AS review_funny_log1p,
 month(r.date)::DOUBLE AS review_month, (isodow(r.date) - 1)::DOUBLE AS review_weekday FROM test t LEFT JOIN reviews r USING (review_id)""", "reviews test")
def _(spark, sf):
    from starloom.plans.stackers import attach_engagement

    return plain(attach_engagement(derived.test_reviews(spark, sf).select("review_id"), derived.reviews(spark, sf)))


@query("st_categories", """
SELECT business_id, len(tokens) AS n, tokens[1] AS first, array_to_string(tokens, '|') AS piped FROM businesses""", "businesses")
def _(spark, sf):
    t = text.tokens(F.col("categories"))
    return plain(derived.businesses(spark, sf).select("business_id", F.size(t).alias("n"), F.try_element_at(t, F.lit(1)).alias("first"), F.array_join(t, "|").alias("piped")))


ATTRIBUTE_ROWS = """
attrs AS (SELECT business_id, z, unnest([
  {'key': 'WiFi', 'value': wifi, 'kind': 'text'}, {'key': 'TakeOut', 'value': CASE WHEN z % 2 = 1 THEN 'true' ELSE 'false' END, 'kind': 'bool'},
  {'key': 'Rank', 'value': CAST(z % 4 AS VARCHAR), 'kind': 'number'},
  {'key': 'BusinessParking.garage', 'value': CASE WHEN z % 5 < 2 THEN 'true' ELSE 'false' END, 'kind': 'bool'},
  {'key': 'BusinessParking.lot', 'value': 'true', 'kind': 'bool'}, {'key': 'BusinessParking.valet', 'value': NULL, 'kind': 'none'},
  {'key': 'Note', 'value': 'it''s', 'kind': 'text'}]) AS a FROM businesses WHERE has_attributes)"""


@query("st_attributes_flat", "WITH " + ATTRIBUTE_ROWS + " SELECT business_id, a.key AS key, a.value AS value, a.kind AS kind FROM attrs", "businesses")
def _(spark, sf):
    b = derived.businesses(spark, sf)
    return b.select("business_id", F.inline(text.flat_attributes(F.col("attributes"))))


@query("st_attribute_counts", """
SELECT business_id, CASE WHEN has_attributes THEN 7 ELSE 0 END::BIGINT AS n, CASE WHEN has_attributes THEN (z % 2) + 1 + (z % 5 < 2)::INT ELSE 0 END::BIGINT AS n_true,
 CASE WHEN has_attributes THEN 1 - (z % 2) + (z % 5 >= 2)::INT ELSE 0 END::BIGINT AS n_false, CASE WHEN has_attributes THEN 2 ELSE 0 END::BIGINT AS n_text FROM businesses""", "businesses")
def _(spark, sf):
    b = derived.businesses(spark, sf).select("business_id", text.flat_attributes(F.col("attributes")).alias("a"))
    count = lambda test: F.size(F.filter("a", test))
    return plain(
        b.select(
            "business_id", F.size("a").alias("n"), count(lambda e: (e["kind"] == "bool") & (e["value"] == "true")).alias("n_true"),
            count(lambda e: (e["kind"] == "bool") & (e["value"] == "false")).alias("n_false"), count(lambda e: e["kind"] == "text").alias("n_text"),
        )
    )


@query("st_attribute_text_and_slug", "WITH " + ATTRIBUTE_ROWS + """
SELECT business_id, a.key || '=' || coalesce(a.value, '__unknown__') AS token,
  trim(regexp_replace(lower(a.key || '=' || coalesce(a.value, '__unknown__')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM attrs""", "businesses")
def _(spark, sf):
    b = derived.businesses(spark, sf).select("business_id", F.inline(text.flat_attributes(F.col("attributes"))))
    token = F.concat_ws("=", "key", text.attribute_text(F.col("value"), F.col("kind")))
    return b.select("business_id", token.alias("token"), text.slug(token).alias("slug"))


@query("st_opening_hours", """
WITH h AS (SELECT business_id, has_hours, sunday_start, sunday_end, CASE WHEN sunday_end = sunday_start THEN 1440 WHEN sunday_end < sunday_start THEN sunday_end + 1440 - sunday_start ELSE sunday_end - sunday_start END AS sunday FROM businesses)
SELECT business_id, CASE WHEN has_hours THEN 4 ELSE 0 END::DOUBLE AS open_days_count, CASE WHEN has_hours THEN 480 + 510 + 1440 + sunday ELSE 0 END::DOUBLE AS weekly_open_minutes,
 CASE WHEN has_hours THEN 2 ELSE 0 END::DOUBLE AS weekend_days_open, CASE WHEN has_hours THEN 2 + (sunday_end >= 1320 OR sunday_end <= 180)::INT ELSE 0 END::DOUBLE AS late_night_days FROM h""", "businesses")
def _(spark, sf):
    b = derived.businesses(spark, sf).withColumn("days", text.open_days(F.col("hours")))
    return b.select("business_id", *[c.alias(n) for n, c in text.opening_hours("days").items()])


@query("st_friends_and_elite", """
SELECT user_id, CASE WHEN friends IS NULL OR friends = 'None' THEN 0 ELSE 5 END::BIGINT AS n_friends,
 CASE WHEN elite = '2019,2020' THEN 2 WHEN elite = '2018;2019; 2021' THEN 3 ELSE 0 END::BIGINT AS n_elite,
 CASE WHEN friends IS NULL OR friends = 'None' THEN NULL ELSE split_part(friends, ', ', 1) END AS first_friend FROM users""", "users")
def _(spark, sf):
    return derived.users(spark, sf).select(
        "user_id", text.friend_count(F.col("friends")).alias("n_friends"), text.elite_years(F.col("elite")).alias("n_elite"),
        F.try_element_at(text.friend_list(F.col("friends")), F.lit(1)).alias("first_friend"),
    )


@query("st_text_default_and_distinct_tokens", """
SELECT business_id, CASE WHEN trim(city) = '' THEN '__missing__' ELSE trim(city) END AS city, coalesce(postal_code, '__unknown__') AS postal_code,
 len(list_distinct(tokens)) AS n_distinct FROM businesses""", "businesses")
def _(spark, sf):
    return plain(
        derived.businesses(spark, sf).select(
            "business_id", text.text_or(F.col("city"), "__missing__").alias("city"), text.text_or(F.col("postal_code"), "__unknown__").alias("postal_code"),
            F.size(F.array_distinct(text.tokens(F.col("categories")))).alias("n_distinct"),
        )
    )


@query("st_category_choice", """
SELECT business_id, coalesce(list_filter(tokens, lambda t: t IN ('ring', 'bolt', 'green'))[1], '__other__') AS family,
 CASE WHEN list_contains(tokens, 'widget') THEN 'widget' WHEN list_contains(tokens, 'gear') THEN 'gear' ELSE coalesce(tokens[1], 'Other') END AS macro FROM businesses""", "businesses")
def _(spark, sf):
    t = text.tokens(F.col("categories"))
    return derived.businesses(spark, sf).select(
        "business_id", text.first_allowed(t, ["ring", "bolt", "green"]).alias("family"), text.macro_category(t, ["widget", "gear"]).alias("macro")
    )


@query("bk_rank_quantile_fallback", """
WITH c AS (SELECT business_id, count(*) AS n FROM train GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n, business_id) - 1 AS place, count(*) OVER () AS total, (SELECT count(DISTINCT n) FROM c) AS kinds FROM c)
SELECT business_id, ['few', 'some', 'many'][greatest(ceil(place * least(3, kinds) / greatest(total - 1, 1)), 1)::INT] AS part,
 CASE WHEN n >= 0 AND n <= 20 THEN 'few' WHEN n > 20 AND n <= 30 THEN 'some' WHEN n > 30 AND n <= 100000 THEN 'many' END AS fixed FROM r""", "train")
def _(spark, sf):
    c = derived.train_reviews(spark, sf).groupBy("business_id").agg(F.count("*").alias("n"))
    ranked = buckets.bucketed(c, "n", "business_id", [0, 20, 20, 100000], ["few", "some", "many"], "part")  # equal edges: ranks decide
    return buckets.bucketed(ranked, "n", "business_id", [0, 20, 30, 100000], ["few", "some", "many"], "fixed").select("business_id", "part", "fixed")
