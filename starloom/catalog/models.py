"""Queries over rating models: biases, neighbours, factors and Bayesian models."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.aggregates import test, train
from starloom.catalog.registry import plain, query, view
from starloom.operators import bayes, bias, factors, neighbours, priors, recommend, routing
from starloom.operators.metrics import mae, rmse
from starloom.session import one_row
from starloom.sources import derived

view("g", ["ctrain"], "SELECT avg(rating) AS g FROM ctrain")
view("um", ["ctrain"], 'SELECT "user", avg(rating) AS um, count(*) AS un FROM ctrain GROUP BY 1')
view("im", ["ctrain"], "SELECT item, avg(rating) AS im, count(*) AS inn FROM ctrain GROUP BY 1")


@query("md_mean_model", 'SELECT review_id, round((coalesce(um, g) + coalesce(im, g)) / 2, 6) AS prediction FROM ctest LEFT JOIN um USING ("user") LEFT JOIN im USING (item), g', "ctest um im g")
def _(spark, sf):
    return plain(bias.MeanModel().fit(train(spark, sf)).predict(test(spark, sf)).select("review_id", "prediction"))


@query("md_bias_model", 'SELECT review_id, round(least(greatest(g + coalesce(um - g, 0) + coalesce(im - g, 0), 1), 5), 6) AS prediction FROM ctest LEFT JOIN um USING ("user") LEFT JOIN im USING (item), g', "ctest um im g")
def _(spark, sf):
    return plain(bias.BiasModel().fit(train(spark, sf)).predict(test(spark, sf)).select("review_id", "prediction"))


def bias_chain(source, epochs, reg_user=12, reg_item=5):
    """Alternating bias updates as a chain of statements; the last pair is ``bi`` and ``bu``."""
    parts, users = [f"m AS (SELECT avg(rating) AS m FROM {source})"], None
    for e in range(epochs):
        i, u = ("bi", "bu") if e == epochs - 1 else (f"i{e}", f"u{e}")
        join = f'LEFT JOIN {users} USING ("user")' if users else ""
        b = "coalesce(b, 0)" if users else "0"
        parts.append(f"{i} AS MATERIALIZED (SELECT item, sum(rating - m - {b}) / ({reg_item} + count(*)) AS b FROM {source} {join}, m GROUP BY 1)")
        parts.append(f'{u} AS MATERIALIZED (SELECT "user", sum(rating - m - b) / ({reg_user} + count(*)) AS b FROM {source} JOIN {i} USING (item), m GROUP BY 1)')
        users = u
    return ",\n".join(parts)


@query("md_regularized_bias", "WITH " + bias_chain("ctrain", 10) + """
SELECT review_id, bu.b IS NOT NULL AS known_user, bi.b IS NOT NULL AS known_item, round(m, 6) AS global_mean, round(coalesce(bu.b, 0), 6) AS user_bias, round(coalesce(bi.b, 0), 6) AS item_bias,
 round(least(greatest(m + coalesce(bu.b, 0) + coalesce(bi.b, 0), 1), 5), 6) AS prediction FROM ctest t LEFT JOIN bu ON t."user" = bu."user" LEFT JOIN bi ON t.item = bi.item, m""", "ctest ctrain")
def _(spark, sf):
    model = bias.RegularizedBiasModel().fit(train(spark, sf))
    rows = model.predict(model.components(test(spark, sf)).withColumnsRenamed({c: f"{c}_" for c in ("known_user", "known_item", "global_mean", "user_bias", "item_bias")}))
    return plain(rows.select("review_id", *[F.col(f"{c}_").alias(c) for c in ("known_user", "known_item", "global_mean", "user_bias", "item_bias")], "prediction"))


@query("md_extreme_biases", """
WITH g AS (SELECT avg(rating) AS g FROM ctrain), u AS (SELECT "user" AS entity, avg(rating) - any_value(g) AS bias, count(*) AS n FROM ctrain, g GROUP BY 1), i AS (SELECT item AS entity, avg(rating) - any_value(g) AS bias, count(*) AS n FROM ctrain, g GROUP BY 1)
SELECT 'user' AS kind, entity, round(bias, 6) AS bias, n FROM (SELECT * FROM u ORDER BY abs(bias) DESC, entity LIMIT 20) UNION ALL SELECT 'item', entity, round(bias, 6), n FROM (SELECT * FROM i ORDER BY abs(bias) DESC, entity LIMIT 20)
UNION ALL SELECT 'rare item', entity, round(bias, 6), n FROM (SELECT * FROM i WHERE n <= 15 ORDER BY abs(bias) DESC, entity LIMIT 20)""", "ctrain")
def _(spark, sf):
    m = bias.BiasModel().fit(train(spark, sf))
    row = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("entity"), F.col(f"{key}_bias").alias("bias"), F.col(f"n_{key}_ratings").alias("n"))
    parts = [
        row(bias.extreme_biases(m.users, "user", "user_bias", "n_user_ratings"), "user", "user"), row(bias.extreme_biases(m.items, "item", "item_bias", "n_item_ratings"), "item", "item"),
        row(bias.extreme_biases(m.items, "item", "item_bias", "n_item_ratings", rare=15), "rare item", "item"),
    ]
    return plain(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("so_recommend_unseen", """
WITH s AS (SELECT item, im FROM im), c AS (SELECT u."user", s.item, s.im FROM (SELECT DISTINCT "user" FROM ctest) u CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM ctrain t WHERE t."user" = u."user" AND t.item = s.item))
SELECT "user", item, round(im, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY im DESC, item) AS r FROM c) WHERE r <= 10""", "ctrain ctest im")
def _(spark, sf):
    t = train(spark, sf)
    scores = t.groupBy("item").agg(F.avg("rating").alias("score"))
    return plain(bias.recommend_by_item_score(test(spark, sf).select("user"), scores, t, 10))


view("fixed_vectors", ["ctrain", "ctest", "item_embeddings"], """
  SELECT * FROM (SELECT item, CAST(floor(100 * avg(rating)) AS BIGINT) AS bias FROM ctrain GROUP BY item) i
  LEFT JOIN (SELECT business_id, list_transform(embedding, lambda x: floor(256 * x)) AS v FROM item_embeddings) e ON business_id = item""")
view("fixed_scores", ["fixed_vectors"], """
  SELECT "user", item, CAST(coalesce(list_dot_product(e.w, v), 0) AS BIGINT) + bias AS score FROM (SELECT DISTINCT "user" FROM ctest) u
  LEFT JOIN (SELECT business_id AS id, list_transform(embedding, lambda x: floor(256 * x)) AS w FROM item_embeddings) e ON id = split_part("user", '-', 1) CROSS JOIN fixed_vectors""")


def fixed_factors(spark, sf):
    """Whole-numbered vectors of test users and train items, so that scores are exact; strangers and items without a vector among them."""
    vectors = derived.item_embeddings(spark, sf).select(F.col("business_id").alias("_id"), F.transform("embedding", lambda x: F.floor(256 * x).cast("double")).alias("factors"))
    users = test(spark, sf).select("user").distinct()
    users = users.join(vectors, F.split_part("user", F.lit("-"), F.lit(1)) == F.col("_id"), "left").select("user", "factors")
    items = train(spark, sf).groupBy("item").agg(F.floor(100 * F.avg("rating")).cast("double").alias("bias"))
    return users, items.join(vectors, F.col("item") == F.col("_id"), "left").select("item", "factors", "bias")


def whole(top):
    return top.select("user", "item", F.col("score").cast("bigint").alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("so_recommend_factors", """
SELECT "user", item, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS r
  FROM fixed_scores s WHERE NOT EXISTS (SELECT 1 FROM ctrain t WHERE t."user" = s."user" AND t.item = s.item)) WHERE r <= 10""", "fixed_scores")
def _(spark, sf):
    users, items = fixed_factors(spark, sf)
    return whole(recommend.top_items(users, items, 10, train(spark, sf)))


@query("so_recommend_factors_with_seen", """
SELECT "user", item, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item) AS r FROM fixed_scores) WHERE r <= 10""", "fixed_scores")
def _(spark, sf):
    users, items = fixed_factors(spark, sf)
    return whole(recommend.top_items(users, items, 10))


@query("so_recommend_model")
def _(spark, sf):
    model = factors.BiasedFactorModel(rank=20, iterations=20, rate=0.007, reg=0.02).fit(train(spark, sf))
    return plain(model.recommend(test(spark, sf).select("user"), 10, seen=train(spark, sf)))


@query("so_recommend_adaptive")
def _(spark, sf):
    t = train(spark, sf)
    model = factors.BiasedFactorModel(rank=20, iterations=20, rate=0.007, reg=0.02).fit(t)
    return plain(recommend.recommend(recommend.AdaptiveRecommender(model, t), test(spark, sf).select("user"), t, 10))


view("dedup", ["ctrain"], 'SELECT "user", item, avg(rating) AS rating FROM ctrain GROUP BY ALL')
view("user_pairs", ["dedup"], """
  SELECT a, b, n, CASE WHEN la * lb = 0 THEN 0 ELSE xy / (la * lb) END * n / (n + 10.0) * least(n / 50.0, 1) * (0.5 * n / (ca + cb - n) + 0.5) AS similarity, n / (ca + cb - n)::DOUBLE AS jaccard FROM (
   SELECT x."user" AS a, y."user" AS b, count(*) AS n, sum((x.rating - p.m) * (y.rating - q.m)) AS xy, sqrt(sum((x.rating - p.m) ** 2)) AS la, sqrt(sum((y.rating - q.m) ** 2)) AS lb, any_value(p.c) AS ca, any_value(q.c) AS cb
   FROM dedup x JOIN dedup y ON x.item = y.item AND x."user" < y."user" JOIN (SELECT "user", avg(rating) AS m, count(*) AS c FROM dedup GROUP BY 1) p ON x."user" = p."user" JOIN (SELECT "user", avg(rating) AS m, count(*) AS c FROM dedup GROUP BY 1) q ON y."user" = q."user" GROUP BY 1, 2)""")


@query("md_user_similarity", "SELECT a, b, n, round(similarity, 6) AS similarity, round(jaccard, 6) AS jaccard FROM user_pairs", "user_pairs")
def _(spark, sf):
    return plain(neighbours.WeightedUserSimilarity().fit(train(spark, sf)).pairs)


@query("md_user_knn_prediction", """
WITH both_ways AS (SELECT a, b, similarity FROM user_pairs UNION ALL SELECT b, a, similarity FROM user_pairs), um AS (SELECT "user", avg(rating) AS m FROM dedup GROUP BY 1), asked AS (SELECT DISTINCT "user", item FROM ctest),
c AS (SELECT q."user", q.item, d."user" AS v, d.rating, coalesce(s.similarity, 0) AS s FROM asked q JOIN dedup d ON q.item = d.item AND d."user" <> q."user" LEFT JOIN both_ways s ON s.a = q."user" AND s.b = d."user"),
k AS (SELECT c.*, um.m, row_number() OVER (PARTITION BY c."user", item ORDER BY s DESC, v) AS r FROM c JOIN um ON c.v = um."user"), p AS (SELECT "user", item, sum(s * (rating - m)) AS num, sum(s) AS ss, sum(abs(s)) AS den FROM k WHERE r <= 20 GROUP BY 1, 2)
SELECT review_id, round(um.m + CASE WHEN abs(coalesce(ss, 0)) < 1e-15 THEN 0 ELSE num / den END, 5) AS prediction FROM ctest t LEFT JOIN p USING ("user", item) LEFT JOIN um ON t."user" = um."user\"""", "user_pairs dedup ctest")
def _(spark, sf):
    model = neighbours.WeightedUserSimilarity().fit(train(spark, sf))
    return plain(model.predict(test(spark, sf)).select("review_id", "prediction"), 5)


ITEM_PAIRS = """
st AS (SELECT item, sum(rating) AS s1, sum(rating * rating) AS s2 FROM dedup GROUP BY 1), nu AS (SELECT count(DISTINCT "user") AS nu FROM dedup),
co AS (SELECT x.item AS a, y.item AS b, sum(x.rating * y.rating) AS xy, sum(least(x.rating, y.rating)) AS mn FROM dedup x JOIN dedup y ON x."user" = y."user" AND x.item <> y.item GROUP BY 1, 2)"""
ITEM_TAIL = """
kn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d, 12), b) AS r FROM pr) WHERE r <= 40), g AS (SELECT avg(rating) AS g FROM dedup),
p AS (SELECT q."user", q.item, sum(s * d.rating) / nullif(sum(s), 0) AS e, avg(d.rating) AS m FROM (SELECT DISTINCT "user", item FROM ctest) q JOIN dedup d ON q."user" = d."user" JOIN kn ON kn.a = q.item AND kn.b = d.item GROUP BY 1, 2)
SELECT review_id, round(least(greatest(coalesce(e, m, g), 1), 5), 5) AS prediction FROM ctest LEFT JOIN p USING ("user", item), g"""
DISTANCES = {
    "cosine": ("co JOIN st x ON a = x.item JOIN st y ON b = y.item", "1 - xy / (sqrt(x.s2) * sqrt(y.s2))", "greatest(1 - d, 0)"),
    "correlation": ("co JOIN st x ON a = x.item JOIN st y ON b = y.item CROSS JOIN nu", "1 - (xy - x.s1 * y.s1 / nu) / sqrt((x.s2 - x.s1 * x.s1 / nu) * (y.s2 - y.s1 * y.s1 / nu))", "greatest(1 - d, 0)"),
    "euclidean": ("all_pairs", "sqrt(x2 + y2 - 2 * coalesce(xy, 0))", "1 / (1 + d)"),
    "manhattan": ("all_pairs", "x1 + y1 - 2 * coalesce(mn, 0)", "1 / (1 + d)"),
}
ALL_PAIRS = "all_pairs AS (SELECT x.item AS a, y.item AS b, x.s1 AS x1, y.s1 AS y1, x.s2 AS x2, y.s2 AS y2, xy, mn FROM st x JOIN st y ON x.item <> y.item LEFT JOIN co ON co.a = x.item AND co.b = y.item)"


def item_knn(metric):
    source, distance, similarity = DISTANCES[metric]
    extra = ALL_PAIRS + "," if source == "all_pairs" else ""
    sql = f"WITH {ITEM_PAIRS}, {extra} pd AS (SELECT a, b, {distance} AS d FROM {source}), pr AS (SELECT a, b, d, {similarity} AS s FROM pd), {ITEM_TAIL.strip()}"

    @query(f"md_item_knn_{metric}", sql, "dedup ctest")
    def _(spark, sf):
        return plain(neighbours.ItemKNN(40, metric).fit(train(spark, sf)).predict(test(spark, sf)).select("review_id", "prediction"), 5)


for _metric in DISTANCES:
    item_knn(_metric)


@query("md_knn_baseline", "WITH " + bias_chain("dedup", 10) + """,
x AS (SELECT d."user", d.item, rating - m - bu.b - bi.b AS x FROM dedup d JOIN bu ON d."user" = bu."user" JOIN bi ON d.item = bi.item, m),
pr AS (SELECT p.item AS a, q.item AS b, sum(p.x * q.x) / nullif(sqrt(sum(p.x * p.x)) * sqrt(sum(q.x * q.x)), 0) * (count(*) - 1) / (count(*) - 1 + 100.0) AS s FROM x p JOIN x q ON p."user" = q."user" AND p.item <> q.item GROUP BY 1, 2 HAVING s > 0),
k AS (SELECT c."user", c.item, s, x.x, row_number() OVER (PARTITION BY c."user", c.item ORDER BY s DESC, b) AS r FROM (SELECT DISTINCT "user", item FROM ctest) c JOIN x ON c."user" = x."user" JOIN pr ON a = c.item AND b = x.item),
p AS (SELECT "user", item, sum(s * x) / sum(s) AS e FROM k WHERE r <= 40 GROUP BY 1, 2)
SELECT review_id, round(least(greatest(m + coalesce(bu.b, 0) + coalesce(bi.b, 0) + CASE WHEN bu.b IS NOT NULL AND bi.b IS NOT NULL THEN coalesce(e, 0) ELSE 0 END, 1), 5), 5) AS prediction
FROM ctest t LEFT JOIN p ON t."user" = p."user" AND t.item = p.item LEFT JOIN bu ON t."user" = bu."user" LEFT JOIN bi ON t.item = bi.item, m""", "dedup ctest")
def _(spark, sf):
    return plain(neighbours.BaselineKNN().fit(train(spark, sf)).predict(test(spark, sf)).select("review_id", "prediction"), 5)


@query("md_knn_baseline_users")
def _(spark, sf):
    model = neighbours.BaselineKNN(user_based=True, min_k=2, unknown="global_mean").fit(train(spark, sf))
    return plain(model.predict(test(spark, sf)).select("review_id", "prediction"), 5)


@query("se_jaccard_items", """
SELECT a, b, n AS both_sides, ca + cb - n AS either_side FROM (SELECT x."user" AS a, y."user" AS b, count(*) AS n FROM dedup x JOIN dedup y ON x.item = y.item AND x."user" < y."user" GROUP BY 1, 2)
JOIN (SELECT "user" AS a, count(*) AS ca FROM dedup GROUP BY 1) USING (a) JOIN (SELECT "user" AS b, count(*) AS cb FROM dedup GROUP BY 1) USING (b)""", "dedup")
def _(spark, sf):
    r = priors.average_duplicates(train(spark, sf)).withColumn("one", F.lit(1.0))
    sizes = lambda s: r.groupBy(F.col("user").alias(s)).agg(F.count(F.lit(1)).alias(f"c{s}"))
    n = neighbours.common_sums(r, "item", "user", "one").select("a", "b", F.col("n").alias("both_sides"))
    return n.join(sizes("a"), "a").join(sizes("b"), "b").select("a", "b", "both_sides", (F.col("ca") + F.col("cb") - F.col("both_sides")).alias("either_side"))


@query("en_dense_ids", 'SELECT "user", row_number() OVER (ORDER BY "user") - 1 AS user_idx FROM (SELECT DISTINCT "user" FROM canonical)', "canonical")
def _(spark, sf):
    return plain(factors.dense_ids(derived.reviews(spark, sf).select(F.col("user_id").alias("user")), "user"))


@query("md_rating_scale", "SELECT min(rating) AS low, max(rating) AS high FROM ctrain", "ctrain")
def _(spark, sf):
    return spark.createDataFrame([factors.rating_scale(train(spark, sf))], "low double, high double")


def scored(model, spark, sf):
    rows = model.fit(train(spark, sf)).predict(test(spark, sf))
    return plain(rows.select("review_id", "rating", "prediction"))


@query("md_biased_factors")
def _(spark, sf):
    return scored(factors.BiasedFactorModel(rank=150, iterations=30), spark, sf)


@query("md_factors_without_bias")
def _(spark, sf):
    return scored(factors.BiasedFactorModel(rank=150, iterations=30, use_bias=False), spark, sf)


@query("md_factors_seed_ensemble")
def _(spark, sf):
    return scored(factors.BiasedFactorModel(rank=150, iterations=30, seeds=(42, 7, 2026)), spark, sf)


@query("md_factor_explanation")
def _(spark, sf):
    model = factors.BiasedFactorModel(rank=20, iterations=20, rate=0.007, reg=0.02).fit(train(spark, sf))
    return plain(model.explain(test(spark, sf).select("review_id", "user", "item")))


@query("md_nonnegative_factors")
def _(spark, sf):
    return scored(factors.NonNegativeModel(rank=15, iterations=50), spark, sf)


@query("md_factor_regressor")
def _(spark, sf):
    return scored(factors.FactorRegressor(factors.BiasedFactorModel(rank=20, iterations=20, rate=0.01, reg=0.02), "forest"), spark, sf)


@query("md_factor_ridge")
def _(spark, sf):
    return scored(factors.FactorRegressor(factors.BiasedFactorModel(rank=20, iterations=20, rate=0.01, reg=0.02), "ridge"), spark, sf)


@query("md_bias_svd")
def _(spark, sf):
    return scored(factors.BiasSVDModel(rank=50), spark, sf)


GIBBS = {"rank": 20, "sweeps": 100, "burn_in": 50, "thin": 2}


@query("md_bayesian_pmf")
def _(spark, sf):
    return scored(bayes.BayesianPMF(**GIBBS), spark, sf)


@query("md_bayesian_pmf_biases")
def _(spark, sf):
    return scored(bayes.BayesianPMF(**GIBBS, biases=True), spark, sf)


@query("md_bayesian_pmf_spread")
def _(spark, sf):
    model = bayes.BayesianPMF(**GIBBS, keep_samples=True).fit(train(spark, sf))
    return plain(model.predict_with_spread(test(spark, sf)))


def bnmf(spark, sf):
    return bayes.BayesianNonNegativeMF(rank=20, steps=50).fit(train(spark, sf))


@query("md_bayesian_nmf")
def _(spark, sf):
    return plain(bnmf(spark, sf).expected(test(spark, sf).select("review_id", "user", "item")).drop("pmf"))


@query("md_bayesian_nmf_posteriors")
def _(spark, sf):
    m = bnmf(spark, sf)
    u = bayes.user_posterior(m.users).select(F.lit("user").alias("kind"), F.col("user").alias("id"), "dominant_factor", F.col("entropy").alias("value"), F.col("gamma_mass").alias("mass"))
    i = bayes.item_posterior(m.items).select(F.lit("item").alias("kind"), F.col("item").alias("id"), "dominant_factor", F.col("mean_beta_variance").alias("value"), F.col("posterior_mass").alias("mass"))
    return plain(u.unionByName(i))


@query("md_bayesian_nmf_trace")
def _(spark, sf):
    return plain(bnmf(spark, sf).trace)


@query("md_bayesian_nmf_cases")
def _(spark, sf):
    rows = bayes.analyze_case(bnmf(spark, sf), train(spark, sf).select("review_id", "user", "item"))
    return plain(rows.select("review_id", "probability", "user_factor", "item_factor", "entropy", "posterior_mass", F.array_max("responsibility").alias("peak"), F.col("top_factors")[0]["factor"].alias("top_factor")))


@query("an_factor_health")
def _(spark, sf):
    m = bnmf(spark, sf)
    return plain(bayes.factor_health(m.users, m.items))


@query("so_top_components", """
SELECT vec_id, arg_max(i, p) AS factor, round(max(p), 6) AS product FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE * unnest(embedding)::DOUBLE AS p FROM embeddings) GROUP BY 1""")
def _(spark, sf):
    e = derived.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return plain(e.select("vec_id", factors.top_components("e", "e", 3)[0].alias("t")).select("vec_id", F.col("t.factor").alias("factor"), F.col("t.product").alias("product")))


@query("md_implicit_vectors", """
WITH s AS (SELECT DISTINCT "user", item FROM ctrain), n AS (SELECT "user", count(*) AS n FROM s GROUP BY 1), x AS (SELECT "user", unnest(embedding) AS v, unnest(range(64)) AS i FROM s JOIN item_embeddings ON item = business_id)
SELECT "user", i AS position, round(sum(v) / sqrt(any_value(n)), 5) AS value, any_value(n) AS n_seen FROM x JOIN n USING ("user") WHERE i < 8 GROUP BY 1, 2""", "ctrain item_embeddings")
def _(spark, sf):
    e = derived.item_embeddings(spark, sf).select(F.col("business_id").alias("item"), F.slice("embedding", 1, 8).alias("factors"))
    rows = factors.implicit_vectors(train(spark, sf), e, 8)
    return plain(rows.select("user", "n_seen", F.posexplode("implicit").alias("position", "value")), 5)
