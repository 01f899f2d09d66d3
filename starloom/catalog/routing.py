"""Queries over metrics, ensembles, routers and blends, on predictions that any engine can recompute."""

from __future__ import annotations

from pyspark.sql import functions as F

from starloom.catalog.aggregates import test, train
from starloom.catalog.registry import plain, query, view
from starloom.functions import buckets, numeric
from starloom.operators import blending, metrics, priors, routing, splits
from starloom.operators.boosting import band_weight
from starloom.session import durable, one_row
from starloom.sources import derived

# Test rows with three predictions: user mean (null for new users), item mean (null for new items), and a
# mixture, plus the columns of a candidate model that cannot score some rows.
view("preds", ["ctest", "ctrain"], """
  SELECT t.*, coalesce(un, 0) AS history_count, CASE WHEN coalesce(un, 0) = 0 THEN '0' WHEN un = 1 THEN '1' WHEN un <= 5 THEN '2-5' WHEN un <= 20 THEN '6-20' ELSE '>20' END AS history_band,
   g, um AS p1, im AS p2, (coalesce(um, g) + 2 * coalesce(im, g) + g) / 4 AS p3, (coalesce(im, g) * 3 + g) / 4 AS incumbent_prediction_raw,
   CASE WHEN um IS NOT NULL AND useful <> 7 THEN (um + coalesce(im, g)) / 2 END AS deep_prediction_raw, (useful + 1) / 10.0::DOUBLE AS alpha,
   CASE WHEN um IS NOT NULL AND useful <> 7 THEN (um - g) / 2 END AS correction_hat, inn AS item_support, coalesce(us, 0) AS history_rating_std
  FROM ctest t LEFT JOIN (SELECT "user", avg(rating) AS um, count(*) AS un, stddev_pop(rating) AS us FROM ctrain GROUP BY 1) a USING ("user") LEFT JOIN (SELECT item, avg(rating) AS im, count(*) AS inn FROM ctrain GROUP BY 1) b USING (item), (SELECT avg(rating) AS g FROM ctrain)""")
RND = "CAST(least(greatest(floor({} + 0.5), 1), 5) AS DOUBLE)"
view("evals", ["preds"], f"""
  SELECT *, {RND.format('incumbent_prediction_raw')} AS incumbent_prediction, {RND.format('deep_prediction_raw')} AS deep_prediction_null, deep_prediction_raw IS NOT NULL AS ok FROM preds""")
view("ev", ["evals"], "SELECT * EXCLUDE (deep_prediction_null), CASE WHEN ok THEN deep_prediction_null END AS deep_prediction, CASE WHEN coalesce(history_count, 0) = 0 THEN 'cold_model' WHEN history_band IN ('2-5') THEN 'known_prefix_deep_model' ELSE 'known_model' END AS branch FROM evals")


def preds(spark, sf):
    t = train(spark, sf)
    g = one_row(t.agg(F.avg("rating").alias("g")))["g"]
    u = t.groupBy(F.col("user").alias("_u")).agg(F.avg("rating").alias("p1"), F.count(F.lit(1)).alias("un"), F.stddev_pop("rating").alias("us"))
    i = t.groupBy(F.col("item").alias("_i")).agg(F.avg("rating").alias("p2"), F.count(F.lit(1)).alias("item_support"))
    x = test(spark, sf)
    x = x.join(u, x["user"] == u["_u"], "left").join(i, x["item"] == i["_i"], "left").drop("_u", "_i")
    n, um, im = F.coalesce("un", F.lit(0)), F.coalesce("p1", F.lit(g)), F.coalesce("p2", F.lit(g))
    deep = F.col("p1").isNotNull() & (F.col("useful") != 7)
    return x.withColumns(
        {
            "history_count": n, "history_band": buckets.history_band(n), "g": F.lit(g), "p3": (um + 2 * im + g) / 4, "incumbent_prediction_raw": (im * 3 + g) / 4,
            "deep_prediction_raw": F.when(deep, (F.col("p1") + im) / 2), "alpha": (F.col("useful") + 1) / F.lit(10.0), "correction_hat": F.when(deep, (F.col("p1") - g) / 2),
            "history_rating_std": F.coalesce("us", F.lit(0.0)),
        }
    ).drop("un", "us")


def evals(spark, sf):
    p = preds(spark, sf)
    ok = F.col("deep_prediction_raw").isNotNull()
    return p.withColumns(
        {
            "incumbent_prediction": numeric.round_half_up(F.col("incumbent_prediction_raw")), "deep_prediction": F.when(ok, numeric.round_half_up(F.col("deep_prediction_raw"))),
            "deep_prediction_available": ok, "branch": routing.router_branch(F.col("history_count") > 0, F.col("history_band"), ["2-5"]),
        }
    )


ERR = "round(avg(abs(rating - {p})), 6) AS {n}mae, round(sqrt(avg((rating - {p}) ** 2)), 6) AS {n}rmse"


@query("ev_mae_rmse", f"SELECT {ERR.format(p='p1', n='')}, count(p1) AS n_samples FROM preds", "preds")
def _(spark, sf):
    return plain(metrics.overall(preds(spark, sf), "p1"))


@query("ev_by_band_and_branch", f"SELECT 'band' AS kind, history_band AS label, {ERR.format(p='p1', n='')}, count(p1) AS n_samples FROM ev GROUP BY 2 UNION ALL SELECT 'branch', branch, {ERR.format(p='p3', n='')}, count(p3) FROM ev GROUP BY 2", "ev")
def _(spark, sf):
    e = evals(spark, sf)
    a = metrics.by_group(e, "history_band", "p1").withColumn("kind", F.lit("band")).withColumnRenamed("history_band", "label")
    return plain(a.unionByName(metrics.by_group(e, "branch", "p3").withColumn("kind", F.lit("branch")).withColumnRenamed("branch", "label")))


@query("ev_by_frequency_band", """
WITH q AS (SELECT quantile_cont(inn, 1/3.0::DOUBLE) AS a, quantile_cont(inn, 2/3.0::DOUBLE) AS b FROM (SELECT count(*) AS inn FROM ctrain GROUP BY item)), t AS (SELECT *, CASE WHEN item_support IS NULL OR item_support <= a THEN 'low' WHEN item_support <= b THEN 'mid' ELSE 'high' END AS band FROM preds, q)
SELECT band, count(*) AS n_rows, round(avg(abs(rating - p3)), 6) AS mae, round(avg(rating - p3), 6) AS bias FROM t GROUP BY 1""", "preds ctrain")
def _(spark, sf):
    bands = splits.FrequencyBands("item").fit(train(spark, sf))
    return plain(metrics.by_frequency_band(bands, preds(spark, sf), "p3", {"mae": metrics.mae("p3"), "bias": F.avg(F.col("rating") - F.col("p3"))}))


@query("ev_raw_and_rounded", f"SELECT round(avg(abs(rating - p3)), 6) AS mae_raw, round(sqrt(avg((rating - p3) ** 2)), 6) AS rmse_raw, round(avg(abs(rating - {RND.format('p3')})), 6) AS mae_rounded, round(sqrt(avg((rating - {RND.format('p3')}) ** 2)), 6) AS rmse_rounded, count(*) AS n_rows FROM preds", "preds")
def _(spark, sf):
    return plain(metrics.raw_and_rounded(preds(spark, sf), "p3"))


@query("ev_ndcg", """
WITH s AS (SELECT "user", row_number() OVER (PARTITION BY "user" ORDER BY round(p3, 9) DESC, review_id) AS a, row_number() OVER (PARTITION BY "user" ORDER BY rating DESC, review_id) AS b, rating FROM preds)
SELECT "user", round(coalesce(sum(CASE WHEN a <= 5 THEN rating / log2(a + 1) END) / nullif(sum(CASE WHEN b <= 5 THEN rating / log2(b + 1) END), 0), 0), 6) AS ndcg FROM s GROUP BY 1""", "preds")
def _(spark, sf):
    return plain(metrics.ndcg(preds(spark, sf).withColumn("score", F.round("p3", 9)), "user", "score", "rating", "review_id", 5))


@query("ev_preference_auc", """
WITH s AS (SELECT "user", round(p3, 9) AS p, rating >= 4 AS pos, row_number() OVER (PARTITION BY "user", rating >= 4 ORDER BY review_id) AS r FROM preds WHERE rating >= 4 OR rating <= 2),
a AS (SELECT x."user", avg(CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0 END) AS auc FROM s x JOIN s y ON x."user" = y."user" AND x.pos AND NOT y.pos WHERE x.r <= 20 AND y.r <= 20 GROUP BY 1)
SELECT round(avg(auc), 6) AS pairwise_auc, count(*) AS n_users FROM a""", "preds")
def _(spark, sf):
    return plain(metrics.preference_auc(preds(spark, sf).withColumn("p", F.round("p3", 9)), "p", first=20))


SEGMENTS = "(SELECT unnest(['2', '3', '4', '5', '2-3', '4-5']) AS segment, unnest([2, 3, 4, 5, 2, 4]) AS lo, unnest([2, 3, 4, 5, 3, 5]) AS hi)"


@query("ev_short_segments", f"SELECT segment, {ERR.format(p='p3', n='')}, count(p3) AS n_samples FROM preds JOIN {SEGMENTS} ON history_count BETWEEN lo AND hi GROUP BY 1", "preds")
def _(spark, sf):
    return plain(metrics.short_segments(preds(spark, sf), "p3"))


@query("ev_transition_counts", f"""
SELECT history_count, count(*) AS n_samples, round(avg(abs(rating - {RND.format('p3')})), 6) AS known_model_mae, round(avg(abs(rating - {RND.format('p1')})), 6) AS transition_short_mae, round(avg(least(greatest((6 - history_count) / 4.0, 0.25), 0.85)), 6) AS average_short_weight
FROM preds WHERE history_band = '2-5' GROUP BY 1""", "preds")
def _(spark, sf):
    p = preds(spark, sf).withColumn("user_known_in_train", (F.col("history_count") > 0).cast("double"))
    return plain(metrics.transition_counts(p, {"known_model_mae": "p3", "transition_short_mae": "p1"}))


CAND = "count(*) AS n_samples, round(avg(abs(rating - incumbent_prediction)), 6) AS incumbent_mae, round(avg(abs(rating - deep_prediction)), 6) AS deep_mae, round(avg(abs(rating - deep_prediction)) - avg(abs(rating - incumbent_prediction)), 6) AS delta_mae"


@query("ev_candidate_by_band", f"SELECT history_band, {CAND}, round(sqrt(avg((rating - incumbent_prediction) ** 2)), 6) AS incumbent_rmse, round(sqrt(avg((rating - deep_prediction) ** 2)), 6) AS deep_rmse FROM ev WHERE ok AND history_band <> '0' GROUP BY 1", "ev")
def _(spark, sf):
    return plain(metrics.candidate_by_band(evals(spark, sf)))


@query("ev_candidate_by_segment", f"SELECT segment, {CAND} FROM ev JOIN {SEGMENTS} ON history_count BETWEEN lo AND hi WHERE ok AND history_band = '2-5' GROUP BY 1", "ev")
def _(spark, sf):
    return plain(metrics.candidate_by_short_segment(evals(spark, sf)))


@query("ev_coverage_by_band", "SELECT history_band, count(*) AS total_rows, count(*) FILTER (ok) AS deep_available_rows, count(*) FILTER (NOT ok) AS deep_unavailable_rows, " + ", ".join(f"count(*) FILTER (branch = '{b}') AS {b}_rows, count(*) FILTER (ok AND branch = '{b}') AS available_{b}_rows" for b in ("known_model", "known_prefix_deep_model", "cold_model")) + " FROM ev GROUP BY 1", "ev")
def _(spark, sf):
    return metrics.coverage_by_band(evals(spark, sf), "branch")


@query("ev_correction_stats", "SELECT history_band, count(*) AS n_samples, round(avg(alpha), 6) AS alpha_mean, round(stddev_pop(alpha), 6) AS alpha_std, " + ", ".join(f"round(quantile_cont(alpha, {p / 100}), 6) AS alpha_p{p}" for p in (10, 25, 50, 75, 90)) + ", round(avg(abs(correction_hat)), 6) AS mean_abs_correction, round(avg((abs(rating - deep_prediction) < abs(rating - incumbent_prediction))::INT), 6) AS improved_vs_incumbent_pct, round(avg((abs(rating - deep_prediction) > abs(rating - incumbent_prediction))::INT), 6) AS worse_vs_incumbent_pct FROM ev WHERE ok AND history_band <> '0' GROUP BY 1", "ev")
def _(spark, sf):
    return plain(metrics.correction_stats_by_band(evals(spark, sf)))


@query("ev_above_thresholds", """
WITH t AS (SELECT unnest([0.0, 0.3, 0.5, 0.7, 2.0])::DOUBLE AS threshold), e AS (SELECT * FROM ev WHERE ok)
SELECT threshold, count(alpha) AS n_samples, round(avg(abs(rating - incumbent_prediction)), 6) AS incumbent_mae, round(avg(abs(rating - deep_prediction)), 6) AS deep_mae, round(avg(abs(rating - deep_prediction)) - avg(abs(rating - incumbent_prediction)), 6) AS delta_mae,
 round(avg((abs(rating - deep_prediction) < abs(rating - incumbent_prediction))::INT), 6) AS improved_vs_incumbent_pct FROM t LEFT JOIN e ON alpha >= threshold GROUP BY 1""", "ev")
def _(spark, sf):
    return plain(metrics.above_thresholds(evals(spark, sf).filter("deep_prediction_available"), "alpha", [0.0, 0.3, 0.5, 0.7, 2.0]))


view("snap", ["ev"], f"""
  SELECT 'v3' AS snapshot, *, CASE WHEN item_support IS NULL THEN 'new_item' ELSE 'known_item' END AS item_status, CASE WHEN coalesce(item_support, 0) <= 0 THEN '0' WHEN item_support = 1 THEN '1' WHEN item_support <= 5 THEN '2-5' WHEN item_support <= 20 THEN '6-20' ELSE '>20' END AS item_support_bucket,
   round(sin(useful * 3 + funny), 6) AS known_prefix_history_similarity_mean, abs(rating - incumbent_prediction) AS ie, abs(rating - deep_prediction) AS de, abs(rating - deep_prediction) - abs(rating - incumbent_prediction) AS delta, abs(coalesce(correction_hat, 0)) AS ac, round(abs(rating - incumbent_prediction_raw), 9) AS gap FROM ev
  UNION ALL SELECT 'v4', * REPLACE ({RND.format('p3')} AS deep_prediction), CASE WHEN item_support IS NULL THEN 'new_item' ELSE 'known_item' END, CASE WHEN coalesce(item_support, 0) <= 0 THEN '0' WHEN item_support = 1 THEN '1' WHEN item_support <= 5 THEN '2-5' WHEN item_support <= 20 THEN '6-20' ELSE '>20' END,
   round(sin(useful * 3 + funny), 6), abs(rating - incumbent_prediction), abs(rating - {RND.format('p3')}), abs(rating - {RND.format('p3')}) - abs(rating - incumbent_prediction), abs(coalesce(correction_hat, 0)), round(abs(rating - incumbent_prediction_raw), 9) FROM ev""")


def stored_evals(spark, sf):
    """The columns that snapshots are made of, stored: a snapshot reads them on both sides of its join."""
    return durable(evals(spark, sf).select(
        "review_id", "user", "item", "rating", "item_support", "useful", "funny", "history_band", "history_count", "history_rating_std",
        "incumbent_prediction_raw", "deep_prediction_raw", "alpha", "correction_hat", "deep_prediction", "p3",
    ))


def snapshot(spark, sf, name, e=None):
    e = stored_evals(spark, sf) if e is None else e
    n = F.coalesce("item_support", F.lit(0))
    base = e.select(
        "review_id", "user", "item", "rating", F.when(n > 0, "known_item").otherwise("new_item").alias("item_status"), buckets.item_support_bucket(n).alias("item_support_bucket"),
        F.round(F.sin(F.col("useful") * 3 + F.col("funny")), 6).alias("known_prefix_history_similarity_mean"),
    )
    deep = F.col("deep_prediction") if name == "v3" else numeric.round_half_up(F.col("p3"))
    pred = e.select(
        "review_id", "history_band", "history_count", F.round("history_rating_std", 9).alias("history_rating_std"), "incumbent_prediction_raw", "deep_prediction_raw", "alpha", "correction_hat", F.lit(None).cast("double").alias("residual_hat"), deep.alias("deep_prediction"),
    )
    s = metrics.attach_snapshot(base, pred, name)
    return s.withColumn("incumbent_gap_abs", F.round("incumbent_gap_abs", 9))


DELTAS = "round(avg(ie), 6) AS incumbent_mae, round(avg(de), 6) AS deep_mae, round(avg(de) - avg(ie), 6) AS delta_mae, round(avg(alpha), 6) AS alpha_mean, round(avg(ac), 6) AS mean_abs_correction, round(avg((delta > 0)::INT), 6) AS worse_pct, round(avg((delta < 0)::INT), 6) AS improved_pct, round(CASE WHEN sum(abs(delta)) <= 1e-12 THEN 0 ELSE sum(greatest(delta, 0)) / sum(abs(delta)) END, 6) AS worse_error_mass_pct"
SEGSQL = f"""
SELECT snapshot, segment, count(*) AS total_rows, count(*) FILTER (ok) AS served_rows, round(avg(ok::INT), 6) AS served_pct, {DELTAS.replace('avg(ie)', 'avg(ie) FILTER (ok)').replace('avg(de)', 'avg(de) FILTER (ok)').replace('avg(alpha)', 'avg(alpha) FILTER (ok)').replace('avg(ac)', 'avg(ac) FILTER (ok)').replace('::INT)', '::INT) FILTER (ok)').replace('sum(abs(delta))', 'sum(abs(delta)) FILTER (ok)').replace('sum(greatest(delta, 0))', 'sum(greatest(delta, 0)) FILTER (ok)')},
 round(quantile_cont(CASE WHEN ok THEN alpha END, 0.1), 6) AS alpha_p10, round(quantile_cont(CASE WHEN ok THEN alpha END, 0.5), 6) AS alpha_p50, round(quantile_cont(CASE WHEN ok THEN alpha END, 0.9), 6) AS alpha_p90
FROM snap JOIN {SEGMENTS} ON history_count BETWEEN lo AND hi WHERE history_band = '2-5' GROUP BY 1, 2"""


def both_segments(spark, sf):
    e = stored_evals(spark, sf)
    return metrics.segment_metrics(snapshot(spark, sf, "v3", e)).unionByName(metrics.segment_metrics(snapshot(spark, sf, "v4", e)))


@query("ev_snapshot_segments", SEGSQL, "snap")
def _(spark, sf):
    return plain(both_segments(spark, sf))


@query("ev_compare_snapshots", f"WITH s AS ({SEGSQL}) SELECT a.segment, " + ", ".join(f"{t}.{c} AS {v}_{c}" for t, v in (("a", "v3"), ("b", "v4")) for c in ("served_rows", "incumbent_mae", "deep_mae", "delta_mae", "alpha_mean", "mean_abs_correction", "worse_pct")) + ", round(b.delta_mae - a.delta_mae, 5) AS v4_minus_v3_delta_mae FROM s a JOIN s b ON a.segment = b.segment WHERE a.snapshot = 'v3' AND b.snapshot = 'v4'", "snap")
def _(spark, sf):
    wide = metrics.compare_snapshots(plain(both_segments(spark, sf)), "v3", "v4")
    return plain(wide.withColumn("v4_minus_v3_delta_mae", F.round("v4_minus_v3_delta_mae", 5)))


CUT = f"""
s AS (SELECT *, round(history_rating_std, 9) AS hs FROM snap WHERE snapshot = 'v3' AND ok AND history_band = '2-5' AND history_count <= 3),
e AS (SELECT {", ".join(f"quantile_cont({c}, {q}) AS {n}{i}" for c, n in (("gap", "g"), ("hs", "v"), ("known_prefix_history_similarity_mean", "s")) for i, q in enumerate((0, 0.25, 0.5, 0.75, 1)))} FROM s),
b AS (SELECT *, {", ".join(f"CASE WHEN {n}0 = {n}1 OR {n}1 = {n}2 OR {n}2 = {n}3 OR {n}3 = {n}4 THEN 'all' WHEN {c} <= {n}1 THEN '{p}_q1' WHEN {c} <= {n}2 THEN '{p}_q2' WHEN {c} <= {n}3 THEN '{p}_q3' ELSE '{p}_q4' END AS {p}_b" for c, n, p in (("gap", "g", "gap"), ("hs", "v", "var"), ("known_prefix_history_similarity_mean", "s", "sim")))} FROM s, e),
x AS (SELECT *, unnest(['item_status', 'item_support_bucket', 'incumbent_gap_bucket', 'history_variance_bucket', 'prefix_similarity_bucket', 'exact_prefix_length']) AS crosscut, unnest([item_status, item_support_bucket, gap_b, var_b, sim_b, CAST(history_count AS VARCHAR)]) AS bucket FROM b),
c AS (SELECT snapshot, crosscut, bucket, count(*) AS n_samples, {DELTAS} FROM x GROUP BY ALL)"""


@query("ev_crosscuts", f"WITH {CUT} SELECT * FROM c", "snap")
def _(spark, sf):
    return plain(metrics.crosscuts(snapshot(spark, sf, "v3")))


@query("so_extreme_buckets", f"WITH {CUT}, r AS (SELECT *, row_number() OVER (PARTITION BY crosscut ORDER BY delta_mae, bucket) AS a, row_number() OVER (PARTITION BY crosscut ORDER BY delta_mae DESC, bucket) AS z FROM c) SELECT crosscut, bucket, delta_mae, 'best' AS \"end\", a AS rank FROM r WHERE a <= 2 UNION ALL SELECT crosscut, bucket, delta_mae, 'worst', z FROM r WHERE z <= 2", "snap")
def _(spark, sf):
    cuts = plain(metrics.crosscuts(snapshot(spark, sf, "v3")))
    return plain(metrics.extreme_buckets(cuts).select("crosscut", "bucket", "delta_mae", "end", "rank"))


@query("ev_hypotheses", f"""WITH {CUT}, s2 AS (SELECT count(*) AS two_three_rows, round(avg(delta), 6) AS two_three_delta_mae, round(CASE WHEN sum(abs(delta)) <= 1e-12 THEN 0 ELSE sum(greatest(delta, 0)) / sum(abs(delta)) END, 6) AS worse_error_mass_pct, round(avg(ac) FILTER (delta > 0), 6) AS worse_abs_correction_mean, round(avg(ac) FILTER (delta < 0), 6) AS improved_abs_correction_mean, round(avg(alpha) FILTER (delta > 0), 6) AS worse_alpha_mean, round(avg(alpha) FILTER (delta < 0), 6) AS improved_alpha_mean FROM s),
k AS (SELECT round(max(delta_mae) FILTER (crosscut = 'prefix_similarity_bucket') - min(delta_mae) FILTER (crosscut = 'prefix_similarity_bucket'), 5) AS prefix_similarity_delta_range, round(max(delta_mae) FILTER (crosscut = 'history_variance_bucket') - min(delta_mae) FILTER (crosscut = 'history_variance_bucket'), 5) AS history_variance_delta_range, count(*) FILTER (crosscut = 'history_variance_bucket') AS nv, round(max(delta_mae) - min(delta_mae), 5) AS subgroup_delta_spread, round(min(delta_mae), 5) AS best_subgroup_delta, round(max(delta_mae), 5) AS worst_subgroup_delta FROM c)
SELECT * EXCLUDE (nv), worse_abs_correction_mean > improved_abs_correction_mean AND worse_error_mass_pct >= 0.55 AS h1_overcorrection, nv >= 2 AND prefix_similarity_delta_range >= 0.01 AND history_variance_delta_range >= 0.005 AS h2_representation_noise, subgroup_delta_spread >= 0.015 AS h3_subpopulation_mix FROM s2, k""", "snap")
def _(spark, sf):
    s = durable(metrics.served_two_three(snapshot(spark, sf, "v3")))
    h = metrics.hypotheses(s, metrics.crosscuts(s))
    return plain(h.withColumns({c: F.round(c, 5) for c in h.columns if c.endswith(("_range", "_spread", "_subgroup_delta"))}))


RUNS = "r AS (" + " UNION ALL ".join(f"SELECT '{p}' AS run, history_band, avg(abs(rating - {p})) AS mae, count(*) AS n FROM preds GROUP BY 2" for p in ("p3", "incumbent_prediction_raw")) + ")"


def runs(spark, sf):
    p = preds(spark, sf)
    return metrics.by_group(p, "history_band", "p3").withColumn("run", F.lit("p3")).unionByName(metrics.by_group(p, "history_band", "incumbent_prediction_raw").withColumn("run", F.lit("incumbent_prediction_raw")))


@query("ev_compare_runs", f"WITH {RUNS} SELECT a.run, a.history_band, round(a.mae, 6) AS mae, round(b.mae, 6) AS baseline_mae, round(a.mae - b.mae, 6) AS delta_mae, a.n AS n_samples, round((a.mae - b.mae) * a.n, 4) AS weighted_delta FROM r a JOIN r b USING (history_band) WHERE b.run = 'incumbent_prediction_raw'", "preds")
def _(spark, sf):
    c = metrics.compare_runs(runs(spark, sf), "incumbent_prediction_raw")
    return plain(c.withColumn("weighted_delta", F.round("weighted_delta", 4)))


@query("ev_weighted_impact", f"WITH {RUNS} SELECT a.run, round(sum((a.mae - b.mae) * b.n) / sum(a.n), 6) AS estimated_overall_delta FROM r a JOIN r b USING (history_band) WHERE b.run = 'incumbent_prediction_raw' GROUP BY 1", "preds")
def _(spark, sf):
    return plain(metrics.weighted_impact(metrics.compare_runs(runs(spark, sf), "incumbent_prediction_raw")))


@query("an_best_per_family", f"WITH {RUNS} SELECT history_band, arg_min(run, (round(mae, 9), run)) AS best_run, round(min(mae), 6) AS mae FROM r GROUP BY 1", "preds")
def _(spark, sf):
    return plain(runs(spark, sf).groupBy("history_band").agg(F.min_by("run", F.struct(F.round("mae", 9), "run")).alias("best_run"), F.min("mae").alias("mae")))


@query("so_select_run", f"WITH {RUNS}, t AS (SELECT run, sum(mae * n) / sum(n) AS overall, sum(mae * n) FILTER (history_band <> '0') / sum(n) FILTER (history_band <> '0') AS known, max(mae) FILTER (history_band = '1') AS one, max(mae) FILTER (history_band = '2-5') AS short FROM r GROUP BY 1) SELECT run, round(overall, 6) AS overall, round(known, 6) AS known, row_number() OVER (ORDER BY overall, known, short) AS position FROM t", "preds")
def _(spark, sf):
    from starloom.plans.selection import rank_runs, run_table

    return plain(rank_runs(run_table(runs(spark, sf))).select("run", "overall", "known", "position"))


@query("so_selected_run", f"""WITH {RUNS}, t AS (SELECT run, sum(mae * n) / sum(n) AS overall, max(mae) FILTER (history_band = '1') AS one, max(mae) FILTER (history_band = '2-5') AS short FROM r GROUP BY 1),
o AS (SELECT *, row_number() OVER w AS p, lead(overall) OVER w AS next_overall, lead(one) OVER w AS next_one, lead(short) OVER w AS next_short FROM t WINDOW w AS (ORDER BY overall, one, short))
SELECT run, round(overall, 6) AS overall FROM o WHERE p = (SELECT CASE WHEN abs(overall - next_overall) <= 0.005 AND (next_one < one OR (next_one = one AND next_short < short)) THEN 2 ELSE 1 END FROM o WHERE p = 1)""", "preds")
def _(spark, sf):
    from starloom.plans.selection import run_table, select_run

    return plain(select_run(run_table(runs(spark, sf))).select("run", "overall"))


@query("an_validation_base", """
SELECT review_id, "user", item, rating, coalesce(n, 0) AS item_train_support, CASE WHEN coalesce(n, 0) > 0 THEN 'known_item' ELSE 'new_item' END AS item_status, CASE WHEN coalesce(n, 0) = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS item_support_bucket
FROM ctest LEFT JOIN (SELECT item, count(*) AS n FROM ctrain GROUP BY 1) USING (item)""", "ctest ctrain")
def _(spark, sf):
    from starloom.plans.selection import validation_base

    return validation_base(train(spark, sf), test(spark, sf))


@query("rt_combine", """
SELECT review_id, round(least(greatest(list_avg(list_filter([p1, p2, p3], lambda x: x IS NOT NULL)), 1), 5), 6) AS mean, round(least(greatest(list_aggregate(list_filter([p1, p2, p3], lambda x: x IS NOT NULL), 'median'), 1), 5), 6) AS median,
 round(least(greatest((coalesce(p1 * 0.5, 0) + coalesce(p2 * 0.3, 0) + p3 * 0.2) / (CASE WHEN p1 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN p2 IS NULL THEN 0 ELSE 0.3 END + 0.2), 1), 5), 6) AS weighted FROM preds""", "preds")
def _(spark, sf):
    m = ["p1", "p2", "p3"]
    return plain(preds(spark, sf).select("review_id", blending.combine(m, "mean").alias("mean"), blending.combine(m, "median").alias("median"), blending.combine(m, "weighted", [0.5, 0.3, 0.2]).alias("weighted")))


@query("rt_weights_from_errors", """
WITH e AS (SELECT sqrt(avg((rating - p1) ** 2)) AS a, sqrt(avg((rating - p2) ** 2)) AS b, sqrt(avg((rating - p3) ** 2)) AS c FROM preds), w AS (SELECT exp(-4 * a) AS a, exp(-4 * b) AS b, exp(-4 * c) AS c FROM e)
SELECT round(a / (a + b + c), 6) AS p1, round(b / (a + b + c), 6) AS p2, round(c / (a + b + c), 6) AS p3 FROM w""", "preds")
def _(spark, sf):
    w = blending.weights_from_errors(preds(spark, sf), ["p1", "p2", "p3"], temperature=4.0)
    return plain(spark.createDataFrame([tuple(w)], "p1 double, p2 double, p3 double"))


@query("rt_optimal_weights", """
WITH x AS (SELECT rating AS y, coalesce(p2, p3) AS a, p3 AS b FROM preds), w AS (SELECT least(greatest(sum((y - b) * (a - b)) / sum((a - b) ** 2), 0), 1) AS w FROM x) SELECT round(w, 4) AS p2, round(1 - w, 4) AS p3 FROM w""", "preds")
def _(spark, sf):
    w = blending.optimal_weights(preds(spark, sf), ["p2", "p3"])
    return plain(spark.createDataFrame([tuple(w)], "p2 double, p3 double"), 4)


@query("rt_ridge_stack", """
WITH m AS (SELECT avg(p2) AS ma FROM preds), x AS (SELECT rating AS y, coalesce(p2, ma) AS a FROM preds, m), c AS (SELECT avg(y) AS my, avg(a) AS aa FROM x), k AS (SELECT sum((a - aa) * (y - my)) / (sum((a - aa) ** 2) + 1.0) AS w, any_value(my) AS my, any_value(aa) AS aa FROM x, c)
SELECT review_id, round(least(greatest(my + w * (coalesce(p2, 0) - aa), 1), 5), 6) AS prediction FROM preds, k""", "preds")
def _(spark, sf):
    p = preds(spark, sf)
    return plain(p.select("review_id", blending.RidgeStack(["p2"], 1.0).fit(p).predict().alias("prediction")))


@query("rt_threshold_router", "SELECT review_id, CASE WHEN item_support IS NULL OR item_support <= 23 THEN 'rare' ELSE 'frequent' END AS model_used, item_support IS NOT NULL AS item_known, round(least(greatest(coalesce(CASE WHEN item_support IS NULL OR item_support <= 23 THEN p1 ELSE p2 END, g), 1), 5), 6) AS prediction FROM preds", "preds")
def _(spark, sf):
    r = routing.threshold_router(preds(spark, sf), train(spark, sf), "p1", "p2", 23)
    return plain(r.select("review_id", "model_used", "item_known", "prediction"))


@query("rt_cold_warm_router", """
WITH r AS (SELECT *, coalesce(history_count, 0) <= 3 AS uc, coalesce(item_support, 0) <= 15 AS ic FROM preds)
SELECT review_id, history_count > 0 AS user_known, coalesce(item_support, 0) > 0 AS item_known, uc AS user_is_cold, ic AS item_is_cold, CASE WHEN uc AND ic THEN 'cold_both' WHEN uc THEN 'cold_user' WHEN ic THEN 'cold_item' ELSE 'warm' END AS route,
 CASE WHEN uc AND ic THEN 'global_mean' WHEN uc THEN 'p2' WHEN ic THEN 'p1' ELSE 'p3' END AS model_used, round(least(greatest(coalesce(CASE WHEN uc AND ic THEN g WHEN uc THEN p2 WHEN ic THEN p1 ELSE p3 END, g), 1), 5), 6) AS prediction FROM r""", "preds")
def _(spark, sf):
    r = routing.cold_warm_router(preds(spark, sf), train(spark, sf), {"warm": "p3", "cold_user": "p2", "cold_item": "p1"}, user_threshold=3, item_threshold=15)
    return plain(r.select("review_id", "user_known", "item_known", "user_is_cold", "item_is_cold", "route", "model_used", "prediction"))


ADAPT = """
a AS (SELECT *, history_count AS nu, coalesce(item_support, 0) AS ni, (history_count * coalesce(p1, 0) + 10 * g) / (history_count + 10) AS su, (coalesce(item_support, 0) * coalesce(p2, 0) + 10 * g) / (coalesce(item_support, 0) + 10) AS si FROM preds),
b AS (SELECT *, CASE WHEN nu > 0 AND ni > 0 THEN 0.5 * su + 0.5 * si WHEN nu > 0 THEN su WHEN ni > 0 THEN si ELSE g END AS base FROM a), c AS (SELECT *, coalesce(p3, base) AS model_v, sqrt(least(nu / 20.0, 1) * least(ni / 20.0, 1)) AS cw FROM b)"""


@query("rt_adaptive_blend", f"WITH {ADAPT}, d AS (SELECT *, CASE WHEN nu > 0 AND ni > 0 THEN cw WHEN nu > 0 OR ni > 0 THEN cw * 0.35 ELSE 0 END AS w FROM c) SELECT review_id, nu AS user_count, ni AS item_count, round(base, 6) AS baseline, round(w, 6) AS weight, round(least(greatest(w * model_v + (1 - w) * base, 1), 5), 6) AS prediction FROM d", "preds")
def _(spark, sf):
    r = routing.adaptive_blend(preds(spark, sf), train(spark, sf), "p3")
    return plain(r.select("review_id", "user_count", "item_count", "baseline", "weight", "prediction"))


@query("rt_adaptive_posterior_blend", f"""WITH {ADAPT}, f AS (SELECT *, CASE WHEN p1 IS NOT NULL THEN (abs(p1 / (p1 + 2) - 0.5) + abs(2 / (p1 + 2) - 0.5)) / 1.0 END AS uc, CASE WHEN p2 IS NOT NULL THEN least(2 * (abs(p2 / 5 - 0.5) + abs(0.6 - 0.5)) / 2, 1) END AS ic FROM c),
h AS (SELECT *, sqrt(least(coalesce(uc, 0.25), 1) * least(coalesce(ic, 0.25) * 1.5, 1)) AS pw, abs(model_v - base) / 4.0 / 0.05 AS ratio FROM f), i AS (SELECT *, CASE WHEN ratio >= 1 THEN 1 ELSE 0.5 + 0.5 * ratio END AS pen FROM h),
d AS (SELECT *, (0.5 * cw + 0.5 * pw) * pen AS w0 FROM i), e AS (SELECT *, CASE WHEN nu > 0 AND ni > 0 THEN w0 WHEN nu > 0 OR ni > 0 THEN w0 * 0.35 ELSE 0 END AS w FROM d)
SELECT review_id, round(coalesce(uc, 0.25), 6) AS user_conf, round(coalesce(ic, 0.25), 6) AS item_conf, round(pw, 6) AS posterior_weight, round(pen, 6) AS collapse_penalty, round(w, 6) AS weight, round(least(greatest(w * model_v + (1 - w) * base, 1), 5), 6) AS prediction FROM e""", "preds")
def _(spark, sf):
    p = preds(spark, sf).withColumns({"uf": F.when(F.col("p1").isNotNull(), F.array("p1", F.lit(2.0))), "if": F.when(F.col("p2").isNotNull(), F.array(F.col("p2") / 5, F.lit(0.6)))})
    r = routing.adaptive_blend(p, train(spark, sf), "p3", posterior={"user_factors": "uf", "item_factors": "if"})
    return plain(r.select("review_id", "user_conf", "item_conf", "posterior_weight", "collapse_penalty", "weight", "prediction"))


@query("rt_cold_start_cases", """
SELECT CASE WHEN ku AND ki THEN 'both_known' WHEN ki THEN 'new_user' WHEN ku THEN 'new_item' ELSE 'new_both' END AS "case", count(*) AS n_rows FROM (SELECT history_count > 0 AS ku, item_support IS NOT NULL AS ki FROM preds) GROUP BY 1""", "preds")
def _(spark, sf):
    return splits.summarize_cases(train(spark, sf), test(spark, sf))


BRANCH = "CASE WHEN history_count = 0 THEN 'cold_model' WHEN history_band IN ('1', '6-20') THEN 'known_prefix_deep_model' WHEN history_band = '2-5' THEN 'transition_blend_model' ELSE 'known_model' END"


@query("rt_router_branches", f"SELECT review_id, branch AS simple, {BRANCH} AS with_transition, CASE WHEN history_count <= 0 THEN 'cold_user_tabular' WHEN history_count = 1 THEN 'very_short_history_tabular' WHEN history_count <= 20 THEN 'mid_history_tabular' ELSE 'long_history_tabular' END AS expert FROM ev", "ev")
def _(spark, sf):
    n, band = F.col("history_count"), F.col("history_band")
    return evals(spark, sf).select(
        "review_id", F.col("branch").alias("simple"), routing.router_branch(n > 0, band, ["1", "6-20"], transition=True).alias("with_transition"), routing.expert_branch(buckets.collapsed_band(n)).alias("expert"),
    )


@query("rt_band_gate", f"SELECT history_band, count(*) AS n_samples, round(avg(abs(rating - {RND.format('incumbent_prediction_raw')})), 6) AS incumbent_mae, round(avg(abs(rating - {RND.format('deep_prediction_raw')})), 6) AS candidate_mae, avg(abs(rating - {RND.format('deep_prediction_raw')})) - avg(abs(rating - {RND.format('incumbent_prediction_raw')})) <= -0.001 AS enabled FROM ev WHERE ok GROUP BY 1", "ev")
def _(spark, sf):
    return plain(routing.enabled_bands(evals(spark, sf), "incumbent_prediction_raw", "deep_prediction_raw", 0.001))


@query("rt_route_predictions", f"""
WITH r AS (SELECT review_id, branch, CASE branch WHEN 'cold_model' THEN p2 WHEN 'known_prefix_deep_model' THEN deep_prediction_raw ELSE p3 END AS chosen, p3 FROM ev)
SELECT review_id, CASE WHEN chosen IS NULL THEN 'known_model' ELSE branch END AS served_branch, round(coalesce(chosen, p3), 6) AS prediction_raw, {RND.format('coalesce(chosen, p3)')} AS prediction FROM r""", "ev")
def _(spark, sf):
    r = routing.route(evals(spark, sf), "branch", {"cold_model": "p2", "known_prefix_deep_model": "deep_prediction_raw", "known_model": "p3"}, "known_model")
    return plain(r.select("review_id", "served_branch", "prediction_raw", "prediction"))


@query("rt_transition_blend", "SELECT review_id, round(w * p1 + (1 - w) * p3, 6) AS blend FROM (SELECT *, least(greatest((6 - history_count) / 4.0, 0.25), 0.85) AS w FROM preds WHERE history_band = '2-5')", "preds")
def _(spark, sf):
    p = preds(spark, sf).filter(F.col("history_band") == "2-5")
    return plain(p.select("review_id", routing.transition_blend(F.col("p1"), F.col("p3"), F.col("history_count")).alias("blend")))


@query("rt_blend_alpha", f"""
WITH a AS (SELECT unnest([0.0, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0])::DOUBLE AS ga), e AS (SELECT history_band, ga, round(avg(abs(rating - {RND.format('ga * p3 + (1 - ga) * incumbent_prediction_raw')})), 12) AS mae FROM preds, a GROUP BY ALL),
b AS (SELECT history_band, min(mae) AS best FROM e GROUP BY 1) SELECT history_band, CASE WHEN max(ga) = 1 THEN 1 ELSE min(ga) END AS alpha, round(any_value(best), 6) AS mae FROM e JOIN b USING (history_band) WHERE mae = best GROUP BY 1""", "preds")
def _(spark, sf):
    return plain(blending.calibrate_alpha(preds(spark, sf), "p3", "incumbent_prediction_raw", "history_band"))


@query("rt_apply_blend", "SELECT review_id, round(a * p3 + (1 - a) * p2, 6) AS blended FROM (SELECT *, CASE history_band WHEN '0' THEN 0.3 WHEN '1' THEN 0.6 ELSE 1.0 END AS a FROM preds WHERE p2 IS NOT NULL)", "preds")
def _(spark, sf):
    alphas = spark.createDataFrame([("0", 0.3), ("1", 0.6)], "history_band string, alpha double")
    p = preds(spark, sf).filter(F.col("p2").isNotNull())
    return plain(blending.blend_by_group(p, alphas, "p3", "p2", "history_band", "blended").select("review_id", "blended"))


POLICY = "ok AND ((history_band = '2-5' AND alpha >= 0.4) OR (history_band = '6-20' AND abs(correction_hat) >= 0.1) OR history_band = '1')"


@query("rt_replacement_policy", f"SELECT review_id, coalesce({POLICY}, false) AS replace, CASE WHEN {POLICY} THEN deep_prediction ELSE incumbent_prediction END AS final_prediction FROM ev", "ev")
def _(spark, sf):
    r = routing.replacement(evals(spark, sf), ["1", "2-5", "6-20"], {"2-5": 0.4}, {"6-20": 0.1})
    return plain(r.select("review_id", "replace", "final_prediction"))


@query("rt_policy_counts", f"SELECT history_band, count(*) AS initial_candidate_rows, count(*) FILTER ({POLICY}) AS selected_rows FROM ev WHERE ok AND history_band IN ('1', '2-5', '6-20') GROUP BY 1", "ev")
def _(spark, sf):
    r = routing.replacement(evals(spark, sf), ["1", "2-5", "6-20"], {"2-5": 0.4}, {"6-20": 0.1})
    return routing.policy_counts(r, ["1", "2-5", "6-20"])


@query("rt_known_user_average", "SELECT review_id, round(CASE WHEN history_count > 0 AND deep_prediction_raw IS NOT NULL THEN (deep_prediction_raw + p3) / 2 ELSE p3 END, 6) AS prediction FROM preds", "preds")
def _(spark, sf):
    p = preds(spark, sf).withColumn("known", F.col("history_count") > 0)
    return plain(p.select("review_id", blending.known_user_average("known", "deep_prediction_raw", "p3").alias("prediction")))


@query("rt_scatter_subset", "SELECT review_id, round(CASE WHEN history_band = '2-5' THEN p1 END, 6) AS p1 FROM preds", "preds")
def _(spark, sf):
    p = preds(spark, sf)
    return plain(routing.scatter(p.select("review_id"), p.filter(F.col("history_band") == "2-5").select("review_id", "p1"), "p1"))


SUBS = "(SELECT review_id, unnest(['a', 'b', 'c', 'd']) AS path, unnest([" + ", ".join(RND.format(f"coalesce({c}, g)") for c in ("p1", "p2", "p3", "incumbent_prediction_raw")) + "]) AS stars FROM preds)"


def submissions(spark, sf):
    p = preds(spark, sf)
    r = lambda c: numeric.round_half_up(F.coalesce(c, "g"))
    pairs = F.array(*[F.struct(F.lit(n).alias("path"), r(c).alias("stars")) for n, c in (("a", "p1"), ("b", "p2"), ("c", "p3"), ("d", "incumbent_prediction_raw"))])
    return durable(p.select("review_id", F.inline(pairs)))  # stands for files that were written earlier


@query("rt_submission_ensemble", f"""
WITH s AS {SUBS}, m AS (SELECT review_id, median(stars) AS md, avg(stars) AS av, min(stars) AS lo, max(stars) AS hi, stddev_pop(stars) AS sd, list(stars ORDER BY stars) AS l FROM s GROUP BY 1)
SELECT review_id, lo AS prediction_min, hi AS prediction_max, hi - lo AS prediction_range, round(sd, 6) AS prediction_std, md AS median_raw, CAST(floor(md + 0.5) AS BIGINT) AS median_rounded, round(av, 6) AS mean_raw, (l[2] + l[3]) / 2 AS trimmed_raw FROM m""", "preds")
def _(spark, sf):
    s = submissions(spark, sf)
    a = blending.submission_ensemble(s, "median").withColumnsRenamed({"ensemble_raw": "median_raw", "ensemble_rounded": "median_rounded"})
    b = blending.submission_ensemble(s, "mean").select("review_id", F.col("ensemble_raw").alias("mean_raw"))
    c = blending.submission_ensemble(s, "trimmed_mean", 0.25).select("review_id", F.col("ensemble_raw").alias("trimmed_raw"))
    return plain(a.join(b, "review_id").join(c, "review_id"))


@query("rt_submission_mode", f"""
WITH s AS {SUBS}, c AS (SELECT review_id, stars, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT review_id, CAST(floor(median(stars) + 0.5) AS DOUBLE) AS md FROM s GROUP BY 1), t AS (SELECT review_id, max(n) AS top FROM c GROUP BY 1),
b AS (SELECT c.review_id, stars FROM c JOIN t ON c.review_id = t.review_id AND n = top) SELECT m.review_id, CASE WHEN bool_or(stars = md) THEN any_value(md) ELSE max(stars) END AS mode FROM m JOIN b USING (review_id) GROUP BY 1""", "preds")
def _(spark, sf):
    return plain(blending.submission_ensemble(submissions(spark, sf), "mode").select("review_id", F.col("ensemble_raw").alias("mode")))


@query("rt_submission_members", f"WITH s AS {SUBS} SELECT path, round(avg(stars), 6) AS mean_prediction, round(stddev_pop(stars), 6) AS std_prediction FROM s GROUP BY 1", "preds")
def _(spark, sf):
    return plain(blending.submission_members(submissions(spark, sf)))


WIDE = "w AS (SELECT review_id, " + ", ".join(RND.format(f"coalesce({c}, g)") + f" AS {n}" for n, c in (("a", "p1"), ("b", "p2"), ("c", "p3"), ("d", "incumbent_prediction_raw"))) + " FROM preds)"


def wide(spark, sf):
    p = preds(spark, sf)
    r = lambda c: numeric.round_half_up(F.coalesce(c, "g"))
    return p.select("review_id", r("p1").alias("a"), r("p2").alias("b"), r("p3").alias("c"), r("incumbent_prediction_raw").alias("d"))


VOTES = f"""WITH {WIDE}, l AS (SELECT review_id, d, unnest([a, b, c, d]) AS x FROM w), n AS (SELECT review_id, x, count(*) AS k FROM l GROUP BY ALL), m AS (SELECT review_id, min(x) AS mode, any_value(top) AS mode_count FROM n JOIN (SELECT review_id, max(k) AS top FROM n GROUP BY 1) USING (review_id) WHERE k = top GROUP BY 1),
s AS (SELECT review_id, any_value(d) AS d, min(x) AS lo, max(x) AS hi, avg(x) AS av, median(x) AS md, count(DISTINCT x) AS u FROM l GROUP BY 1), v AS (SELECT *, mode_count >= 3 AS maj, hi - lo >= 2 AS hard FROM s JOIN m USING (review_id))"""


@query("rt_majority_vote", VOTES + " SELECT review_id, mode AS blend_mode, mode_count AS blend_mode_count, md AS blend_median, round(av, 6) AS blend_mean, u AS blend_n_unique, hi - lo AS blend_max_diff, maj AS blend_has_majority, hard AS blend_strong_conflict, CAST(CASE WHEN hard THEN round_even(md, 0) WHEN NOT maj THEN d ELSE mode END AS BIGINT) AS stars_blend FROM v", "preds")
def _(spark, sf):
    v = blending.majority_vote(wide(spark, sf), ["a", "b", "c", "d"], "d", 3, 2, "base_model", "median")
    return plain(v.select("review_id", "blend_mode", "blend_mode_count", "blend_median", "blend_mean", "blend_n_unique", "blend_max_diff", "blend_has_majority", "blend_strong_conflict", "stars_blend"))


@query("rt_vote_summary", VOTES + " SELECT count(*) AS n_rows, count(*) FILTER (NOT maj) AS n_no_majority, count(*) FILTER (hard) AS n_strong_conflict, round(avg((NOT maj)::INT), 6) AS pct_no_majority, round(avg(hard::INT), 6) AS pct_strong_conflict, count(*) FILTER (hi - lo >= 2 AND NOT maj) AS n_conflict_rows FROM v", "preds")
def _(spark, sf):
    v = blending.majority_vote(wide(spark, sf), ["a", "b", "c", "d"], "d", 3, 2)
    n = one_row(blending.conflict_rows(v, 2, no_majority_only=True).agg(F.count(F.lit(1)).alias("n")))["n"]
    return plain(blending.vote_summary(v).withColumn("n_conflict_rows", F.lit(n)))


@query("rt_agreement", f"WITH {WIDE} SELECT x AS first, y AS second, round(c, 6) AS correlation, round((SELECT avg((a = b AND b = c AND c = d)::INT) FROM w), 6) AS all_agree FROM (" + " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, corr({x}, {y}) AS c FROM w" for i, x in enumerate("abcd") for y in "abcd"[i + 1:]) + ")", "preds")
def _(spark, sf):
    return plain(blending.agreement(wide(spark, sf), list("abcd")))


@query("rt_weighted_blend", "SELECT review_id, round(0.4 * coalesce(p1, g) + 0.6 * p3, 6) AS blend, CAST(least(greatest(floor(0.4 * coalesce(p1, g) + 0.6 * p3), 1), 5) AS DOUBLE) AS floored, CAST(least(greatest(ceil(0.4 * coalesce(p1, g) + 0.6 * p3), 1), 5) AS DOUBLE) AS ceiled, round(greatest(coalesce(p1, g), p3) - least(coalesce(p1, g), p3), 6) AS difference FROM preds", "preds")
def _(spark, sf):
    a, b = F.coalesce("p1", "g"), F.col("p3")
    x = 0.4 * a + 0.6 * b
    return plain(preds(spark, sf).select("review_id", x.alias("blend"), numeric.floor_stars(x).alias("floored"), numeric.ceil_stars(x).alias("ceiled"), (F.greatest(a, b) - F.least(a, b)).alias("difference")))


@query("md_batch_scoring_default", "SELECT review_id, round(coalesce(p1, 2.5), 6) AS prediction, p1 IS NULL AS failed FROM preds", "preds")
def _(spark, sf):
    from starloom.plans.selection import score_with_default

    return plain(score_with_default(preds(spark, sf), "p1", 2.5).select("review_id", "prediction", "failed"))


@query("md_tabular_baseline", """
SELECT review_id, round(least(greatest((uw * coalesce(p1, g) + bw * coalesce(p2, g) + g) / (uw + bw + 1), 1), 5), 6) AS prediction FROM (SELECT *, history_count / (history_count + 5.0) AS uw, coalesce(item_support, 0) / (coalesce(item_support, 0) + 10.0) AS bw FROM preds)""", "preds")
def _(spark, sf):
    from starloom.plans.selection import tabular_baseline

    p = preds(spark, sf)
    g = one_row(p.agg(F.max("g").alias("g")))["g"]
    return plain(p.select("review_id", tabular_baseline("p1", "history_count", "p2", "item_support", g).alias("prediction")))


FLAG = f"""
SELECT history_band, round(avg(abs(rating - p)), 6) AS mae, round(sqrt(avg((rating - p) ** 2)), 6) AS rmse, count(*) AS n_samples FROM (SELECT history_band, rating, {RND.format('least(greatest((uw * coalesce(p1, g) + bw * coalesce(p2, g) + g) / (uw + bw + 1), 1), 5)')} AS p
 FROM (SELECT *, history_count / (history_count + 5.0) AS uw, coalesce(item_support, 0) / (coalesce(item_support, 0) + 10.0) AS bw FROM preds)) GROUP BY 1"""


@query("flagship_banded_mae", FLAG, "preds")
def flagship(spark, sf):
    """Temporal split, train-only priors, banded baseline prediction, half-up rounding, error per band."""
    from starloom.plans.selection import tabular_baseline

    t = train(spark, sf)
    scalars = priors.train_scalars(t)
    u, i = priors.entity_priors(t, "user", "user", scalars), priors.entity_priors(t, "item", "business", scalars)
    rows = test(spark, sf)
    rows = rows.join(u, rows["user"] == u["user_id"], "left").join(i, rows["item"] == i["business_id"], "left")
    rows = rows.withColumn("history_band", buckets.history_band(F.coalesce("user_train_count", F.lit(0.0))))
    p = tabular_baseline("user_train_mean", "user_train_count", "business_train_mean", "business_train_count", scalars["global_mean"])
    return plain(metrics.by_group(rows.withColumn("p", numeric.round_half_up(p)), "history_band", "p"))


@query("rt_band_weights", "SELECT review_id, history_band, CASE history_band WHEN '1' THEN 1.5 WHEN '2-5' THEN 1.2 ELSE 1 END::DOUBLE AS weight FROM ev", "ev")
def _(spark, sf):
    return plain(evals(spark, sf).select("review_id", "history_band", band_weight(F.col("history_band")).alias("weight")))
