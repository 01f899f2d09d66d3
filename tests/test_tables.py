"""Sources, sinks and schema checks."""

import pytest
from pyspark.sql import functions as F

from starloom.operators.profile import DatasetProfiler
from starloom.operators import blending
from starloom.plans.representation import Representation, build_representation
from starloom.sources import derived, tables
from starloom.sources.tables import canonical_reviews

SF = "/root/testdata/sf0.001"


def test_csv_with_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "business.csv"
    path.write_text('business_id,city,state,postal_code,latitude,longitude,stars,review_count,is_open,attributes,categories,hours\nb1,"A, ""x""\ny",S,1,1.5,2,4.5,3,1,"{\'a\': \'b\'}","Food, Bars",\n')
    row = tables.load_businesses(spark, str(path)).first()
    assert row["city"] == 'A, "x"\ny' and row["stars"] == 4.5 and row["hours"] is None
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.json")


def test_all_problems_are_reported(spark, tmp_path):
    spark.range(3).withColumnRenamed("id", "a").write.parquet(str(tmp_path / "one.parquet"))
    with pytest.raises(tables.SchemaProblem) as error:
        tables.load_artifacts(spark, str(tmp_path), {"one": ["a", "b"], "two": ["c"]})
    assert "one: missing columns ['b']" in str(error.value) and "two" in str(error.value)


def test_duplicate_keys_are_an_error(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    with pytest.raises(tables.SchemaProblem):
        tables.require_unique(df, ["k"])
    with pytest.raises(tables.SchemaProblem):
        tables.require_columns(df.limit(0), ["k"], not_empty=True)


def test_submissions_round_trip(spark, tmp_path):
    for name, star in (("keep_a", 2.0), ("keep_b", 5.0), ("drop_c", 1.0)):
        df = spark.createDataFrame([("r1", star), ("r2", 3.0)], "id string, p double")
        tables.write_submission(df, str(tmp_path / name), "id", "p", "review_id", "stars")
    long = tables.read_submissions(spark, str(tmp_path), include=["keep"], exclude=["drop"])
    assert long.select("path").distinct().count() == 2
    got = {r["review_id"]: r["ensemble_raw"] for r in blending.submission_ensemble(long, "mean").collect()}
    assert got == {"r1": 3.5, "r2": 3.0}
    with pytest.raises(ValueError):
        blending.submission_ensemble(long.filter("review_id = 'r1' or path like '%keep_a%'"), "mean")


def test_scalars_and_embeddings_round_trip(spark, tmp_path):
    tables.save_scalars(spark, {"g": 3.5, "n": 4}, str(tmp_path / "s"))
    assert tables.load_scalars(spark, str(tmp_path / "s")) == {"g": 3.5, "n": 4}
    bad = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id string, embedding array<double>")
    bad.write.parquet(str(tmp_path / "e.parquet"))
    with pytest.raises(tables.SchemaProblem):
        tables.load_embeddings(spark, str(tmp_path / "e.parquet"), "id")


def test_representation_round_trip(spark, tmp_path):
    train = canonical_reviews(derived.train_reviews(spark, SF))
    rep = build_representation(derived.businesses(spark, SF), train, min_city=5, min_category=5, min_attribute=5, clusters=3, max_city_columns=2).require_valid()
    rep.save(str(tmp_path))
    back = Representation.load(spark, str(tmp_path))
    assert back.matrix.count() == rep.matrix.count()
    assert back.select("prior").join(back.select("content"), ["business_id", "feature_index"]).count() == 0
    assert back.features.filter("feature_name like 'geo__city_hash%'").count() > 0
    assert back.features.filter("feature_name like 'geo__cluster%'").count() == 3


def test_profiler_report(spark, tmp_path):
    p = DatasetProfiler().fit(canonical_reviews(derived.reviews(spark, SF)))
    p.save(str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report")).filter("section = 'diagnostics'").count() == 6
    assert '"n_interactions": 6000' in p.to_json()


def test_stream_scores_like_batch(spark, tmp_path):
    from starloom.streaming.scoring import fit_scorer, score, score_stream

    train, test = derived.train_reviews(spark, SF), derived.test_reviews(spark, SF)
    scorer = fit_scorer(canonical_reviews(train))
    test.repartition(3).write.parquet(str(tmp_path / "in"))
    query = score_stream(spark, str(tmp_path / "in"), test.schema, scorer, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    streamed = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("review_id", "stars").collect())
    batch = sorted(tuple(r) for r in score(canonical_reviews(test), scorer).select("review_id", "stars").collect())
    assert streamed == batch and len(batch) > 0
