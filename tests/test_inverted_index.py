"""The inverted file against the exact search."""

import numpy as np
import pytest

from starloom.operators import inverted_index
from starloom.operators.embeddings import nearest
from starloom.operators.inverted_index import InvertedIndex


@pytest.fixture(scope="module")
def items(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 8))
    x = centers[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, 8))
    return spark.createDataFrame([(f"v{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)] + [("none", None)], "id string, embedding array<double>")


def pairs(df):
    return {(r["anchor"], r["rank"]): (r["neighbour"], round(r["cosine"], 9)) for r in df.collect()}


def test_all_lists_are_the_exact_search(items, monkeypatch):
    monkeypatch.setattr(inverted_index, "MAX_ITEM_ROWS", 20)  # long lists and crowds of queries are cut
    monkeypatch.setattr(inverted_index, "MAX_QUERY_ROWS", 15)
    whole = items.where("embedding is not null")
    index = InvertedIndex(lists=9).fit(items, "id")
    assert index.items.count() == 600
    assert pairs(index.search(items, "id", 5, 9)) == pairs(nearest(whole, whole, "id", 5))


def test_recall_of_the_tuned_index(items):
    whole = items.where("embedding is not null")
    index = InvertedIndex().fit(items, "id")
    probes = index.tuned(whole, "id", 5, queries=100)
    assert probes < len(index.centers) and index.recall(whole, whole, "id", 5, probes) >= 0.85
    assert index.recall(whole, whole, "id", 5, 1) < 1


def test_small_tables(spark, items):
    one = items.where("id = 'v001'")
    assert InvertedIndex().fit(one, "id").search(one, "id", 3, 1).count() == 0
    assert InvertedIndex().fit(items.limit(0), "id").items.count() == 0
