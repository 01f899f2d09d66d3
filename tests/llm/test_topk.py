"""The threshold algorithm against all inner products."""

import math
import random
from collections import defaultdict

import numpy as np

from starloom.llm import topk
from starloom.llm.topk import SortedLists, exact_top_k, whole_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_lists_stop_early_and_are_exact():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.exponential(20, (3000, 8)) ** 1.5).astype(np.int64)
    ids = rng.permutation(3000)
    lists = SortedLists(ids, vectors)
    for query in [*np.floor(rng.normal(0, 60, (20, 8))).astype(np.int64), np.zeros(8, np.int64), np.array([0, 0, 9, 0, 0, 0, 0, 0])]:
        found, depth = lists.top(int(ids[3]), query, 5)
        scores = vectors @ query
        want = sorted(((-int(s), int(v)) for s, v in zip(scores, ids) if v != ids[3]))[:5]
        assert [(-s, v) for s, v in found] == want
    assert lists.top(None, np.array([0, 0, 9, 0, 0, 0, 0, 0]), 5)[1] <= 64


def test_large_components_stay_exact():
    vectors = np.array([[2**31, 2**30 + 1], [2**31, 2**30], [-(2**31), 5]], np.int64)
    assert SortedLists(np.array([1, 2, 3]), vectors).top(None, np.array([2**28, 1], np.int64), 2)[0] == [(2**59 + 2**30 + 1, 1), (2**59 + 2**30, 2)]


def brute(rows, divisor, k):
    taking = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in taking:
        if i % divisor == 0:
            asked[i] = max(asked.get(i, v), v)
    out = {}
    for q, x in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in taking if i != q)[:k]
        out[q] = [(r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return out


def test_top_k_of_tables(make, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(4)], 0) for i in range(150)]
    rows += [(150, None, 1), (200, [None, 1.0, 1.0, 1.0], 1), (250, [float("nan"), 0.0, 0.0, 0.0], 1), (300, [float("inf"), 0.0, 0.0, 0.0], 1), (None, [1.0] * 4, 1)]
    rows += [(7, rows[7][1], 0), (50, [0.1, 0.2, 0.3, 0.4], 0), (350, [1.0, 1.0], 0), (400, [], 0)]
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "BLOCK_CANDIDATES", 40)
    vectors = whole_vectors(make(rows, SCHEMA))
    found = defaultdict(list)
    for r in exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert dict(found) == brute(rows, 50, 5)


def test_few_or_no_candidates(make):
    vectors = whole_vectors(make([(0, [1.0], 0), (1, [2.0], 0), (2, [2.0], 0)], SCHEMA))
    assert [tuple(r) for r in exact_top_k(vectors, vectors.where("vec_id = 0"), 5).orderBy("rank").collect()] == [(0, 1, 1, 131072), (0, 2, 2, 131072)]
    none = whole_vectors(make([], SCHEMA))
    assert exact_top_k(none, none, 5).count() == 0 and exact_top_k(vectors, none, 5).count() == 0 and exact_top_k(none, vectors, 5).count() == 0
