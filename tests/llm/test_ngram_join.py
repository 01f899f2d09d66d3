"""The n-gram join against brute force over all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from starloom.llm import ngram_join
from starloom.llm.components import connected_components
from starloom.llm.ngram_join import TileIndex, drop_near_duplicates, link_tile, ngram_jaccard_components

from .hard_texts import HARD_TEXTS


def shingles(text, width):
    words = (text or "").encode().lower().split()
    width = min(width, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(rows, width, threshold):
    """component_id by row number."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return [rows[i][0] if not sets[i] else smallest.get(root(i)) for i in range(len(rows))], [len(s) for s in sets]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    """Groups of near copies around the threshold, a passage that many texts share, and hard texts."""
    rng = random.Random(seed)
    texts = list(HARD_TEXTS)
    passage = " ".join(f"p{i}" for i in range(40))
    for size in (3, 5, 9, 14, 20, 60, 150, 400):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(9):
            texts.append(edited(rng, base, rng.randrange(0, max(2, size // 25))))
    for _ in range(40):
        texts.append(passage + " " + " ".join(f"q{rng.randrange(400)}" for _ in range(rng.randrange(0, 12))))
    return [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(3, "word"), (30, "another text under a used number")]


@pytest.mark.parametrize("width, threshold", [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_components_are_those_of_all_pairs(make, width, threshold):
    rows = corpus(width)
    found = ngram_jaccard_components(make(rows, "doc_id long, text string"), width, threshold)
    want, sizes = brute(rows, width, threshold)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id is None, r.component_id or 0) for r in found.collect())
    assert got == sorted((d is None, d or 0, n, c is None, c or 0) for (d, _), n, c in zip(rows, sizes, want))


def test_small_tiles_give_the_same(make, monkeypatch):
    """Large groups take the stars and the chunk tiles."""
    monkeypatch.setattr(ngram_join, "TILE_CLASSES", 4)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, edited(rng, base, rng.randrange(0, 4))) for i in range(60)] + [(100 + i, f"alone {i} and apart from the others") for i in range(5)]
    found = {r.doc_id: r.component_id for r in ngram_jaccard_components(make(rows, "doc_id long, text string"), 3, Fraction(9, 10)).collect()}
    assert [found[d] for d, _ in rows] == brute(rows, 3, Fraction(9, 10))[0]


def test_empty_table_and_other_columns(make):
    frame = make([], "doc_id long, text string, k long, n string, component_id int")
    assert ngram_jaccard_components(frame).count() == 0
    frame = make([(1, "a b c", 7, "z", 9)], "doc_id long, text string, k long, n string, component_id int")
    row = ngram_jaccard_components(frame).collect()[0]
    assert (row.doc_id, row.n_shingles, row.component_id) == (1, 1, 1)
    assert drop_near_duplicates(frame).columns == frame.columns


def test_search_is_exact_overlap():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 80, dtype=np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        at = rng.choice(80, rng.integers(0, 12), replace=False)
        own[at] = rng.integers(0, 2**63, len(at), dtype=np.uint64)
        sets.append(np.unique(own[: rng.integers(60, 81)]))
    for threshold in (Fraction(9, 10), Fraction(4, 5), Fraction(1, 2), Fraction(1)):
        index = TileIndex(sets, threshold)
        for i, query in enumerate(sets):
            want = [j for j, s in enumerate(sets) if j != i and (c := len(np.intersect1d(query, s))) >= threshold * (len(query) + len(s) - c)]
            assert sorted(index.search(query, np.arange(len(sets)) != i).tolist()) == want


def test_links_of_a_tile_form_a_forest():
    sets = [np.arange(20, dtype=np.uint64)] * 6
    links = link_tile([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 5], [2] * 6, sets, Fraction(9, 10))
    assert len(links) == 4


def test_components_of_a_path_and_a_hub(make):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    labels = {r.u: r.v for r in connected_components(make(edges, "u long, v long")).collect()}
    assert labels == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 60)}
    assert connected_components(make([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(make):
    rows = corpus(5)
    schema = "doc_id long, text string, source string"
    frame = make([(d, t, "s") for d, t in rows] + [(6, "twice told tale", "s")], schema)
    kept = [(r.doc_id, r.text) for r in drop_near_duplicates(frame, 5, Fraction(4, 5)).collect()]
    want, _ = brute(rows, 5, Fraction(4, 5))
    with_words = [(d, t) for d, t in kept if (t or "").split()]
    sets = [shingles(t, 5) for _, t in with_words]
    for i in range(len(sets)):  # nothing kept is linked with anything else kept
        for j in range(i):
            both = len(sets[i] & sets[j])
            assert both < Fraction(4, 5) * (len(sets[i]) + len(sets[j]) - both)
    groups = {c for (d, t), c in zip(rows, want) if (t or "").split() and c is not None}
    assert {d for d, _ in with_words if d is not None} == groups
    assert sum(not (t or "").split() for _, t in kept) == 3
