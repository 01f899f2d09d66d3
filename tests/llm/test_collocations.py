"""Collocations against counts of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from starloom.llm import collocations, keysets

from .hard_texts import HARD_TEXTS


def brute_force(rows, least, longest, first, share=(80, 100)):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                count.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    big = {p: a for p, a in count.items() if a >= least}
    out = []
    for (lang, p), a in big.items():
        if len(p) < 2:
            continue
        around = [b for (la, q), b in big.items() if la == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(b * share[1] >= a * share[0] for b in around):
            continue
        cuts = [(2000000 * a // (big[lang, p[:k]] + big[lang, p[k:]]), k, big[lang, p[:k]], big[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    found = set()
    for lang in {o[0] for o in out}:
        best = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        found.update((lang, i, *o[1:]) for i, o in enumerate(best[:first], 1))
    return found


def texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "hall", "é", "ñ", "x y", "w1", "w2", "w3"]
    idioms = ["new york city hall", "new york", "w1 w2 w3", "of the", "é ñ é ñ"]
    ends = [" ", " ", " ", "\t", ". ", ",", "\n", "  "]
    line = lambda: "".join((rng.choice(idioms) if rng.random() < 0.4 else rng.choice(vocabulary)) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
    return [(line(), rng.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.mark.parametrize("sample_parts", [1, 2, 5, 1_000_000])
@pytest.mark.parametrize("least, first", [(3, None), (8, 7), (30, 2000)])
def test_whatever_the_sample(make, sample_parts, least, first):
    rows = texts(least)
    frame = make([(i % 50, t, la, "x", 1) for i, (t, la) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, k int")
    got = collocations.collocations(frame, least=least, first=first, sample_parts=sample_parts).collect()
    assert {tuple(r) for r in got} == brute_force(rows, least, 4, first) and len(got) == len({tuple(r) for r in got})


def test_buffers_and_a_full_bitmap_change_nothing(make, monkeypatch):
    rows = texts(99)
    frame = make([(i, t, la) for i, (t, la) in enumerate(rows)], "doc_id long, text string, lang string", 2)
    want = brute_force(rows, 4, 4, None)
    monkeypatch.setattr(collocations, "MOST_BITS", 7)  # 128 slots: nearly everything passes for proposed
    monkeypatch.setattr(collocations, "BUFFER_WORDS", 50)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 40)
    assert {tuple(r) for r in collocations.collocations(frame, least=4, first=None, sample_parts=3).collect()} == want


def test_border_failures_are_counted_later(make):
    """The sample misses every phrase, so the border of the first pass are single words, and the rest is expansion."""
    rows = [("alpha beta gamma delta", "en")] * 40
    frame = make([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    found = {(r.phrase, r.n) for r in collocations.frequent_phrases(frame, least=30, sample_parts=10**9).where("k > 0").collect()}
    words = rows[0][0].split()
    assert found == {(" ".join(words[i : i + k]), 40) for k in range(1, 5) for i in range(5 - k)}


def test_hard_texts_and_empty_tables(make, documents):
    frame = documents(HARD_TEXTS + ["z" * 200_000 + " tail"] * 3)
    rows = [(t, "en") for t in HARD_TEXTS + ["z" * 200_000 + " tail"] * 3]
    got = collocations.collocations(frame, least=2, first=None).collect()
    assert {tuple(r) for r in got} == brute_force(rows, 2, 4, None)
    assert collocations.collocations(documents([])).count() == 0
    assert collocations.collocations(make([(None, None, None)], "doc_id long, text string, lang string")).count() == 0


def test_longer_phrases_and_packed_counts(make):
    rows = texts(5)
    frame = make([(i, t, la) for i, (t, la) in enumerate(rows)], "doc_id long, text string, lang string")
    for longest in (2, 3, 5, 6):
        assert {tuple(r) for r in collocations.collocations(frame, least=3, longest=longest, first=None, sample_parts=4).collect()} == brute_force(rows, 3, longest, None)
    rng = np.random.default_rng(1)
    keys, counts = rng.permutation(5000).astype(np.uint64) * np.uint64(0x9E3779B9) % np.uint64(7 << 32), rng.choice([1, 2, 255, 256, 10**12], 5000)
    blocks = keysets.packed(keys, counts).to_pylist()
    back = {(b["bucket"] << 32 | int(low)): int(n) for b in blocks for low, n in zip(*keysets.unpacked(b["block"]))}
    assert back == dict(zip(keys.tolist(), counts.tolist()))
