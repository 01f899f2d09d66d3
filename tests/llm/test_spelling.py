"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from starloom.llm import spelling

from .hard_texts import HARD_TEXTS


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def forms(rows, least_length, least_count, ratio, typo_every):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if typo_every and h % typo_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least_length and n >= least_count}
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def random_rows(seed, letters, longest, size):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(size)]
    weights = [1 / (i + 1) ** 1.5 for i in range(size)]
    return [(i if i % 9 else None, rng.choice([" ", "-", "1", "\n", "××" if "×" in letters else "_"]).join(rng.choices(vocabulary, weights, k=60))) for i in range(60)]


@pytest.mark.parametrize("partition_words", [1, 60, 100_000])
@pytest.mark.parametrize("letters, longest", [("ab", 7), ("abÀÿ", 6), ("×yZ", 6)])
def test_forms_by_brute_force(make, letters, longest, partition_words):
    rows = random_rows(partition_words, letters, longest, 400)
    frame = make([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, word string, n int, form string")
    got = spelling.spelling_forms(frame, least_length=3, least_count=2, ratio=3, typo_every=5, partition_words=partition_words).collect()
    assert len(got) == len({r.word for r in got})
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == forms(rows, 3, 2, 3, 5)


def test_pairs_of_the_composition_come_once():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(0, 8))) for _ in range(200)} | {"", "a" * 3000, "a" * 3001, "a" * 3000 + "b"})
    pairs = [p for a, b in spelling.Acceptor(words).near_pairs() for p in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len({tuple(sorted(p)) for p in pairs})
    assert {tuple(sorted(p)) for p in pairs} == {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])}


def test_acceptor_is_minimal():
    endings = ["ing", "ed", "er", "ers"]
    acceptor = spelling.Acceptor(sorted(stem + e for stem in ("walk", "talk", "jump") for e in endings))
    assert sum(len(a) == 2 and acceptor.sizes[s] == 4 for s, a in enumerate(acceptor.arcs)) == 1  # the endings are one state


def test_chains_lead_to_the_last_form(make):
    text = " ".join(["colourful"] * 400 + ["colorful"] * 40 + ["colorfl"] * 4 + ["clorfl"] * 2)
    rows = {r.word: r for r in spelling.spelling_forms(make([(1, text)], "doc_id long, text string")).collect()}
    assert rows["colorfl"].form == "colorful" and rows["colorfl"].root == "colourful" and rows["colourful"].root == "colourful"
    assert "clorfl" not in rows


def test_hard_texts_and_empty_tables(make, documents):
    long = "q" * 30_000
    texts = HARD_TEXTS + [long, long, "x" + long, long + "y"] * 2 + ["Ünicode ÜNICODE ünicode"]
    got = spelling.spelling_forms(documents(texts), partition_words=2).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == forms(list(enumerate(texts)), 7, 2, 10, None)
    assert spelling.spelling_forms(documents([]), partition_words=2).count() == 0
    assert spelling.spelling_forms(documents([None, "", "1 2 3"])).count() == 0
