"""Passages of test items against a scan of every window at every place."""

import random
import re

import pytest

from starloom.llm import decontamination

from .hard_texts import HARD_TEXTS

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(lower)]


def brute_force(text, items, width):
    words = words_of(text)
    hit, found = set(), set()
    for item_id, item in items:
        own = [w for w, _, _ in words_of(item)]
        size = min(width, len(own))
        for i in range(len(own) - size + 1 if own else 0):
            for j in range(len(words) - size + 1):
                if [w for w, _, _ in words[j : j + size]] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(item_id)
    runs, last = [], None
    for p in sorted(hit):
        if last is not None and p == last + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
        last = p
    spans = [(a, b, words[a][1], words[b][2]) for a, b in runs]
    return len(words), len(hit), spans, sorted(str(i) for i in found if i is not None)


def checked(frame, benchmark, texts, items, width, **options):
    rows = decontamination.contaminated_passages(frame, benchmark, width=width, **options).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_force(texts[r.doc_id], items, width)
        assert (r.n_words, r.n_hit, [tuple(s) for s in r.spans], list(r["items"]), r.contaminated) == (*want, want[1] > 0), texts[r.doc_id]


@pytest.mark.parametrize("block_chars", [2_000_000, 150])
@pytest.mark.parametrize("width", [1, 2, 3, 5, 10])
def test_random_passages(make, width, block_chars):
    rng = random.Random(width)
    vocabulary = ["a", "B", "c3", "é", "漢", "É", " ", "long"]
    line = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-", " {|} ", "\x7f"]) for _ in range(n))
    items = [(i % 25, line(rng.choice([0, 1, 2, 3, 4, 7, 12, 20, 30]))) for i in range(30)] + [(None, line(14)), (40, None), (41, "..."), (2, "a b")]
    full = [t for _, t in items if t]
    texts = [line(rng.choice([0, 1, 5, 30])) + rng.choice(full)[: rng.choice([5, 20, 60])] + line(20) if rng.random() < 0.7 else line(60) for _ in range(40)]
    texts += [t for _, t in items] + HARD_TEXTS[:5] + HARD_TEXTS[6:]
    frame = make([(i, t, 0, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, items string, spans int")
    benchmark = make([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    checked(frame, benchmark, texts, items, width, block_chars=block_chars)


def test_passage_in_a_long_text(documents, make):
    passage = " ".join(f"w{i}" for i in range(60))
    texts = ["Filler. " * 150_000 + "W0 " + passage.replace(" ", "  ,\n") + " filler" * 10, passage[4:], "é " * 40 + passage.upper()]
    items = [(7, passage), (10, passage + " more"), (9, "w58 w59 other")]
    rows = {r.doc_id: r for r in decontamination.contaminated_passages(documents(texts), make(items, "item_id long, text string"), width=10).collect()}
    assert [rows[i].n_hit for i in range(3)] == [60, 58, 60] and all(list(r["items"]) == ["10", "7"] for r in rows.values())
    span = rows[0].spans[0]
    assert texts[0][span.start : span.end].split()[0] == "w0" and texts[0][span.start : span.end].endswith("w59")
    assert texts[2][rows[2].spans[0].start : rows[2].spans[0].end] == passage.upper()


def test_empty_tables(documents, make):
    none = make([], "item_id long, text string")
    assert decontamination.contaminated_passages(documents([]), make([(1, "a")], "item_id long, text string")).count() == 0
    rows = decontamination.contaminated_passages(documents(HARD_TEXTS), none).collect()
    assert len(rows) == len(HARD_TEXTS) and not any(r.contaminated or r.spans or r["items"] for r in rows)


def test_repeated_rows(documents, make):
    frame = documents(["one two three"]).union(documents(["one two three"]))
    benchmark = make([(1, "two three"), (1, "two three"), (2, "Three")], "item_id long, text string")
    for block_chars in (100, 9):
        rows = decontamination.contaminated_passages(frame, benchmark, block_chars=block_chars).collect()
        assert [(r.n_hit, list(r["items"])) for r in rows] == [(2, ["1", "2"])] * 2
