"""Text statistics, rule learning and the conditional expression."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import quality

from .hard_texts import HARD_TEXTS


def brute(text):
    text = text or ""
    words = [w for w in "".join(c if c not in quality.SPACES else " " for c in text).split(" ") if w]
    lines = [line for line in text.split("\n") if any(c not in quality.SPACES for c in line)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), sum(line in lines[:i] for i, line in enumerate(lines)), len(inside)


def texts():
    rng = random.Random(9)
    out = [HARD_TEXTS[i] for i in (0, 1, 2, 3, 4, 6, 7)]
    for _ in range(120):
        out.append("".join(rng.choice(["a", "b", "Ç", " ", "\n", "\t", "#", "$ ", "one two three four five six ", "x y z\n", " ", "\x1f", " "]) for _ in range(rng.randrange(60))))
    return out


def test_statistics(documents):
    rows = documents(texts()).select("doc_id", quality.text_statistics(F.col("text")).alias("s")).collect()
    for r in rows:
        assert tuple(r.s)[:5] == brute(texts()[r.doc_id])


def test_long_text_is_read_whole():
    text = "same five words over again " * 20_000 + "and a new end"
    s = dict(zip(quality.STATISTICS, quality.statistics_of(text, quality.WordHashes())))
    assert s["n_words"] == 100_004 and s["n_repeat_words"] == 100_000


def learned(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    return x, ((x["a"] > 0.8) & (x["b"] <= 0.5)) | (x["c"] > 0.95)


def test_rules_find_planted_conjunctions():
    x, bad = learned()
    rules = quality.learn_rules(x, bad)
    caught = np.zeros(len(bad), bool)
    for rule in rules:
        caught |= rule.covers(x)
    assert (caught & ~bad).sum() <= 0.01 * (~bad).sum() and (caught & bad).sum() >= 0.95 * bad.sum()
    fresh, truth = learned(seed=2)
    held_out = np.logical_or.reduce([r.covers(fresh) for r in rules])
    assert (held_out == truth).mean() > 0.98


def test_no_rules_without_both_kinds():
    x, _ = learned(200)
    assert quality.learn_rules(x, np.zeros(200, bool)) == [] and quality.learn_rules(x, np.ones(200, bool)) == []
    assert quality.learn_rules({"a": np.ones(50)}, np.arange(50) % 2 == 0) == []
    noise = np.random.default_rng(3).random(200) < 0.5
    assert all(r.bad >= 0.98 * (r.bad + r.good) for r in quality.learn_rules(x, noise))


@pytest.fixture(scope="module")
def labelled(make):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(240):
        words = [word() for _ in range(60)]
        if i % 4 == 0:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), i % 4 and 1 or 0))
    frame = make([(i, t, "src", True) for i, t, _ in rows], "doc_id long, text string, source string, kept boolean")
    return frame, make([(i, q, 0) for i, _, q in rows if i < 160] + [(None, 0, 0), (5, None, 0), (900, 0, 0)], "doc_id long, quality int, toxic int")


def test_documents_are_judged(labelled, documents):
    frame, labels = labelled
    rules = quality.fit_decision_list(frame, labels)
    assert rules
    judged = quality.apply_quality_rules(frame, rules).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in judged)
    good = quality.keep_good(frame, rules)
    assert good.columns == frame.columns and good.count() == 180
    hard = {r.doc_id: r.kept for r in quality.apply_quality_rules(documents(HARD_TEXTS), rules).collect()}
    assert hard == {i: False for i in range(len(HARD_TEXTS))}  # too short, or one word over and over
    again = quality.fit_decision_list(frame.repartition(5), labels.repartition(2))
    assert again == rules


def test_empty_tables(documents, labelled, make):
    none = make([], "doc_id long, quality int, toxic int")
    assert quality.fit_decision_list(labelled[0], none) == []
    assert quality.apply_quality_rules(documents([]), []).count() == 0
    assert quality.apply_quality_rules(documents(["ten words " * 5 + "one two three four five six seven"]), []).collect()[0].kept is False


def test_every_midpoint_is_tested():
    x = {"a": np.random.default_rng(5).permutation(np.repeat(np.arange(1500) / 1500, 8))}
    bad = (x["a"] > 0.5042) & (x["a"] <= 0.5082)  # six values, between two of 48 even picks
    rules = quality.learn_rules(x, bad, most_conditions=2)  # its two ends: none to spare for coarse picks
    caught = np.logical_or.reduce([r.covers(x) for r in rules]) if rules else np.zeros(len(bad), bool)
    assert bad.sum() == 48 and (caught == bad).all()
