"""The whole pipeline against a plain Python version, stage by stage."""

import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

import corpus_pipeline
from starloom.llm import quality

from .hard_texts import HARD_TEXTS
from .test_native import brute_spans
from .test_ngram_join import brute, edited

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []

    def add(text, quality=None):
        if quality is not None:
            labels.append((len(rows), quality, 0))
        rows.append((len(rows), text, "en", f"src{rng.randrange(3)}", None if text is None else len(text)))

    for i in range(120):
        words = [word() for _ in range(rng.randrange(30, 90))]
        add(" ".join(words), 1)
        if i % 3 == 0:
            add(" ".join(w + "###" for w in words), 0)
        if i % 4 == 0:
            for _ in range(3):
                add(edited(rng, words, rng.randrange(0, 3)))
        if i % 10 == 0:
            add(" ".join(word() for _ in range(40)) + " token=abcdef123 and AKIA" + "Q7" * 8 + " wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")
    for text in HARD_TEXTS:
        add(text)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, dict((d, q) for d, q, _ in labels)


def test_stages(spark, tables):
    folder, rows, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rules = quality.fit_decision_list(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    cache = quality.WordHashes()
    kept = []
    for row in rows:
        s = dict(zip(quality.STATISTICS, quality.statistics_of(row[1], cache)))
        n = max(s["n_words"], 1)
        x = {"n_words": s["n_words"], "chars_per_word": s["word_chars"] / n, "symbols_per_word": s["n_symbols"] / n, "dup_lines_per_word": s["n_dup_lines"] / n,
             "repeat_share": s["n_repeat_words"] / n, "upper_share": s["n_upper_words"] / n, "distinct_share": s["n_distinct_words"] / n}
        bad = s["n_words"] < 10 or 100 * s["n_repeat_words"] > 20 * s["n_words"]
        if not bad and not any(r.covers({k: np.array([v]) for k, v in x.items()})[0] for r in rules):
            kept.append(row)
    assert {d for d, q in labels.items() if q} <= {r[0] for r in kept} and not {d for d, q in labels.items() if not q} & {r[0] for r in kept}
    first = corpus_pipeline.keep_good(spark, docs, folder)
    assert sorted(map(tuple, first.collect())) == sorted(kept)

    components, _ = brute([(r[0], r[1]) for r in kept], 5, Fraction(4, 5))
    kept = [r for r, c in zip(kept, components) if r[0] == c]
    second = corpus_pipeline.keep_one_of_each_group(spark, first, folder)
    assert second.columns == docs.columns and sorted(map(tuple, second.collect())) == sorted(kept)

    texts = {}
    for row in kept:
        text, at = "", 0
        for kind, start, end in (s.split(":") for s in brute_spans(row[1])[1].split(",") if s):
            if int(start) >= at:
                text += row[1][at : int(start)] + f"[{kind.upper()}]"
            at = max(at, int(end))
        texts[row[0]] = text + row[1][at:]
    third = corpus_pipeline.redact(spark, second, folder)
    assert {r.doc_id: r.text for r in third.collect()} == texts and any("[KEY]" in t for t in texts.values())

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    result = corpus_pipeline.run(spark, folder).collect()
    for r in result:
        pieces[r.doc_id].append((r.start, r.ids))
    assert {d: b"".join(x for _, x in sorted(p)) for d, p in pieces.items()} == {
        d: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for d, t in texts.items()
    }


def test_stage_list():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["keep_good", "keep_one_of_each_group", "redact", "pack"]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
