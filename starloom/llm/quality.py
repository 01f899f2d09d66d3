"""Quality rules: text statistics, a decision list learned by sequential covering, and its Spark conditional expression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starloom.llm.tables import give_back_memory, packed_rows
from starloom.llm.words import WordHashes, windows
from starloom.session import durable

SPACES = " \t\n\r\x0b\x0c"  # fixed: everything else is part of a word
SYMBOLS = "#*$%&|<>"  # fixed
REPEAT_WIDTH = 5
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_distinct_words"]


def repeat_words(hashes: np.ndarray) -> int:
    """Words that lie in a ``REPEAT_WIDTH``-word window which the text has twice or more, the first time included."""
    n = len(hashes)
    if n <= REPEAT_WIDTH:
        return 0
    grams = windows(hashes, REPEAT_WIDTH)
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    repeated = np.zeros(len(grams), bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(repeated), 1)
    np.add.at(edges, np.flatnonzero(repeated) + REPEAT_WIDTH, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def statistics_of(text: str | None, cache: WordHashes) -> tuple[int, ...]:
    """The numbers of ``STATISTICS`` for one text; a null text has none of anything."""
    if not text:
        return (0,) * len(STATISTICS)
    words = text.encode("utf-8").split()  # bytes split at exactly the six ASCII spaces
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    upper = sum(map(bytes.isupper, words))
    hashes = cache.of(words)
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(hashes),
        upper, len(set(words)),
    )


def _statistics(texts: pa.Array) -> pa.Array:
    found = [statistics_of(t, _statistics_cache) for at in range(0, len(texts), 500) for t in texts.slice(at, 500).to_pylist()]
    rows = np.array(found, np.int64).reshape(-1, len(STATISTICS))
    give_back_memory()
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(STATISTICS))], STATISTICS)


_statistics_cache = WordHashes()  # one per worker process


def text_statistics(text: Column) -> Column:
    """Struct of ``STATISTICS`` of a whole text. One pass in Python, in Arrow batches; other columns stay in the JVM."""
    kind = T.StructType([T.StructField(name, T.LongType()) for name in STATISTICS])
    return F.arrow_udf(_statistics, kind)(text)


def features(s: Column) -> dict[str, Column]:
    """Ratios the rules may test, from a struct of statistics; 0 for texts without words."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    return {
        "n_words": s["n_words"].cast("double"),
        "chars_per_word": s["word_chars"] / words,
        "symbols_per_word": s["n_symbols"] / words,
        "dup_lines_per_word": s["n_dup_lines"] / words,
        "repeat_share": s["n_repeat_words"] / words,
        "upper_share": s["n_upper_words"] / words,
        "distinct_share": s["n_distinct_words"] / words,
    }


def base_failed(s: Column) -> Column:
    """Fewer than 10 words, or more than a fifth of the words in repeated windows."""
    return (s["n_words"] < 10) | (F.lit(100) * s["n_repeat_words"] > F.lit(20) * s["n_words"])


@dataclass(frozen=True)
class Rule:
    """A conjunction of thresholds (feature, ``>`` or ``<=``, value) that marks bad texts, with its held-out counts."""

    conditions: tuple[tuple[str, str, float], ...]
    bad: int
    good: int

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        hit = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, value in self.conditions:
            hit &= x[name] > value if sign == ">" else x[name] <= value
        return hit

    def expression(self, columns: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, sign, value in self.conditions:
            out = out & (columns[name] > value if sign == ">" else columns[name] <= value)
        return out


def _cuts(values: np.ndarray) -> np.ndarray:
    """All midpoints between neighbouring values."""
    v = np.unique(values)
    return (v[1:] + v[:-1]) / 2


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most_conditions: int) -> tuple:
    """Add the condition with the largest information gain until no good text is covered or nothing helps."""
    conditions, inside = [], np.ones(len(bad), bool)
    while len(conditions) < most_conditions:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if p == 0 or n == 0:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v)
            v, cum_bad = v[order], np.concatenate([[0], np.cumsum(b[order])])
            cuts = _cuts(v)
            low = np.searchsorted(v, cuts, side="right")
            for sign, count, positive in (("<=", low, cum_bad[low]), (">", len(v) - low, p - cum_bad[low])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(positive > 0, positive * (np.log2(positive / count) - before), 0.0)
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (name, sign, float(cuts[gain.argmax()])))
        if best[1] is None:
            break
        conditions.append(best[1])
        name, sign, value = best[1]
        inside &= x[name] > value if sign == ">" else x[name] <= value
    return tuple(conditions)


def _prune(conditions: tuple, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule | None:
    """The leading part of the conjunction that does best on texts it was not grown on; of equals, the longer."""
    best, worth = None, -2.0
    for size in range(len(conditions), 0, -1):
        hit = Rule(conditions[:size], 0, 0).covers(x)
        p, n = int(bad[hit].sum()), int((~bad[hit]).sum())
        value = (p - n) / (p + n) if p + n else -2.0
        if value > worth:
            best, worth = Rule(conditions[:size], p, n), value
    return best


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.98, most_rules: int = 16, most_conditions: int = 4, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, take out what it covers, repeat.

    A rule is taken if it covers 2 bad held-out rows or more with a precision of ``least_precision``; otherwise the bad rows
    it was grown on are set aside. Ends when no bad row is left to grow on. Without bad or without good rows there are no
    rules. Rows must come in a fixed order.
    """
    rules: list[Rule] = []
    if not bad.any() or bad.all():
        return rules
    held = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    left, given_up = np.ones(len(bad), bool), np.zeros(len(bad), bool)
    part = lambda m: {k: v[m] for k, v in x.items()}
    for _ in range(2 * most_rules):
        growing = left & ~held & ~given_up
        if len(rules) == most_rules or not bad[growing].any():
            break
        grown = _grow(part(growing), bad[growing], most_conditions)
        if not grown:
            break
        rule = _prune(grown, part(left & held), bad[left & held])
        if rule is not None and rule.bad >= 2 and rule.bad >= least_precision * (rule.bad + rule.good):
            rules.append(rule)
            left &= ~rule.covers(x)
        else:  # look for other rules than this one
            given_up |= growing & bad & Rule(grown, 0, 0).covers(x)
    return rules


def labelled_sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, chosen by a hash of the id, one row per id (bad if any of its labels is)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_decision_list(documents: DataFrame, labels: DataFrame, sample_rows: int = 10_000, **options) -> list[Rule]:
    """Fit on at most ``sample_rows`` labelled documents (the one bound of this operator; it concerns the fit only).

    Their ids are broadcast (16 bytes a row) and their rows stored, so that no other text is counted. The statistics of those that the
    base rule keeps come to the driver, and the rules, which judge only such documents, are learned there.
    """
    wanted = F.broadcast(labelled_sample(labels, sample_rows))
    sample = durable(documents.select("doc_id", "text").join(wanted, "doc_id"))
    found = sample.withColumn("s", text_statistics(F.col("text"))).where(~base_failed(F.col("s")))
    numbers = found.select("doc_id", "quality", *[c.alias(k) for k, c in features(F.col("s")).items()]).orderBy("doc_id").limit(sample_rows)
    frame = numbers.toPandas()
    names = [c for c in frame.columns if c not in ("doc_id", "quality")]
    order = np.lexsort([frame[n].to_numpy() for n in names] + [frame["doc_id"].to_numpy()]) if len(frame) else []
    frame = frame.iloc[order]
    return learn_rules({n: frame[n].to_numpy() for n in names}, frame["quality"].to_numpy() == 0, **options)


def decision(rules: list[Rule], s: Column) -> Column:
    """Number of the first rule that fits, from 1, as one ordered conditional expression; null where none does."""
    columns = features(s)
    out = None
    for number, rule in enumerate(rules, 1):
        out = F.when(rule.expression(columns), number) if out is None else out.when(rule.expression(columns), number)
    return F.lit(None).cast("int") if out is None else out


def apply_quality_rules(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``quality_statistics`` (struct), ``base_failed``, ``quality_rule`` and ``kept`` to every row of ``documents``.

    A null or empty text has no words and fails the base rule. Repeated rows are judged alike; columns of these names
    are replaced. No row is dropped here.
    """
    documents = documents.drop("quality_statistics", "base_failed", "quality_rule", "kept")
    s = F.col("quality_statistics")
    judged = documents.withColumn("quality_statistics", text_statistics(F.col("text"))).withColumn("base_failed", base_failed(s)).withColumn("quality_rule", decision(rules, s))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("quality_rule").isNull())


def keep_good(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``documents`` that pass the base rule and all ``rules``, with their columns as they are, whatever their names."""
    judged = apply_quality_rules(packed_rows(documents).select("row", F.col("row.text").alias("text")), rules)
    return judged.where("kept").select("row.*")
