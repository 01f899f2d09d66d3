"""Spelling variants: pairs of vocabulary words one edit apart, by composing acceptor, one-edit transducer and acceptor.

A path of the composition reads two words at once: equal letters up to the edit, one edit, equal letters behind it. Up to the edit both
sides are in one state of the acceptor, the one their common prefix leads to. So the paths are dealt by that initial state:

* States that many words pass are open: the vocabulary is not held for them in one place. Their edit arcs are taken as an equi-join:
  the two sides agree on the prefix and on what follows the edit, and a group has at most one word per letter.
* All words below the first state that is not open make a partition, and one task holds its minimised acceptor.
  There the composition is run state by state; what lies behind an edit is the intersection of the languages of two states,
  remembered for every pair of states, and taken whole where minimising has made them one state.

An insertion is taken at the last place of the run of equal letters it belongs to, so each pair has one path.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.session import durable

LEAST_LENGTH = 7
LEAST_COUNT = 2
FORM_RATIO = 10  # how much more frequent a form is than its variant
PARTITION_WORDS = 20_000  # words below a state that is not open
DEPTH_STEP = 6  # prefix lengths whose words are counted in one job
TASK_WORDS = 400_000  # words whose counts a task holds before it hands them on
TASK_CHARS = 8_000_000  # or their characters
BROADCAST_ROWS = 500_000  # open states of up to a hundred bytes or so


def word_counts(documents: DataFrame, least_length: int = LEAST_LENGTH, typo_every: int | None = 31) -> DataFrame:
    """word, n: the runs of letters of at least ``least_length`` code points in all texts, A-Z lower-cased, and their occurrences.

    ``typo_every``: a run whose checksum with the doc_id this number divides loses the code point at checksum modulo length.
    """
    run_of_letters = re.compile(rf"[A-Za-zÀ-ÿ]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        chars = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            words, counts = list(total), list(total.values())
            for at in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 20_000], pa.string()), pa.array(counts[at : at + 20_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text:
                        continue
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    for word, n in Counter(run_of_letters.findall(text.encode("utf-8").lower().decode("utf-8"))).items():
                        if typo_every:
                            checksum = zlib.crc32(word.encode("utf-8"), seed)
                            if checksum % typo_every == 0:
                                place = checksum % len(word)
                                word = word[:place] + word[place + 1 :]
                                if len(word) < least_length:
                                    continue
                        before = total.get(word)
                        if before is None:
                            chars += len(word)
                            total[word] = n
                        else:
                            total[word] = before + n
                    if len(total) >= TASK_WORDS or chars >= TASK_CHARS:
                        yield from hand_on()
                        total, chars = {}, 0
        yield from hand_on()

    source = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Acceptor:
    """The minimised acceptor of sorted, distinct words.

    States with equal languages are one state. A state with a single word left is kept as that string, all others by whether
    they accept and by their arcs (letter, state, number of words before those of the arc). Children have smaller numbers than parents.
    """

    def __init__(self, words: list[str], skip: int = 0):
        self.accepts: list[bool] = []
        self.arcs: list[list[tuple[str, int, int]]] = []
        self.tail: list[str | None] = []
        self.sizes: list[int] = []  # words of the state's language
        self.known: dict = {}
        self.both: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.start = self._build(words, skip)

    def _state(self, key, accepts: bool, arcs: list, tail: str | None, size: int) -> int:
        state = self.known.get(key)
        if state is None:
            state = self.known[key] = len(self.accepts)
            self.accepts.append(accepts)
            self.arcs.append(arcs)
            self.tail.append(tail)
            self.sizes.append(size)
        return state

    def _build(self, words: list[str], skip: int) -> int:
        done: list[int] = []  # states of finished children
        todo: list[tuple] = [(0, len(words), skip, None)]
        while todo:
            low, high, depth, letters = todo.pop()
            if letters is not None:  # all children are done
                children = done[len(done) - len(letters) :]
                del done[len(done) - len(letters) :]
                accepts = len(words[low]) == depth
                arcs, offset = [], int(accepts)
                for letter, child in zip(letters, children):
                    arcs.append((letter, child, offset))
                    offset += self.sizes[child]
                done.append(self._state((accepts, *[(a, c) for a, c, _ in arcs]), accepts, arcs, None, offset))
            elif high - low == 1:
                tail = words[low][depth:]
                done.append(self._state(tail, not tail, [], tail, 1))
            else:
                first = low + (len(words[low]) == depth)
                bounds, letters = [], []
                for i in range(first, high):
                    if not letters or words[i][depth] != letters[-1]:
                        letters.append(words[i][depth])
                        bounds.append(i)
                bounds.append(high)
                todo.append((low, high, depth, letters))
                todo.extend((a, b, depth + 1, None) for a, b in zip(bounds[-2::-1], bounds[:0:-1]))
        return done[0]

    def place(self, state: int, word: str) -> int | None:
        """Number of ``word`` in the language of ``state``, or None."""
        place, at = 0, 0
        while self.tail[state] is None:
            if at == len(word):
                return place if self.accepts[state] else None
            for letter, child, offset in self.arcs[state]:
                if letter == word[at]:
                    place, state, at = place + offset, child, at + 1
                    break
            else:
                return None
        return place if word[at:] == self.tail[state] else None

    def shared(self, a: int, b: int) -> list[tuple[int, int]]:
        """Numbers in ``a`` and in ``b`` of every word that both states accept."""
        if a == b:
            return [(i, i) for i in range(self.sizes[a])]
        if a > b:
            return [(i, j) for j, i in self.shared(b, a)]
        memo, todo = self.both, [(a, b)]
        while todo:
            x, y = todo[-1]
            if (x, y) in memo:
                todo.pop()
                continue
            if self.tail[x] is not None or self.tail[y] is not None:
                if self.tail[x] is not None:
                    at = self.place(y, self.tail[x])
                    memo[x, y] = [] if at is None else [(0, at)]
                else:
                    at = self.place(x, self.tail[y])
                    memo[x, y] = [] if at is None else [(at, 0)]
                todo.pop()
                continue
            other = {letter: (child, offset) for letter, child, offset in self.arcs[y]}
            common = [(c, o, *other[letter]) for letter, c, o in self.arcs[x] if letter in other]
            missing = [(min(c, d), max(c, d)) for c, _, d, _ in common if c != d and (min(c, d), max(c, d)) not in memo]
            if missing:
                todo.extend(missing)
                continue
            found = [(0, 0)] if self.accepts[x] and self.accepts[y] else []
            for c, o, d, p in common:
                if c == d:
                    found.extend((o + i, p + i) for i in range(self.sizes[c]))
                elif c < d:
                    found.extend((o + i, p + j) for i, j in memo[c, d])
                else:
                    found.extend((o + j, p + i) for i, j in memo[d, c])
            memo[x, y] = found
            todo.pop()
        return memo[a, b]

    def edits(self, state: int) -> list[tuple[int, int]]:
        """Pairs of words of ``state``, which has arcs, whose edit comes at once: replaced letters, and inserted ones that the shorter word does not begin with."""
        pairs = []
        arcs = self.arcs[state]
        for k, (letter, child, offset) in enumerate(arcs):
            for _, second, after in arcs[k + 1 :]:
                pairs.extend((offset + i, after + j) for i, j in self.shared(child, second))
            if self.tail[child] is not None:
                rest = self.tail[child]
                if not rest.startswith(letter):
                    at = self.place(state, rest)
                    if at is not None:
                        pairs.append((at, offset))
                continue
            if self.accepts[state] and self.accepts[child]:
                pairs.append((0, offset))
            below = {a: (c, o) for a, c, o in self.arcs[child]}
            for other, x, at in arcs:
                if other != letter and other in below:
                    y, after = below[other]
                    pairs.extend((at + i, offset + after + j) for i, j in self.shared(x, y))
        return pairs

    def near_pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of word numbers one edit apart, each once, state by state from the start."""
        reached: list[list[np.ndarray]] = [[] for _ in self.accepts]
        reached[self.start].append(np.zeros(1, np.int64))
        for state in range(self.start, -1, -1):
            if not reached[state]:
                continue
            starts = np.concatenate(reached[state]) if len(reached[state]) > 1 else reached[state][0]
            reached[state] = []
            for _, child, offset in self.arcs[state]:
                if self.tail[child] is None:  # one word alone has no pair
                    reached[child].append(starts + offset if offset else starts)
            pairs = self.edits(state)
            if pairs:
                local = np.array(pairs, np.int64)
                size = max(1, 1_000_000 // len(local))
                for at in range(0, len(starts), size):
                    both = starts[at : at + size, None, None] + local
                    yield both[..., 0].ravel(), both[..., 1].ravel()


def near_of_partition(words: list[str], counts: list[int], skip: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted words: how many near words each has, and the number of the best of them (-1 for none)."""
    n = len(words)
    count = np.array(counts, np.int64)
    order = np.lexsort((np.arange(n), -count))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    near, best = np.zeros(n, np.int64), np.full(n, n, np.int64)
    if n > 1:
        for a, b in Acceptor(words, skip).near_pairs():
            near += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            np.minimum.at(best, a, rank[b])
            np.minimum.at(best, b, rank[a])
    return near, np.where(best < n, order[np.minimum(best, n - 1)], -1)


FOUND = "word string, n_near long, near_n long, near string"


def near_in_partitions(placed: DataFrame) -> DataFrame:
    """FOUND of the words of each partition; ``placed``: word, n, prefix (of the partition's state)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        counts: list[int] = []
        current = None

        def finish() -> Iterator[pa.RecordBatch]:
            near, best = near_of_partition(words, counts, len(current)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            some = np.flatnonzero(near).tolist()
            rows = [(words[i], int(near[i]), counts[best[i]], words[best[i]]) for i in some]
            words.clear()
            counts.clear()
            columns = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "near_n", "near"])

        for batch in batches:
            for word, n, prefix in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "prefix"))):
                if prefix != current:
                    yield from finish()
                    current = prefix
                words.append(word)
                counts.append(n)
        yield from finish()

    return placed.repartition("prefix").sortWithinPartitions("prefix", "word").mapInArrow(run, FOUND)


def near_at_open_states(words: DataFrame) -> DataFrame:
    """FOUND of the pairs whose edit arc leaves an open state; ``words``: word, n, depth (number of open states the word passes, from the start)."""
    at = F.col("at")
    around = words.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    behind = lambda skip: F.concat(F.substring("word", F.lit(1), at), F.lit("\0"), F.expr(f"substring(word, at + 1 + {skip})"))
    letter = F.expr("substring(word, at + 1, 1)")
    sides = F.array(
        F.struct(behind(0).alias("key"), F.lit("").alias("letter"), letter.alias("next")),
        F.when(F.length("word") > at, F.struct(behind(1).alias("key"), letter.alias("letter"), F.lit("").alias("next"))),
    )
    rows = around.select("word", "n", "at", F.explode(sides).alias("side")).where("side is not null").select("word", "n", "at", "side.*")
    member = F.struct((-F.col("n")).alias("order"), "word", "letter", "next")
    groups = rows.groupBy("at", "key").agg(F.sort_array(F.collect_list(member)).alias("m")).where("size(m) > 1")
    shorter = F.get(F.filter("m", lambda x: x["letter"] == ""), F.lit(0))["next"]  # null without a shorter word, empty where it ends here
    doubled = F.exists("m", lambda x: (x["letter"] != "") & (x["letter"] == shorter))  # the pair that has its path further on
    out = groups.select("m", F.size("m").alias("size"), doubled.alias("doubled"), shorter.alias("shorter"), F.posexplode("m").alias("i", "x"))
    other = F.col("m")[F.when(F.col("i") == 0, 1).otherwise(0)]
    elsewhere = F.coalesce("doubled", F.lit(False)) & ((F.col("x.letter") == "") | (F.col("x.letter") == F.col("shorter")))
    return out.select(
        F.col("x.word").alias("word"),
        (F.col("size") - 1 - elsewhere.cast("int")).cast("long").alias("n_near"),
        (-other["order"]).alias("near_n"),
        other["word"].alias("near"),
    )


def open_states(words: DataFrame, limit: int) -> DataFrame:
    """word, n, depth: the number of states on the word's path, from the start, that more than ``limit`` words pass."""
    placed, base = words.withColumn("depth", F.lit(0)), 0
    while True:
        going = placed.where((F.col("depth") == base) & (F.length("word") >= base))
        prefixes = going.select(F.explode(F.sequence(F.lit(base), F.least(F.length("word"), F.lit(base + DEPTH_STEP - 1)))).alias("d"), "word")
        counted = prefixes.groupBy("d", F.expr("substring(word, 1, d)").alias("open")).agg(F.count("*").alias("c")).where(F.col("c") > limit)
        found = durable(counted.select("d", "open"))  # at most DEPTH_STEP x words / limit rows
        size = found.count()
        if not size:
            return placed
        for d in range(base, base + DEPTH_STEP):  # the shorter prefixes of an open one are open, too
            level = found.where(F.col("d") == d).select("open")
            level = F.broadcast(level) if size <= BROADCAST_ROWS else level
            placed = placed.join(level, (F.col("depth") == d) & (F.length("word") >= d) & (F.expr(f"substring(word, 1, {d})") == F.col("open")), "left")
            placed = placed.select("word", "n", (F.col("depth") + F.col("open").isNotNull().cast("int")).alias("depth"))
        placed = durable(placed)
        base += DEPTH_STEP


def near_words(words: DataFrame, limit: int = PARTITION_WORDS) -> DataFrame:
    """word, n_near, near_n, near for each of ``words`` (word, n; distinct) with a word one edit apart; ``near`` has the largest n, then the smallest word."""
    placed = open_states(words, limit)
    below = placed.where(F.length("word") >= F.col("depth")).withColumn("prefix", F.expr("substring(word, 1, depth)"))
    found = near_in_partitions(below.select("word", "n", "prefix")).unionByName(near_at_open_states(placed.where("depth > 0")))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near")))
    rows = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return rows.select("word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near"))


def spelling_forms(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, typo_every: int | None = None, partition_words: int = PARTITION_WORDS) -> DataFrame:
    """Each word of ``documents`` (doc_id, text) with the more frequent spelling it stands for: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, of ``least_length`` code points or more and ``least_count``
    occurrences. Words one inserted, deleted or replaced code point apart are near; ``n_near`` counts them. ``form`` is the near word
    with the largest n (ties: the smallest), if that is ``ratio`` times the word's own; null otherwise. ``root`` follows forms to the last.

    A null or empty text has no words, an empty table gives an empty one, repeated rows count again, a null doc_id counts as an empty one in
    checksums (``typo_every``, see ``word_counts``). Texts of any length are read whole; a run of letters is one word however long
    it is, and the acceptor of its partition grows with the part of it that other words share. Other columns are ignored.

    No task holds more than ``partition_words`` words at once; the result does not depend on that number.
    """
    words = durable(word_counts(documents, least_length, typo_every).where(F.col("n") >= least_count))
    near = near_words(words, partition_words)
    known = words.join(near, "word", "left")
    form = F.col("near_n") >= ratio * F.col("n")
    named = durable(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(form, F.col("near")).alias("form"), F.when(form, F.col("near_n")).alias("form_n")))
    # each form is at least ``ratio`` times as frequent, so chains are short; every step doubles what is followed
    step = named.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = durable(step.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        step = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return named.join(step, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
