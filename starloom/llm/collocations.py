"""Phrase collocations by Toivonen's method: a sample proposes phrases, and full passes count these and their negative border.

The proposals S are the phrases that are frequent, at a lowered threshold, in a sample of the documents, found length by length. The first
full pass counts every phrase whose parts without the last and without the first word are both proposed: these are the phrases of S
and the negative border, those just outside S; a single word has no parts and is always counted. A frequent phrase that is
not counted so contains a frequent phrase of the border. If the border fails, the expansion therefore takes all phrases that contain one of
its frequent phrases and have no infrequent counted part; none is left beyond it, and the passes are closed.

Up to here phrases are counted by hashes, in blocks of four bytes a phrase and one or more for its count. Phrases that share a hash add up, so no
frequent one is lost. The second full pass counts, by their words, the phrases whose hash is frequent, together with
those of the expansion. So the counts are complete and exact whatever the sample and the hashes were.

Sets of hashes are known to the tasks as bitmaps of bounded size. What passes for a member by chance is counted without need.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.keysets import BLOCKS, Members, frequent_keys, key_of, packed
from starloom.llm.words import mix
from starloom.session import durable, one_row

LONGEST = 4  # words of a phrase
SAMPLE_PARTS = 8  # one document in so many is in the sample
LOWERED = 0.8  # of the threshold that the sample's share would make
BUFFER_WORDS = 500_000  # words a task counts at once
BUFFER_CHARS = 16_000_000  # or their characters
BUCKET_WORDS = 1_000_000  # words whose hashed phrases are summed in one place
MOST_BITS = 28  # a bitmap has at most 2 ** 28 bits, 32 MB
_BLANKS = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b in b" \t" else b for b in range(256))
COUNTED = "lang string, phrase string, k int, n long"


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh3_64_intdigest(lang.encode("utf-8")))


def longer_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase prolonged by a word, from the hashes of both."""
    return mix(mix(phrase) + word)


class Buffer:
    """The words of some texts as numbers, one after the other. Words are numbered by language, so a number stands for both; 0 is the end of a piece."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, dict[bytes, int]] = {}
        self.words: list[bytes] = [b""]
        self.langs: list[int] = [0]
        self.names: list[str] = []
        self.parts: list[np.ndarray] = []
        self.size = self.chars = 0

    def add(self, lang: str, text: str) -> None:
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = {b".": 0}  # no word is a full stop
            self.names.append(lang)
        found = text.encode("utf-8").lower().translate(_BLANKS).replace(b"\n", b" . ").split()
        for word in set(found).difference(numbers):
            numbers[word] = len(self.words)
            self.words.append(word)
            self.langs.append(len(self.names) - 1 if self.names[-1] == lang else self.names.index(lang))
        self.parts.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        self.parts.append(np.zeros(1, np.int32))  # no phrase goes from one text to the next
        self.size += len(found) + 1
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return self.size >= BUFFER_WORDS or self.chars >= BUFFER_CHARS

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words in order, and the hash of each number."""
        hashes = np.fromiter((word_hash(self.names[lang], w) for lang, w in zip(self.langs, self.words)), np.uint64, len(self.words))
        return np.concatenate(self.parts).astype(np.int64), hashes

    def border(self, least: int, longest: int, proposed: Members, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the phrases of ``least`` to ``longest`` words whose parts are all proposed."""
        ids, hashes = self._arrays()
        keys, counts = [], []
        number = np.bincount(ids, minlength=len(hashes))
        number[0] = 0
        if least <= 1:
            used = np.flatnonzero(number)
            keys.append(key_of(hashes[used], buckets))
            counts.append(number[used])
        # a phrase is held as the number of its distinct text, from 1, at the place of its first word; 0 where there is none
        at, h = ids, hashes
        for k in range(2, longest + 1):
            member = proposed.has(key_of(h, buckets))
            member[0] = False
            places = np.flatnonzero(member[at[:-1]] & member[at[1:]])
            places = places[ids[places + k - 1] > 0]
            if not len(places):
                break
            pairs, where, number = np.unique(at[places] * len(hashes) + ids[places + k - 1], return_inverse=True, return_counts=True)
            left, last = np.divmod(pairs, len(hashes))
            longer = longer_hash(h[left], hashes[last])
            if k >= least:
                keys.append(key_of(longer, buckets))
                counts.append(number)
            at = np.zeros(len(at) - 1, np.int64)
            at[places] = where + 1
            h = np.concatenate([np.zeros(1, np.uint64), longer])
        return np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])

    def phrases(self, longest: int, proposed: Members, frequent: Members, buckets: int) -> Iterator[pa.RecordBatch]:
        """COUNTED rows, by their words, of the phrases that may be frequent; as k = 0 the words of each language.

        These are the phrases counted with the border whose hash is frequent, and the expansion: phrases that were not counted, contain a
        frequent one that is not proposed, and have no counted part that is infrequent.
        """
        ids, hashes = self._arrays()
        langs, names = np.array(self.langs, np.int64), pa.array(self.names, pa.string())
        texts = pa.array([w.decode("utf-8") for w in self.words], pa.string())
        number = np.bincount(ids, minlength=len(hashes))
        number[0] = 0
        total = np.zeros(len(self.names), np.int64)
        np.add.at(total, langs, number)
        yield _rows(names, pa.array([""] * len(total), pa.string()), 0, total)
        keys = key_of(hashes, buckets)
        is_proposed, is_frequent = proposed.has(keys), frequent.has(keys)
        is_frequent[0] = False
        used = np.flatnonzero((number > 0) & is_frequent)
        yield from _in_batches(names.take(pa.array(langs[used])), texts.take(pa.array(used)), 1, number[used])
        word = hashes[ids]
        inside, hopeful = is_proposed[ids], is_frequent[ids]  # counted and proposed; no counted part is infrequent
        touched = hopeful & ~inside  # contains a frequent phrase that is not proposed
        phrase, pair, n_pairs = word, None, 0
        for k in range(2, longest + 1):
            counted, touched, hopeful = inside[:-1] & inside[1:], touched[:-1] | touched[1:], hopeful[:-1] & hopeful[1:]
            phrase = longer_hash(phrase[:-1], word[k - 1 :])
            keys = key_of(phrase, buckets)
            hopeful = hopeful & np.where(counted, frequent.has(keys), touched)
            places = np.flatnonzero(hopeful)
            if k == 2:  # pairs are numbered for the longer phrases, too
                distinct, where, number = np.unique(ids[places] * len(hashes) + ids[places + 1], return_inverse=True, return_counts=True)
                pair, n_pairs = np.zeros(len(ids), np.int64), len(distinct)
                pair[places] = where
                parts = np.divmod(distinct, len(hashes))
            elif k == 3:
                joined, number = np.unique(pair[places] * len(hashes) + ids[places + 2], return_counts=True)
                first, last = np.divmod(joined, len(hashes))
                parts = (*np.divmod(distinct[first], len(hashes)), last)
            else:  # the first and the last pair, and the words between them
                middle = [ids[places + i] for i in range(2, k - 2)]
                rows = np.stack([pair[places] * n_pairs + pair[places + k - 2], *middle], axis=1)
                rows, number = np.unique(rows, axis=0, return_counts=True) if middle else (lambda u: (u[0][:, None], u[1]))(np.unique(rows[:, 0], return_counts=True))
                first, last = np.divmod(rows[:, 0], max(n_pairs, 1))
                parts = (*np.divmod(distinct[first], len(hashes)), *[rows[:, 1 + i] for i in range(len(middle))], *np.divmod(distinct[last], len(hashes)))
            if len(number):
                text = pc.binary_join_element_wise(*[texts.take(pa.array(p)) for p in parts], " ")
                yield from _in_batches(names.take(pa.array(langs[parts[0]])), text, k, number)
            if k < longest:
                own = counted & proposed.has(keys)
                touched = touched | (counted & hopeful & ~own)
                inside = own


def _in_batches(lang: pa.Array, text: pa.Array, k: int, number: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(number), 50_000):
        yield _rows(lang.slice(a, 50_000), text.slice(a, 50_000), k, number[a : a + 50_000])


def _rows(lang: pa.Array, text: pa.Array, k: int, number: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, text, pa.array(np.full(len(number), k), pa.int32()), pa.array(number, pa.int64())], ["lang", "phrase", "k", "n"])


def buffered(batches: Iterator[pa.RecordBatch], finish: Callable[[Buffer], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``finish`` of each full buffer of the texts (lang, text) in ``batches``, and of the last."""
    buffer = Buffer()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                if text:
                    buffer.add(lang, text)
                    if buffer.full:
                        yield from finish(buffer)
                        buffer.clear()
    if buffer.size:
        yield from finish(buffer)


def frequent_hashes(texts: DataFrame, threshold: int, least: int, longest: int, proposed: Members, buckets: int, log_bits: int) -> Members:
    """The keys with ``threshold`` occurrences or more among the phrases of ``least`` to ``longest`` words whose parts are proposed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return buffered(batches, lambda buffer: iter([packed(*buffer.border(least, longest, proposed, buckets))]))

    return frequent_keys(texts.mapInArrow(run, BLOCKS), threshold, log_bits)


def frequent_phrases(documents: DataFrame, least: int = 30, longest: int = LONGEST, sample_parts: int = SAMPLE_PARTS) -> DataFrame:
    """lang, phrase, k, n: every phrase of up to ``longest`` words that occurs ``least`` times in a language, and the language's words in all (k = 0).

    The counts are exact. The sample (one document in ``sample_parts``, by a hash of its id and text) only bears on the work of the two passes.
    """
    texts = documents.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    sample = texts.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(sample_parts)) == 0).select("lang", "text")
    texts = texts.select("lang", "text")
    words = one_row(texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")))["chars"] // 6
    buckets = min(1 << 31, -(-words // BUCKET_WORDS) or 1)
    log_bits = min(MOST_BITS, max(min(16, MOST_BITS), (words // 2).bit_length()))
    lowered, proposed = max(1, int(LOWERED * least / sample_parts)), Members(None)
    for k in range(1, longest):
        found = frequent_hashes(sample, lowered, k, k, proposed, buckets, log_bits)
        proposed = found if k == 1 else Members(proposed.bits | found.bits)
    frequent = frequent_hashes(texts, least, 1, longest, proposed, buckets, log_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return buffered(batches, lambda buffer: buffer.phrases(longest, proposed, frequent, buckets))

    counted = texts.mapInArrow(run, COUNTED).groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n"))
    return counted.where((F.col("n") >= least) | (F.col("k") == 0))


def collocations(documents: DataFrame, least: int = 30, longest: int = LONGEST, first: int | None = 2000, sample_parts: int = SAMPLE_PARTS, within: tuple[int, int] = (80, 100)) -> DataFrame:
    """The best collocations of each language of ``documents`` (doc_id, text, lang): lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs. A phrase
    of 2 to ``longest`` words with ``a`` >= ``least`` occurrences within pieces is a candidate. Of its cuts into two parts with ``l`` and ``r``
    occurrences the one with the lowest score, floor(2000000 a / (l + r)), counts; ties go to the shorter first part. A candidate
    is dropped if a longer one that contains it has at least ``within`` (80 of 100) of its occurrences. ``n`` is the number of words of the
    language, ``rank`` the place by score, a (both descending) and phrase; ``first`` of them are returned, or all with None.

    A null text is empty, a null language ``und``; an empty table gives an empty one; repeated rows count again; texts and words of any
    length are read whole. Other columns are ignored.
    """
    counted = durable(frequent_phrases(documents, least, longest, sample_parts))
    phrases = counted.where("k > 0").select("lang", "phrase", "k", "n")
    totals = counted.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = phrases.where("k > 1").withColumnRenamed("n", "a")
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice(words, start, length), " ")

    longer = candidates.where("k > 2").select("lang", "k", "a", "phrase", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    longer = longer.select("lang", "a", "size", "phrase", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    inside = longer.select("lang", part(F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer_a"))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    covered = whole("longer_a") * within[1] >= whole("a") * within[0]
    left = candidates.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).select("lang", "phrase", "k", "a")

    cuts = left.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    parts = phrases.where(F.col("k") < longest)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    scored = cuts.withColumn("score", F.expr("cast(cast(a as decimal(20,0)) * 2000000BD div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    rows = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = rows.withColumn("rank", place.cast("long"))
    ranked = ranked if first is None else ranked.where(F.col("rank") <= first)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
