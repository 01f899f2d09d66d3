"""Passages of test items in documents, found by one Aho-Corasick automaton in a single scan of each text.

Texts are normalised byte by byte: A-Z is lower-cased, every other ASCII byte that is neither letter nor digit becomes a space, and
runs of spaces become one. Each byte keeps its place in the original, so hits are reported in code points of the text as given.
A window of ``width`` item words contains a whole block of ``width // 2`` words that starts at a multiple of that number in its item.
These blocks are the patterns, which keeps the automaton as small as the items. Where one occurs, the words around it are
compared with the item's, and ``width`` equal words in a row are a hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.session import durable, one_row

BLOCK_CHARS = 2_000_000  # characters of items in one automaton; some 200 MB in a worker at most
_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_SPACES = bytes(b if b >= 128 or b in _KEPT else 32 for b in range(256))

SPAN = pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
SCAN = "doc_id long, text_hash long, n_words long, spans array<struct<first_word:long,last_word:long,start:long,end:long>>, items array<string>"


def blanked(text: str | None) -> bytes:
    """The text in lower case, everything between words blank; as many bytes as the text has in UTF-8."""
    return (text or "").encode("utf-8").lower().translate(_SPACES)


class ItemAutomaton:
    """The automaton over the blocks of item words, and what stands around each block."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        by_words: dict[tuple[bytes, ...], set[str]] = {}
        for item_id, text in items:
            words = tuple(blanked(text).split())
            if words:
                by_words.setdefault(words, set()).update(() if item_id is None else (item_id,))
        self.width = width
        self.words = list(by_words)
        self.ids = [frozenset(i) for i in by_words.values()]
        patterns: dict[bytes, list[tuple[int, int, int]]] = {}  # item, first word of the block, words of the block
        for item, words in enumerate(self.words):
            if len(words) < width:
                patterns.setdefault(b" ".join(words), []).append((item, 0, len(words)))
                continue
            size = max(1, width // 2)
            for at in range(0, len(words) - size + 1, size):
                patterns.setdefault(b" ".join(words[at : at + size]), []).append((item, at, size))
        self.automaton = ahocorasick.Automaton()
        for pattern, places in patterns.items():
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", places)
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]] | None:
        """Mask of the hit words and the ids of the items with a window among ``words``; None without any."""
        if self.empty or not words:
            return None
        line = f" {b' '.join(words).decode('latin-1')} "
        ends, hit, found = None, None, set()
        for last, places in self.automaton.iter(line):
            if ends is None:  # place of the space behind each word
                ends = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)[1:]
            stop = int(np.searchsorted(ends, last)) + 1
            for item, at, size in places:
                low, high = stop - size, stop
                own = self.words[item]
                if len(own) >= self.width:
                    around = self.width - size
                    i, j, least = low - 1, at - 1, low - around
                    while i >= 0 and j >= 0 and i >= least and words[i] == own[j]:
                        i, j = i - 1, j - 1
                    low = i + 1
                    i, j, most = high, at + size, high + around
                    while i < len(words) and j < len(own) and i < most and words[i] == own[j]:
                        i, j = i + 1, j + 1
                    high = i
                    if high - low < self.width:
                        continue
                if hit is None:
                    hit = np.zeros(len(words), bool)
                hit[low:high] = True
                found.add(item)
        return None if hit is None else (hit, set().union(*(self.ids[i] for i in found)))


def spans_of(blank: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words, with the code points of the original text from the first to behind the last."""
    raw = np.frombuffer(blank, np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    runs = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [
        {"first_word": int(a), "last_word": int(b) - 1, "start": int(before[starts[a]]), "end": int(before[ends[b - 1]])} for a, b in zip(runs[::2], runs[1::2])
    ]


_BUILT: dict[bytes, ItemAutomaton] = {}


def automaton_of(items: list[tuple[str | None, str | None]], width: int) -> ItemAutomaton:
    """The automaton, built once in a worker and kept until another one is asked for."""
    key = hashlib.sha256(repr((width, items)).encode("utf-8")).digest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemAutomaton(items, width)
    return _BUILT[key]


def scan_documents(documents: DataFrame, items: list[tuple[str | None, str | None]], width: int) -> DataFrame:
    """doc_id, text_hash, n_words, spans and items of each row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = automaton_of(items, width)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                counts, spans, ids = [], [], []
                for text in part.column("text").to_pylist():
                    blank = blanked(text)
                    words = blank.split()
                    found = automaton.scan(words)
                    counts.append(len(words))
                    spans.append(spans_of(blank, found[0]) if found else [])
                    ids.append(sorted(found[1]) if found else [])
                columns = [part.column("doc_id").cast(pa.int64()), part.column("text_hash"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "spans", "items"])

    source = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, SCAN)


def contaminated_passages(documents: DataFrame, benchmark: DataFrame, width: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_words, n_hit, spans, items, contaminated.

    A word of a document is hit when it lies in an occurrence of a window of ``benchmark`` (item_id, text): ``width`` consecutive
    words of an item, or the whole of a shorter one. ``spans`` are the runs of hit words, by word number and by code point of the text
    (end exclusive); ``items`` the distinct ids, as sorted strings, of the items with an occurring window.

    A null or empty text has no words, as a document and as an item; either table may be empty, and then nothing is hit. Repeated
    rows of documents are judged alike and all stay; repeated items count once. The words of an item with a null id are hit like
    others, but no id names it. Very long texts are scanned whole, in time linear in their length. Other columns are ignored.

    Items of up to ``block_chars`` characters make one automaton. More of them are dealt into blocks by a hash, the documents are
    scanned once per block, and the hits of a document are united; results do not depend on the number of blocks.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = one_row(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")))["chars"]
    blocks = -(-total // block_chars) or 1
    scans = []
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        scan = scan_documents(documents, [tuple(r) for r in mine.collect()], width)
        scans.append(scan if blocks == 1 else durable(scan.where("size(items) > 0 or size(spans) > 0" if block else "true")))
    words = F.transform("spans", lambda s: s["last_word"] - s["first_word"] + 1)
    if blocks == 1:
        found = scans[0].withColumn("n_hit", F.aggregate(words, F.lit(0).cast("long"), lambda a, n: a + n))
    else:
        found = united(scans)
    return found.select("doc_id", "n_words", "n_hit", "spans", "items", (F.col("n_hit") > 0).alias("contaminated"))


def united(scans: list[DataFrame]) -> DataFrame:
    """The scans of several blocks as one; the first has every document, the others those with hits."""
    hits = scans[0].where("size(spans) > 0")
    for scan in scans[1:]:
        hits = hits.unionByName(scan)
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    of_text = hits.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(flat("spans").alias("_spans"), F.array_sort(flat("items")).alias("_items"))
    # spans of different blocks may overlap: a span that begins inside or right behind the one before it prolongs it
    grow = lambda s, e: F.struct(s["first_word"].alias("first_word"), F.greatest(s["last_word"], e["last_word"]).alias("last_word"), s["start"].alias("start"), F.greatest(s["end"], e["end"]).alias("end"))
    joined = F.aggregate(
        F.slice(F.array_sort("_spans"), 2, F.greatest(F.size("_spans") - 1, F.lit(0))),
        F.slice(F.array_sort("_spans"), 1, 1),
        lambda done, e: F.when(
            F.element_at(done, -1)["last_word"] + 1 >= e["first_word"],
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grow(F.element_at(done, -1), e))),
        ).otherwise(F.concat(done, F.array(e))),
    )
    merged = of_text.withColumn("_spans", joined)
    n_hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda a, s: a + s["last_word"] - s["first_word"] + 1)
    rows = scans[0].join(merged.withColumn("_n", n_hit), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    nothing = lambda c: F.coalesce(f"_{c}", F.col(c))
    return rows.select("doc_id", "n_words", F.coalesce("_n", F.lit(0).cast("long")).alias("n_hit"), nothing("spans").alias("spans"), nothing("items").alias("items"))
