"""Byte-level BPE by merge replay over a vocabulary of words, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_REMEMBERED = 600_000  # words a worker remembers with their ids before it starts anew; some 130 MB

# Letters and digits of ASCII, Latin-1 and Latin Extended: texts of these only are split alike by ``re``, twice as fast.
_OTHER = re.compile(r"[^\x00-\x1b !-~À-ÖØ-öø-ɏ‐-‧]")
_PLAIN = (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"[^\s[^\W\d_]\d]", r"(?:[^\s\w]|_)")


@functools.cache
def library_class(name: str, example: str) -> str:
    """The code points that the tiktoken library takes for ``\\p{name}``, as the inside of a character class.

    Its Unicode tables may be older or newer than those of other libraries. Each code point is encoded behind an ``example`` of the class: the two
    are merged only where one match holds both.
    """
    first = example.encode()
    ranks = {bytes([x]): x for x in range(256)} | {first + bytes([x]): 256 + x for x in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=rf"\p{{{name}}}+|[\s\S]", mergeable_ranks=ranks, special_tokens={})
    ranges: list[list[int]] = []
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for low in range(0, len(points), 8192):
        part = points[low : low + 8192]
        tokens = probe.encode_ordinary("".join(f"{example}{chr(c)}\n" for c in part))
        ends = np.cumsum([2 if t >= 256 else 1 for t in tokens])
        merged = set((ends - 2)[np.array(tokens) >= 256].tolist())  # places in bytes
        at = 0
        for c in part:
            if at in merged:
                if ranges and ranges[-1][1] == c - 1:
                    ranges[-1][1] = c
                else:
                    ranges.append([c, c])
            at += 2 + (1 if c < 0x80 else 2 if c < 0x800 else 3 if c < 0x10000 else 4)
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges)


def as_the_library(pattern: str) -> str:
    """``pattern`` with letters and numbers as the library knows them."""
    for name, example in (("L", "a"), ("N", "1")):
        sign = rf"\p{{{name}}}"
        if sign in pattern:
            inside = library_class(name, example)
            parts, depth = [], 0
            for piece in regex.split(r"(\\p\{.\}|\\.|[\[\]])", pattern):
                depth += (piece == "[") - (piece == "]")
                parts.append(piece if piece != sign else inside if depth else f"[{inside}]")
            pattern = "".join(parts)
    return pattern


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def replay_merges(words: list[bytes], ranks: dict[bytes, int], pieces: list[bytes]) -> list[list[int]]:
    """Ids of each word: all merges are applied to all words at once, lowest rank first. ``pieces`` has each rank's bytes.

    The words lie one after the other as a linked list of symbols. An inverted index leads from the rank of a pair of
    neighbours to the places where it stands; a heap holds the ranks present. A merge touches its two neighbours only:
    their pairs enter the index anew, and entries that no longer hold are passed over. Places of one rank are merged from
    left to right. If a merge makes a pair of lower rank, that is taken before the rest of the current rank, as merging
    word by word would do.
    """
    symbols: list[bytes | None] = []
    after: list[int] = []
    before: list[int] = []
    starts: list[int] = []
    for word in words:
        base, size = len(symbols), len(word)
        starts.append(base if size else -1)
        if not size:
            continue
        symbols.extend(word[i : i + 1] for i in range(size))
        after.extend(range(base + 1, base + size))
        after.append(-1)
        before.append(-1)
        before.extend(range(base, base + size - 1))
    index: dict[int, list[int]] = {}
    rank_of = ranks.get
    for left, right in enumerate(after):
        if right >= 0:
            rank = rank_of(symbols[left] + symbols[right])
            if rank is not None:
                index.setdefault(rank, []).append(left)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        places = sorted(index.pop(rank, ()))
        piece = pieces[rank]
        lower = False
        for done, left in enumerate(places, 1):
            first = symbols[left]
            right = after[left]
            if first is None or right < 0 or first + symbols[right] != piece:
                continue
            symbols[left] = piece
            symbols[right] = None
            following = after[left] = after[right]
            previous = before[left]
            if following >= 0:
                before[following] = left
                new = rank_of(piece + symbols[following])
                if new is not None:
                    if new not in index:
                        index[new] = []
                        heapq.heappush(heap, new)
                    index[new].append(left)
                    lower = new < rank
            if previous >= 0:
                new = rank_of(symbols[previous] + piece)
                if new is not None:
                    if new not in index:
                        index[new] = []
                        heapq.heappush(heap, new)
                    index[new].append(previous)
                    lower = lower or new < rank
            if lower:  # the rest of this rank waits
                if done < len(places):
                    index[rank] = places[done:]
                    heapq.heappush(heap, rank)
                break
    out = []
    for at in starts:
        ids = []
        while at >= 0:
            ids.append(ranks[symbols[at]])
            at = after[at]
        out.append(ids)
    return out


class MergeReplay:
    """Encodes texts: split into words by ``pattern``, new words by ``replay_merges``, known words from memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(as_the_library(pattern)).findall
        plain = pattern
        for general, simple in _PLAIN:
            plain = plain.replace(general, simple)
        self.split_plain = re.compile(plain).findall if "\\p" not in plain else self.split
        self.known: dict[str, bytes] = {}
        self.table = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.table[rank] = piece

    def words(self, text: str) -> list[str]:
        return self.split(text) if _OTHER.search(text) else self.split_plain(text)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers. New words of all ``texts`` are replayed together."""
        split = [self.words(t) for t in texts]
        if len(self.known) > MOST_REMEMBERED:
            self.known.clear()
        new = list({w for words in split for w in words if w not in self.known})
        for word, ids in zip(new, replay_merges([w.encode("utf-8") for w in new], self.ranks, self.table)):
            self.known[word] = np.array(ids, "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def _worker_coder(ranks_path: str, pattern: str) -> MergeReplay:
    """One for all tasks of a worker process, so that words known from earlier tasks stay known."""
    return MergeReplay(read_ranks(ranks_path), pattern)


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole text of ``documents`` (doc_id, text).

    One row per row: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit numbers), decoded_sha256
    (of the bytes decoded from the ids); with ``with_ids`` also ids and decoded, both binary. A null text is empty, so no
    tokens; repeated rows give equal rows. The rank file is read by each task from a path that exists on every machine.
    Each task gathers the new words of a thousand texts at a time and replays the merges over all of them.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker_coder(ranks_path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                coded = coder.encode([t or "" for t in part.column("text").to_pylist()])
                decoded = [coder.decode(ids) for ids in coded]
                columns = [part.column("doc_id").cast(pa.int64()), pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(map(sha, coded), pa.string()), pa.array(map(sha, decoded), pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(coded, pa.binary()), pa.array(decoded, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
