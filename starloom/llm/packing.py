"""Hierarchical packing of documents into windows of several lengths."""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.tables import tidy

TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 16_384  # tokens of one step group: 16 windows of 1024, 32 of 512, and so on
BUFFER_TOKENS = 1_500_000  # a task packs so many tokens at a time; 4 bytes each
SEPARATOR = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window int, step_group long"


class Packer:
    """Packs the documents of one task, a bounded buffer at a time.

    A document's full windows of the longest tier are sequences of their own. What is left is routed to the shortest tier
    that holds it. Tiers are packed from the longest: a window takes one piece of its tier, then the largest pieces of
    its own and of shorter tiers that fit, and at last the part of a shorter piece that fills the gap to the token; the
    rest of that piece is routed again. Windows that cannot be filled wait for the next buffer. At the end all that is
    left is joined into full windows and one tail, which is cut at its binary digits. Every window but none is padded.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.step_tokens = step_tokens
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), sorted
        self.waiting: dict[int, list[list[tuple[int, int, int]]]] = {}  # full windows by length, until a step is full
        self.done: list[tuple[int, int, list[list[tuple[int, int, int]]]]] = []  # steps: (number, tokens, windows)
        self.steps = 0

    def add(self, document: int, tokens: int) -> None:
        longest = self.tiers[0]
        whole = tokens - tokens % longest
        for start in range(0, whole, longest):
            self._window([(longest, document, start)])
        if tokens > whole:
            insort(self.pool, (tokens - whole, document, whole))

    def _window(self, pieces: list[tuple[int, int, int]]) -> None:
        length = sum(p[0] for p in pieces)
        group = self.waiting.setdefault(length, [])
        group.append(pieces)
        if len(group) * length >= self.step_tokens:
            self._step(self.waiting.pop(length))

    def _step(self, windows: list[list[tuple[int, int, int]]]) -> None:
        self.done.append((self.steps, sum(p[0] for w in windows for p in w), windows))
        self.steps += 1

    def _take(self, most: int) -> tuple[int, int, int] | None:
        """The largest pooled piece of at most ``most`` tokens."""
        at = bisect_right(self.pool, (most, float("inf"), 0)) - 1
        return self.pool.pop(at) if at >= 0 else None

    def pack(self) -> None:
        """Pack the pool tier by tier; pieces whose windows cannot be filled stay."""
        for tier in self.tiers:
            below = max((t for t in self.tiers if t < tier), default=0)
            while (at := bisect_right(self.pool, (tier, float("inf"), 0))) and self.pool[at - 1][0] > below:
                if sum_below(self.pool, at - 1, tier) < tier:
                    break
                window = [self.pool.pop(at - 1)]
                gap = tier - window[0][0]
                while gap:
                    piece = self._take(gap)
                    if piece is None:
                        piece = self._cut(gap)
                    window.append(piece)
                    gap -= piece[0]
                self._window(window)

    def _cut(self, gap: int) -> tuple[int, int, int]:
        """The first ``gap`` tokens of the shortest pooled piece that is longer; its rest is routed again."""
        length, document, start = self.pool.pop(bisect_left(self.pool, (gap + 1, -1, 0)))
        insort(self.pool, (length - gap, document, start + gap))
        return gap, document, start

    def close(self) -> None:
        """Empty the pool and the waiting windows."""
        self.pack()
        rest, self.pool = self.pool[::-1], []
        total = sum(p[0] for p in rest)
        sizes = [self.tiers[0]] * (total // self.tiers[0])
        tail = total % self.tiers[0]
        sizes += [1 << b for b in range(tail.bit_length() - 1, -1, -1) if tail >> b & 1]
        for size in sizes:
            window = []
            while size:
                length, document, start = rest.pop()
                used = min(length, size)
                window.append((used, document, start))
                if length > used:
                    rest.append((length - used, document, start + used))
                size -= used
            self._window(window)
        group: list[list[tuple[int, int, int]]] = []
        for length in sorted(self.waiting, reverse=True):  # steps of mixed lengths, still of equal tokens
            for window in self.waiting.pop(length):
                group.append(window)
                if sum(p[0] for w in group for p in w) >= self.step_tokens:
                    self._step(group)
                    group = []
        if group:
            self._step(group)


def sum_below(pool: list[tuple[int, int, int]], skip: int, enough: int) -> int:
    """Tokens in the pool up to and including place ``skip``, counted no further than ``enough``."""
    total = 0
    for at in range(skip, -1, -1):
        total += pool[at][0]
        if total >= enough:
            break
    return total


def rank_file_tokenizer(path: str, pattern: str, special: dict[str, int], json_path: str | None = None) -> Callable[[list[str]], list[np.ndarray]]:
    """Encoder of texts by a rank file. Where a text holds a special token's string, the tokenizer of ``json_path`` decides."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    whole = None

    def encode(texts: list[str]) -> list[np.ndarray]:
        nonlocal whole
        out = []
        for text in texts:
            if json_path and any(s in text for s in special):
                if whole is None:
                    from tokenizers import Tokenizer

                    whole = Tokenizer.from_file(json_path)
                out.append(np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.array(encoding.encode_ordinary(text), np.uint32))
        return out

    return encode


def pack_documents(documents: DataFrame, encoder: Callable[[], Callable[[list[str]], list[np.ndarray]]], tiers: tuple[int, ...] = TIERS, with_ids: bool = False, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """Tokenize and pack ``documents`` (doc_id, text); one row per piece.

    ``encoder`` makes, once in each task, a function from texts to arrays of ids; each document gets ``SEPARATOR`` at its
    end. Columns: ``PIECES``, and with ``with_ids`` the piece's ids as little-endian 32-bit numbers. sequence_id and
    step_group are unique in the table; a step group holds ``STEP_TOKENS`` tokens, but for the last of each input
    partition. A null text is empty, so a document of one token; repeated rows and rows with a null doc_id are documents
    of their own. An empty table gives no rows. A task holds some ``buffer_tokens`` at a time. Nothing is shuffled: each task packs its own documents, so numbers and
    packing depend on how the input is split, and a repeated task gives the same rows.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        high = TaskContext.get().partitionId() << 32
        packer = Packer(tiers)
        held: dict[int, tuple[int | None, np.ndarray]] = {}  # documents of which pieces are still to come
        left: dict[int, int] = {}
        number = buffered = sequences = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequences
            rows: list[tuple] = []
            for step, _, windows in packer.done:
                for pieces in windows:
                    offset = 0
                    size = sum(p[0] for p in pieces)
                    for length, document, start in pieces:
                        doc_id, ids = held[document]
                        data = ids[start : start + length].tobytes()
                        row = (doc_id, start, length, zlib.crc32(data), len(ids), high | sequences, offset, size, high | step)
                        rows.append(row + ((data,) if with_ids else ()))
                        offset += length
                        left[document] -= length
                        if not left[document]:
                            del held[document], left[document]
                    sequences += 1
            packer.done.clear()
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()] + [pa.binary()] * with_ids
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [part.split()[0] for part in schema.split(", ")])

        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(doc_ids), 256):
                for doc_id, ids in zip(doc_ids[at : at + 256], encode([t or "" for t in texts.slice(at, 256).to_pylist()])):
                    ids = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
                    held[number], left[number] = (doc_id, ids), len(ids)
                    packer.add(number, len(ids))
                    number += 1
                    buffered += len(ids)
                if buffered >= buffer_tokens:
                    packer.pack()
                    yield from flush()
                    buffered = 0
        packer.close()
        yield from flush()

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)
