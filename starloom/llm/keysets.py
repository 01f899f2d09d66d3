"""Counts of hashes in packed blocks, and sets of hashes as bitmaps of bounded size.

A block holds four bytes of each hash and one or more for its count, so that hundreds of millions of them are shuffled in few rows and few bytes.
Hashes that agree in their key add up: a count is never too low, and what is dropped for a low count is dropped rightly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.tables import tidy
from starloom.llm.words import mix

MERGED_KEYS = 4_000_000  # keys of a bucket that are held before equal ones are added up
BLOCKS = "bucket long, block binary"


class Members:
    """A set of keys, with false positives: a bitmap in 64-bit words. Without one, every key is a member."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits

    def has(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(keys), bool)
        slot = mix(keys) & np.uint64(len(self.bits) * 64 - 1)
        return (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def key_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """What a hash is counted by: the bucket it falls into, and 32 of its bits."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))


def packed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row (bucket, block) per bucket: its number of keys, 32 bits of each, sorted, and the counts, in one byte where they fit."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    bucket = keys >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, np.int64)
    blocks = []
    for low, high in zip(edges, np.append(edges[1:], len(keys))):
        n = counts[low:high]
        many = np.flatnonzero(n > 255)
        parts = [np.array([high - low, len(many)], "<u4"), (keys[low:high] & np.uint64(0xFFFFFFFF)).astype("<u4"), np.where(n > 255, 0, n).astype("u1"), many.astype("<u4"), n[many].astype("<u8")]
        blocks.append(b"".join(p.tobytes() for p in parts))
    return pa.RecordBatch.from_arrays([pa.array(bucket[edges].astype(np.int64), pa.int64()), pa.array(blocks, pa.binary())], ["bucket", "block"])


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, many = np.frombuffer(block, "<u4", 2)
    at = 8 + 4 * int(size)
    low, n = np.frombuffer(block, "<u4", size, 8), np.frombuffer(block, "u1", size, at).astype(np.int64)
    at += int(size)
    n[np.frombuffer(block, "<u4", many, at)] = np.frombuffer(block, "<u8", many, at + 4 * int(many)).astype(np.int64)
    return low, n


def frequent_keys(blocks: DataFrame, threshold: int, log_bits: int) -> Members:
    """The keys with ``threshold`` occurrences or more in ``blocks`` (bucket, block). They are summed by bucket; at most 2 ** log_bits bits reach the driver."""
    words = 1 << (log_bits - 6)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current, size = None, 0
        bits = np.zeros(words, np.uint64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            low = np.concatenate([h[0] for h in held])
            order = np.argsort(low, kind="stable")  # the blocks are sorted runs
            low, n = low[order], np.concatenate([h[1] for h in held])[order]
            edges = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            return low[edges], np.add.reduceat(n, edges)

        def finish() -> None:
            if held:
                low, n = merged()
                slot = mix(np.uint64(current) << np.uint64(32) | low[n >= threshold].astype(np.uint64)) & np.uint64(words * 64 - 1)
                np.bitwise_or.at(bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
                held.clear()

        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                if bucket != current:
                    finish()
                    current, size = bucket, 0
                held.append(unpacked(block))
                size += len(held[-1][0])
                if size >= MERGED_KEYS:
                    held[:] = [merged()]
                    size = 0
        finish()
        some = np.flatnonzero(bits)
        for a in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[a : a + 100_000], pa.int64()), pa.array(bits[some[a : a + 100_000]].view(np.int64), pa.int64())], ["slot", "bits"])

    dealt = blocks.repartition("bucket").sortWithinPartitions("bucket")
    rows = dealt.mapInArrow(tidy(add_up), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(words, np.uint64)
    bits[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Members(bits)
