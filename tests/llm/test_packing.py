"""Packing: every token in one piece, sequences without gaps, full windows."""

import random
import zlib
from collections import defaultdict

import numpy as np

from starloom.llm import packing
from starloom.llm.packing import Packer, pack_documents

from .hard_texts import HARD_TEXTS


def letters():
    """Maker of a tokenizer with one id per code point, passed to the workers by value."""

    def make():
        return lambda texts: [np.array([ord(c) for c in t], np.uint32) for t in texts]

    return make


def check_windows(packer, lengths):
    pieces, steps = defaultdict(list), defaultdict(int)
    for number, tokens, windows in packer.done:
        steps[number] = tokens
        for window in windows:
            size = sum(p[0] for p in window)
            assert size <= packer.tiers[0] and size & (size - 1) == 0
            for length, document, start in window:
                pieces[document].append((start, length))
    for document, tokens in enumerate(lengths):
        at = 0
        for start, length in sorted(pieces[document]):
            assert start == at and length > 0
            at += length
        assert at == tokens
    return steps


def test_packer_fills_every_window():
    rng = random.Random(3)
    for lengths in ([], [1], [1024], [1025], [5] * 7, [700, 300, 40], [rng.randrange(1, 5000) for _ in range(900)], [rng.randrange(1, 90) for _ in range(900)], [600] * 50):
        packer = Packer()
        for document, tokens in enumerate(lengths):
            packer.add(document, tokens)
            if document % 100 == 99:
                packer.pack()
        packer.close()
        steps = check_windows(packer, lengths)
        assert sum(steps.values()) == sum(lengths)
        assert sum(t != packing.STEP_TOKENS for t in steps.values()) <= 1  # step groups are balanced
        assert not packer.pool and not packer.waiting


def test_whole_documents_are_preferred():
    packer = Packer((8, 4, 2))
    for document, tokens in enumerate([5, 3, 2, 6]):
        packer.add(document, tokens)
    packer.pack()
    packer.close()
    assert sorted(len(w) for _, _, windows in packer.done for w in windows) == [2, 2]


def test_pieces_of_documents(documents):
    rng = random.Random(4)
    texts = HARD_TEXTS[:5] + ["ab" * 3000] + ["x" * rng.randrange(3000) for _ in range(60)]
    frame = documents(texts).union(documents(["second with a used number"]))
    rows = pack_documents(frame, letters(), with_ids=True, buffer_tokens=3000).collect()
    by_sequence, tokens = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence[r.sequence_id].append(r)
        tokens[r.doc_id, r.doc_tokens].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.window == sum(p.length for p in pieces)
            at += r.length
    for i, text in [*enumerate(texts), (0, "second with a used number")]:
        own = sorted(tokens[i, len(text or "") + 1], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == np.array([*map(ord, text or ""), 0], "<u4").tobytes()


def test_no_rows(documents):
    assert pack_documents(documents([]), letters()).count() == 0
