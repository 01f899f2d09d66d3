"""Merge replay against the tiktoken library, and round trips."""

import hashlib
import random

import numpy as np
import pytest
import regex
import tiktoken

from starloom.llm.bpe import MergeReplay, as_the_library, encode_documents, read_ranks, replay_merges

from .hard_texts import HARD_TEXTS

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(5)
    letters = "aabbccdeing  \n\t'sßéñ漢字123!?#²\x1c\u0085\u3000😀"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(400)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300)) for _ in range(100)]
    return out + ["a" * 5000, "ab" * 3000, " " * 900, "don't we'll I'd '' 'sx", "".join(map(chr, range(1, 0x3000)))] + [t or "" for t in HARD_TEXTS]


def test_ids_are_the_librarys(library):
    coder = MergeReplay(read_ranks(PATH), public_tokenizers.PATTERN)
    for text, ids in zip(texts(), coder.encode(texts())):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_lower_rank_made_by_a_merge_comes_first():
    """A merge may make a pair of lower rank than its own; word by word that pair goes before the rest of the rank."""
    ranks = {bytes([c]): i for i, c in enumerate(b"abcd")} | {b"abc": 4, b"bc": 5, b"cb": 6, b"abcb": 7}
    pieces = [p for p, _ in sorted(ranks.items(), key=lambda x: x[1])]

    def one_by_one(word):
        parts = [bytes([c]) for c in word]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(6)
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(12))) for _ in range(600)]
    assert replay_merges(words, ranks, pieces) == [one_by_one(w) for w in words]


def test_documents(documents, library):
    rows = {r.doc_id: r for r in encode_documents(documents(HARD_TEXTS), PATH, public_tokenizers.PATTERN, with_ids=True).collect()}
    for i, text in enumerate(HARD_TEXTS):
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        assert rows[i].ids == ids and rows[i].n_tokens == len(ids) // 4
        assert rows[i].ids_sha256 == hashlib.sha256(ids).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert encode_documents(documents([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_classes_are_the_librarys(library):
    """Code points that the pattern's own engine classes otherwise, and some of all others, before a contraction, a digit and a space."""
    own = regex.compile(r"\p{L}|\p{N}")
    theirs = regex.compile(as_the_library(r"\p{L}|\p{N}"))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    differ = set(own.findall(text)) ^ set(theirs.findall(text))
    coder = MergeReplay(read_ranks(PATH), public_tokenizers.PATTERN)
    asked = sorted(differ) + [chr(c) for c in points[::97]] + [chr(c) for c in points[:0x250]]
    for low in range(0, len(asked), 500):
        line = "".join(f"{c}'s{c}1{c} {c}" for c in asked[low : low + 500])
        assert np.frombuffer(coder.encode([line])[0], "<u4").tolist() == library.encode_ordinary(line)
