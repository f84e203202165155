"""Greedy factors and refined buckets against plain versions."""

import random

import numpy as np
import pytest

from stagecraft.llm import substring, suffix


def longest(block, at, references):
    """Length of the longest match of block[at:] that starts anywhere in the references."""
    best = 0
    for other in references:
        for start in range(len(other)):
            n = 0
            while at + n < len(block) and start + n < len(other) and block[at + n] == other[start + n]:
                n += 1
            best = max(best, n)
    return best


def plain_factors(doc, blocks, length):
    out = []
    for i, block in enumerate(blocks):
        references = [b for d, b in zip(doc, blocks) if d < doc[i]]
        at = 0
        while at + length <= len(block):
            n = longest(block, at, references)
            if n >= length:
                out.append((i, at, at + n))
            at = at + n - length + 1 if n >= length else at + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_factors(seed):
    rng = random.Random(seed)
    passages = [[rng.randrange(3) for _ in range(rng.randrange(4, 14))] for _ in range(4)]
    blocks = [sum((rng.choice(passages) for _ in range(rng.randrange(1, 4))), []) + [rng.randrange(3)] for _ in range(24)]
    doc = np.sort([rng.randrange(9) for _ in blocks])
    bodies = [np.array(b, np.uint64).tobytes() for b in blocks]
    block, s, e, ref, first = substring.factors(doc, bodies, 5)
    assert list(zip(block.tolist(), s.tolist(), e.tolist())) == plain_factors(doc, blocks, 5)
    for b, x, y, r, f in zip(block, s, e, ref, first):  # the reference named holds the factor
        assert doc[r] < doc[b]
        assert blocks[b][x:y] == blocks[r][f:f + y - x]


def test_factors_of_nothing():
    assert [len(c) for c in substring.factors(np.zeros(0, np.int64), [], 5)] == [0] * 5
    short = [np.array([1, 2], np.uint64).tobytes()] * 3
    assert [len(c) for c in substring.factors(np.arange(3), short, 5)] == [0] * 5


def test_factors_cross_borders():
    """A window across two factors is found where a third document holds it."""
    a, b = list(range(10, 17)), list(range(20, 27))
    blocks = [a + [1], [2] + b, a[-3:] + b[:3], a + b]
    block, s, e, _, _ = substring.factors(np.arange(4), [np.array(x, np.uint64).tobytes() for x in blocks], 5)
    assert list(zip(block.tolist(), s.tolist(), e.tolist())) == [(3, 0, 7), (3, 4, 10), (3, 7, 14)]


@pytest.mark.parametrize("length,gram", [(4, 4), (7, 2), (9, 4), (16, 4), (21, 5)])
def test_refined(length, gram):
    rng = random.Random(length)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    texts += [texts[3], texts[4] + texts[5], b"a" * 50, b""]
    data = np.frombuffer(b"".join(texts), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    pointer = suffix.refined(data, off, length, gram)
    places: dict[bytes, set[int]] = {}
    for text, base in zip(texts, off):
        for k in range(len(text) - length + 1):
            places.setdefault(text[k:k + length], set()).add(int(base) + k)
    buckets: dict[int, set[int]] = {}
    for at in np.flatnonzero(pointer >= 0).tolist():
        buckets.setdefault(int(pointer[at]), set()).add(at)
    assert sorted(map(sorted, buckets.values())) == sorted(sorted(x) for x in places.values() if len(x) > 1)


def test_refined_of_nothing():
    none = np.zeros(0, np.uint8)
    assert len(suffix.refined(none, np.zeros(1, np.int64), 100, 32)) == 0
    assert suffix.refined(np.zeros(20, np.uint8), np.array([0, 20]), 100, 32).tolist() == [-1] * 20


def test_short_pieces_settle_as_long_ones(monkeypatch):
    """The lazy path of short pieces and the emitting path give the merges' own tokens."""
    import public_tokenizers
    from stagecraft.llm import bpe

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    lazy, eager = bpe.Transducer(ranks), bpe.Transducer(ranks)
    rng = random.Random(11)
    pieces = [bytes(rng.choice(b"abcdefghinorstu") for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    pieces += [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 30))) for _ in range(200)] + [b"a" * 900, "naïve 😀é".encode() * 9, b"   \n" * 50]
    got = [lazy.encode_piece(p) for p in pieces]
    monkeypatch.setattr(bpe, "LOOKAHEAD", 1)
    assert got == [eager.encode_piece(p) for p in pieces]
    assert got == [[ranks[x] for x in lazy.merged(p)] if p not in ranks else [ranks[p]] for p in pieces]
