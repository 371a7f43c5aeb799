"""Words and word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np

SLICE_BITS = 7  # texts are taken in slices of up to 128
MIX = np.uint64(0x9E3779B97F4A7C15)


FACTOR = 0x9E3779B97F4A7C15 | 1
CHUNK, LONG_WORD = 1 << 20, 1 << 16
_EDGE = re.compile(rb"[ \t-\r]")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((FACTOR, pow(FACTOR, -1, 1 << 64))):
            p = np.full(max(n, 1 << 19), base, dtype=np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def _bounded(data: bytes) -> Iterator[bytes]:
    """data in pieces of about CHUNK bytes, cut between words; a word of more than LONG_WORD bytes is named by its
    digest, so that pieces stay bounded however long a text or word is."""
    at = 0
    while at < len(data):
        edge = _EDGE.search(data, at + CHUNK) if len(data) - at > CHUNK else None
        end = edge.start() if edge else len(data)
        piece = data[at:end]
        if len(piece) > LONG_WORD:
            words = piece.split()
            if max(map(len, words), default=0) > LONG_WORD:
                piece = b" ".join(w if len(w) <= LONG_WORD else b"\xff" + blake2b(w, digest_size=16).hexdigest().encode() for w in words)
        yield piece
        at = end


def _piece_hashes(encoded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([b"", *encoded, b""]), dtype=np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = _powers_to(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])
        h = mixed((sums[end - 1] - sums[start - 1]) * down[start])
    ends = np.cumsum([len(e) + 1 for e in encoded])
    return h, np.diff(np.append(0, np.searchsorted(start, ends)))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (lower case, split at ASCII white space), and the number of words of each text. A
    word's hash is its bytes' polynomial, from prefix sums over many bytes at once."""
    encoded = [t.lower().encode("utf-8", "replace") for t in texts]
    if max(map(len, encoded), default=0) <= LONG_WORD:
        return _piece_hashes(encoded)
    flat, lengths = [], []
    for e in encoded:
        parts = [_piece_hashes([p])[0] for p in _bounded(e)]
        flat += parts
        lengths.append(sum(map(len, parts)))
    return np.concatenate(flat), np.array(lengths, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str], k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of each text the distinct shingles of k words (fewer than k words make one
    shingle, no words none). Returns flat hashes (57 bits) sorted within a text, their numbers of occurrences, where texts end
    (as lengths), and a 128-bit digest of each word sequence."""
    if len(texts) > 1 << SLICE_BITS:
        raise ValueError("too many texts in a slice")
    flat, lengths = word_hashes(texts)
    ends = np.cumsum(lengths)
    digests = [blake2b(flat[e - n : e].tobytes(), digest_size=16).digest() for e, n in zip(ends, lengths, strict=True)]
    n = np.where(lengths == 0, 0, np.maximum(lengths - k + 1, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    start = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    own = np.repeat(np.minimum(lengths, k), n)
    h = np.zeros(len(doc), dtype=np.uint64)
    padded = np.append(flat, np.zeros(k, dtype=np.uint64))
    short = bool((own < k).any())
    with np.errstate(over="ignore"):
        for i in range(k):
            word = padded[start + i]
            h = h * MIX + (np.where(own > i, word, np.uint64(0)) if short else word)
            h ^= h >> np.uint64(29)
        h = mixed(h)
    # sorted within a text, by one key of text number and hash
    both = np.sort((doc.astype(np.uint64) << np.uint64(64 - SLICE_BITS)) | (h >> np.uint64(SLICE_BITS)))
    first = np.ones(len(both), dtype=bool)
    first[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(both)))
    both = both[at]
    return both & np.uint64((1 << (64 - SLICE_BITS)) - 1), times, np.bincount((both >> np.uint64(64 - SLICE_BITS)).astype(np.int64), minlength=len(texts)), digests
