"""Word boundaries, word hashes and word shingles of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

from placemill.llm.common import mix64

_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        p = np.full(max(n, 1 << 18), base, np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def word_spans(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (bytes between ASCII white space), and its text's number."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    solid = ~_SPACE[data]
    fresh = np.ones(len(data), bool)
    fresh[1:] = text[1:] != text[:-1]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | fresh))
    after, last = np.zeros(len(data), bool), np.ones(len(data), bool)
    after[:-1], last[:-1] = solid[1:], fresh[1:]
    ends = np.flatnonzero(solid & (~after | last)) + 1
    return starts, ends, text[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased: differences of prefix sums of a polynomial modulo 2^64, scrambled."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power(_INVERSE, len(data) + 1)[starts])


def shingle_hashes(words: np.ndarray, text: np.ndarray, n_texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each n consecutive words of a text, and the text's number; a text of fewer words is one shingle, of none is none."""
    counts = np.bincount(text, minlength=n_texts)
    first = np.cumsum(counts) - counts
    n_out = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    own = np.repeat(np.arange(n_texts), n_out)
    at = first[own] + np.arange(len(own)) - (np.cumsum(n_out) - n_out)[own]
    stop = first[own] + counts[own]
    h = np.zeros(len(own), np.uint64)
    for k in range(n):
        inside = at + k < stop
        h = h * np.uint64(0xD1342543DE82EF95) + np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))], np.uint64(k + 1))
    return mix64(h), own


def copies(shingles: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Elements of a multiset as a set: the hash of each shingle and of how often the text held it before."""
    order = np.lexsort((shingles, own))
    s, o = shingles[order], own[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
    places = np.arange(len(s))
    count = places - np.maximum.accumulate(np.where(new, places, 0))
    out = np.empty(len(s), np.uint64)
    out[order] = np.where(count > 0, mix64(s + count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), s)
    return out
