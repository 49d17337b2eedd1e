"""Hashes (64 bits) of the words of texts, computed over whole byte arrays.

A word's hash is a polynomial of its bytes modulo 2^64, with a random number
for each byte value and an odd base, mixed with its length. One running sum
over a window of text gives the hashes of all words in it.
"""

from __future__ import annotations

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)
WINDOW = 1 << 20

_BASE = 0xD6E8FEB86659FD93
_rng = np.random.default_rng(20240917)
_VALUE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE[_SPACE] = 0
_powers = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(kind: str, n: int) -> np.ndarray:
    """The first n powers; kept for the longest window met."""
    if len(_powers[kind]) < n:
        one = _BASE if kind == "base" else pow(_BASE, -1, 2**64)
        steps = np.full(max(n, WINDOW), one, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps)
    return _powers[kind][:n]


def _windows(data: np.ndarray):
    """(start, end) of windows that end between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + WINDOW)
        if end < len(data):
            blank = np.flatnonzero(_SPACE[data[at:end]])
            if len(blank):
                end = at + int(blank[-1]) + 1
            else:  # one long word: go on to its end
                while end < len(data) and not _SPACE[data[end]]:
                    end = min(len(data), end + WINDOW)
                    blank = np.flatnonzero(_SPACE[data[at:end]])
                    if len(blank):
                        end = at + int(blank[0])
        yield at, end
        at = end


def hash_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of every word of ``raw``."""
    data = np.frombuffer(raw, np.uint8)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a, b in _windows(data):
        own = data[a:b]
        word = np.zeros(len(own) + 2, bool)
        word[1:-1] = ~_SPACE[own]
        edge = np.flatnonzero(word[1:] != word[:-1])
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_VALUE[own] * _power("base", len(own)), out=total[1:])
        value = (total[end] - total[start]) * _power("inverse", len(own))[start]
        hashes.append(mix(value + (end - start).astype(np.uint64) * P))
        places.append(start + a)
    return np.concatenate(hashes), np.concatenate(places)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of words of each.
    Words end at ASCII white space; A-Z count as a-z."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    hashes, places = hash_words(b"\n".join(raw))
    begins = np.cumsum([0] + [len(r) + 1 for r in raw])
    return hashes, np.diff(np.searchsorted(places, begins))
