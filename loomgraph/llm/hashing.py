"""Hashes of words and of five-word shingles, whole buffers at a time in NumPy.

A word's hash is a polynomial of its bytes (a fixed random number for each byte, A-Z as
a-z) modulo 2**64, mixed; it is read off two running sums, so no word is cut out.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes whose running sums are held at a time; a piece ends after a blank.
PIECE = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LETTERS = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[65:91] = _LETTERS[97:123]
_BASE = 0x9E3779B97F4A7C15
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """The first n (or more) powers of an odd base, modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.ones(1, np.uint64)
        while len(got) < n:
            got = np.concatenate([got, got * np.uint64(pow(base, len(got), 1 << 64))])
        _POWERS[base] = got
    return got


def running(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2 ... values, modulo 2**64."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _pieces(data: np.ndarray):
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        size = 4096
        while end < len(data):  # on to the next blank
            gap = np.flatnonzero(_BLANK[data[end : end + size]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end, size = min(len(data), end + size), size * 2
        yield at, data[at:end]
        at = end


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word ``[^\\x20\\x09-\\x0D]+`` of a buffer of bytes starts, and its hash."""
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at, part in _pieces(data):
        blank = np.ones(len(part) + 2, bool)
        np.take(_BLANK, part, out=blank[1:-1])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        start, end = edges[::2], edges[1::2]
        sums = running(_LETTERS.take(part) * powers(len(part), _BASE)[: len(part)])
        h = (sums.take(end) - sums.take(start)) * powers(len(part), pow(_BASE, -1, 1 << 64)).take(start)
        h += (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        starts.append(start + at)
        hashes.append(mixed(h))
    return np.concatenate(starts), np.concatenate(hashes)


def sequence_hash(h: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of each run ``[first, end)`` of word hashes, in order."""
    if not len(h):
        return np.zeros(len(first), np.uint64)
    sums = running(h * powers(len(h), base)[: len(h)])
    return mixed((sums.take(end) - sums.take(first)) * powers(len(h), pow(base, -1, 1 << 64)).take(np.minimum(first, len(h) - 1)) + (end - first).astype(np.uint64))


def shingles(h: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``owner, hash`` of the shingles of runs of words: ``count`` of them from ``first`` on; a run of one to four words is one shingle.

    The runs follow one another without gaps, so a shingle's owner is that of its first word.
    """
    owner = np.repeat(np.arange(len(count)), count)
    n = max(0, len(h) - WORDS + 1)
    x = np.zeros(n, np.uint64)
    for j, f in enumerate(_FACTORS):
        x += h[j : j + n] * f
    inside = owner[:n] == owner[WORDS - 1 :]
    owners, hashes = [owner[:n][inside]], [mixed(x[inside])]
    for k in range(1, WORDS):
        few = np.flatnonzero(count == k)
        x = np.full(len(few), k * 0x632BE59BD9B4E019 % (1 << 64), np.uint64)
        for j in range(k):
            x += h[first[few] + j] * _FACTORS[j]
        owners.append(few)
        hashes.append(mixed(x))
    return np.concatenate(owners), np.concatenate(hashes)


def buffer_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``owner, hash`` of the distinct shingles of each text, sorted by text and hash."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    start, h = word_hashes(data)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(start, ends)
    first = np.concatenate([[0], upto[:-1]]).astype(np.int64)
    owner, x = shingles(h, first, upto - first)
    order = np.lexsort((x, owner))
    owner, x = owner[order], x[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], x[new]
