"""Words and word shingles of whole texts as 64-bit hashes, for many texts at once.

Everything is arithmetic on one array of bytes: a prefix sum of byte times odd power gives the hash of any
run of bytes after division by the power at its start (odd numbers have inverses modulo 2**64), so the
cost per byte is fixed and no Python runs per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = 0xD6E8FEB86659FD93 | 1
#: Most bytes that are hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 1 << 20

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Byte -> lower-case byte, and byte -> is part of a word: all but ASCII white space.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no structure."""
    x = x.copy()
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(k)
    x ^= x >> np.uint64(33)
    return x


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _tables:
        if size > 4 * CHUNK_BYTES:
            return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, p)))) for p in (_P, _P_INV))  # type: ignore[return-value]
        _tables.clear()
        _tables[size] = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, p)))) for p in (_P, _P_INV))
    return _tables[size]


@dataclass
class Words:
    """Word hashes of texts laid end to end; the words of text i stand from ``at[i]`` to ``at[i + 1]``."""

    hashes: np.ndarray
    at: np.ndarray


def hash_words(texts: list[bytes], word: np.ndarray = NOT_SPACE, lower: np.ndarray = LOWER) -> Words:
    """Hashes of all words of UTF-8 texts: the longest runs of bytes of ``word``, after ``lower``."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts_of_texts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    inside = np.empty(len(data) + 1, bool)
    inside[0] = False
    inside[1:] = word[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = turns[::2], turns[1::2]
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = (sums[last] - sums[first]) * inverse[first]
    return Words(mix(hashes ^ ((last - first).astype(np.uint64) << np.uint64(40))), np.searchsorted(first, starts_of_texts))


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each k words in a row of each text, in order, and where each text's begin.

    A text of fewer words has one for its whole sequence, one without words none.
    """
    n = np.diff(words.at)
    total = len(words.hashes)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(counts)))
    weights = [np.uint64(pow(_Q, j + 1, 1 << 64)) for j in range(k)]
    rolled = np.zeros(max(0, total - k + 1), np.uint64)
    for j in range(k):
        rolled += words.hashes[j : j + len(rolled)] * weights[j]
    rolled = mix(rolled)
    # the k - 1 windows that run over the end of a text are left out
    out = np.empty(at[-1], np.uint64)
    long = n >= k
    if long.any():
        where = np.repeat(words.at[:-1][long] - at[:-1][long], counts[long])
        spots = np.flatnonzero(np.repeat(long, counts))
        out[spots] = rolled[spots + where]
    for i in np.flatnonzero((n > 0) & ~long):
        h = words.hashes[words.at[i] : words.at[i + 1]]
        with np.errstate(over="ignore"):
            out[at[i]] = mix(np.array([sum(int(x) * int(w) for x, w in zip(h, weights, strict=False)) + len(h) & (1 << 64) - 1], np.uint64))[0]
    return out, at


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, at = shingle_hashes(hash_words(texts), k)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> list[slice]:
    """Slices of the list of about so many bytes each."""
    found, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            found.append(slice(start, i))
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        found.append(slice(start, len(texts)))
    return found


def hash_runs(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes ``data[first:last]``, as they stand."""
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    hashes = (sums[last] - sums[first]) * inverse[first]
    return mix(hashes ^ ((last - first).astype(np.uint64) << np.uint64(40)))
