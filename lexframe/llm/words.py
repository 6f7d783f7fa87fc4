"""Words and shingles of whole texts as numpy arrays of 64-bit hashes, for use inside tasks.

Texts are UTF-8 bytes; the separators are ASCII, so that cutting bytes cuts characters right."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MASK = (1 << 64) - 1
#: Any odd numbers do; these are the first digits of constants.
_BASE, _MIX, _SEED = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 20_240_229
#: Powers kept between texts (2 MB).
KEPT = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32


@lru_cache(maxsize=2)
def byte_values(fold: bool) -> np.ndarray:
    """A random value for each byte; with fold, A-Z have those of a-z."""
    values = np.random.default_rng(_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return values[_FOLD] if fold else values


@lru_cache(maxsize=1)
def _kept_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64. Those for a usual text are kept; those for a very long one
    are made anew, so that no task holds on to them."""
    return _kept_powers(KEPT) if n <= KEPT else _powers(n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(x: int) -> np.ndarray:
        steps = np.full(n, x, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def room(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of each hash over all of it."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(_MIX)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_BASE)
    h ^= h >> np.uint64(32)
    return h


def prefix_hashes(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = the hash of data[i:j], times base to the power i."""
    forward, _ = powers(room(len(data)))
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum(values[data] * forward[: len(data)], out=c[1:])
    return c


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words among bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, fold: bool) -> np.ndarray:
    """A hash for each word in order; with fold, A-Z count as a-z."""
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    c = prefix_hashes(data, byte_values(fold))
    _, back = powers(room(len(data)))
    return mixed((c[ends] - c[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each window of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += words[i : i + n] * np.uint64((_BASE ** (2 * i + 1) + 2 * i) & _MASK | 1)
    return mixed(total)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The sorted distinct shingles: windows of `width` words, A-Z lower-cased. A text of fewer
    words has one, all of them; a text without words has none."""
    words = word_hashes(text, True)
    if not len(words):
        return words
    if len(words) < width:
        return window_hashes(words, len(words)) + np.uint64(len(words))
    found = np.sort(window_hashes(words, width))
    return found[np.append(True, found[1:] != found[:-1])]
