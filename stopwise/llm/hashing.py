"""Words of UTF-8 text and 64-bit hashes of byte ranges, for a whole batch at once."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (a bijection of 64-bit numbers)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32))


_VALUES = byte_values(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(2 * len(_powers[0]), n + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_sums(data: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Running polynomial sums; ``range_hashes`` turns two of them into the hash of a byte range."""
    up, _ = _grown(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * _grown(len(sums))[1][start])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _LOWER[data]


class Words(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> Words:
    """Maximal runs of bytes with ``member[byte]``; none crosses the end of a row.

    ``offsets`` may begin above 0; ``data`` starts at ``offsets[0]``.
    """
    base = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = member[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[base] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    doc = np.searchsorted(base, start, "right") - 1
    return Words(doc, start, end, range_hashes(prefix_sums(data), start, end))


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

# Digits, a-z and whatever is not ASCII, after lowering.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

# a-z and whatever is not ASCII, after lowering.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
