"""Hashes of words and of runs of words, computed over the bytes of many texts at once.

A word is a run of bytes other than space and U+0009 to U+000D; A-Z count as a-z. A word's hash adds one random
64-bit number per byte times a power of an odd number, so texts are never taken apart into Python strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE_VALUES[_IS_SPACE] = 0
_ODD = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BASE = int(_ODD[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, name: str, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept and grown as needed."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        steps = np.full(size, base & ((1 << 64) - 1), np.uint64)
        steps[0] = 1
        have = _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    x = x ^ (x >> np.uint64(31))
    x = x * _ODD[1]
    x ^= x >> np.uint64(29)
    x *= _ODD[2]
    x ^= x >> np.uint64(32)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and where each text's words start (one more entry than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_IS_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = ends[:-1][ends[:-1] < len(raw)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    values = _BYTE_VALUES[raw]
    values *= _powers(_BASE, "up", len(raw))
    sums = np.add.reduceat(values, starts)
    sums *= _powers(_INVERSE, "down", len(raw))[starts]
    return mixed(sums), np.searchsorted(starts, ends)


def run_hashes(words: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``length`` words inside a text and where each text's runs start.

    A text with fewer words has one run, its whole sequence; one without words has none.
    """
    n = np.diff(bounds)
    counts = np.where(n >= length, n - length + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(counts)])
    if not out_bounds[-1]:
        return np.zeros(0, np.uint64), out_bounds
    padded = np.concatenate([words, np.zeros(length, np.uint64)])
    state = np.zeros(len(words), np.uint64)
    for k in range(length):
        state += padded[k : k + len(words)] * _ODD[8 + k % 40]
        state ^= state >> np.uint64(30)
        state *= _ODD[3]
    at = np.repeat(bounds[:-1] - out_bounds[:-1], counts) + np.arange(out_bounds[-1])
    out = state[at]
    for doc in np.flatnonzero((n > 0) & (n < length)):
        sequence = np.uint64(0)
        with np.errstate(over="ignore"):
            for k, word in enumerate(words[bounds[doc] : bounds[doc + 1]]):
                sequence = (sequence + word * _ODD[8 + k % 40]) * _ODD[4]
                sequence ^= sequence >> np.uint64(30)
            out[out_bounds[doc]] = sequence + _ODD[5] * np.uint64(n[doc])
    return mixed(out), out_bounds
