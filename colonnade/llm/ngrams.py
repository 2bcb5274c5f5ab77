"""Hashed character n-grams of a batch of texts, computed as arrays over all characters at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd multipliers of the rolling hash: fixed values without further meaning.
MIX_1, MIX_2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in lower case, a space before and after each, and where each text starts.

    A null text is empty. White space counts as one kind of space.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")).to_pylist()
    lengths = np.fromiter(map(len, low), np.int64, len(low)) + 2
    points = np.frombuffer((" " + "  ".join(low) + " ").encode("utf-32-le"), np.uint32).copy() if low else np.zeros(0, np.uint32)
    points[(points >= 9) & (points <= 13)] = 32
    return points, np.concatenate([[0], np.cumsum(lengths)])


def gram_slots(points: np.ndarray, starts: np.ndarray, orders: tuple[int, ...], slots: int) -> list[np.ndarray]:
    """Per order, the slot of the n-gram that starts at each character, or -1 if it would leave its text.

    ``slots`` is a power of two. A longer n-gram goes on from the state of its beginning.
    """
    n = len(points)
    state = np.full(n, 1, np.uint32)
    out = []
    for order in range(1, max(orders) + 1):
        size = max(0, n - order + 1)
        state = state[:size]
        state *= MIX_1
        state ^= points[order - 1 : order - 1 + size]
        state ^= state >> np.uint32(15)
        if order not in orders:
            continue
        final = state * MIX_2
        final ^= final >> np.uint32(13)
        final *= MIX_1
        final ^= final >> np.uint32(16)
        slot = np.full(n, -1, np.int32)
        slot[:size] = (final & np.uint32(slots - 1)).astype(np.int32)
        for k in range(1, order):
            last = starts[1:] - k
            slot[last[last >= 0]] = -1
        out.append(slot)
    return out


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    from colonnade.llm.storage import text_batches

    for _, part in text_batches(batch, column, limit):
        yield part
