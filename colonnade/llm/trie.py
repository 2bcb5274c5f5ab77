"""A double-array trie over sequences of numbers, walked from all positions of a text at once."""

from __future__ import annotations

import numpy as np

DIGIT = 8  # a symbol is walked in digits of this many bits, so a state has at most 256 ways on


class DoubleArray:
    """Accepts equally long sequences of positive numbers; ``accept`` names the sequence that ends in a state.

    A state is a slot. Its way on by digit d leads to slot ``base[state] + d`` if ``check`` there names the state.
    """

    def __init__(self, base: np.ndarray, check: np.ndarray, accept: np.ndarray, length: int, digits: int):
        self.base, self.check, self.accept, self.length, self.digits = base, check, accept, length, digits

    def find(self, symbols: np.ndarray) -> np.ndarray:
        """Per position the row of the sequence that starts there, or -1. A 0 in ``symbols`` belongs to no sequence.

        All positions still alive take the same step together.
        """
        out = np.full(len(symbols), -1, np.int64)
        at = np.flatnonzero(symbols[: max(0, len(symbols) - self.length + 1)] > 0)
        state = np.zeros(len(at), np.int32)
        for step in range(self.length):
            symbol = symbols[at + step]
            for digit in range(self.digits - 1, -1, -1):
                slot = self.base[state] + ((symbol >> (DIGIT * digit)) & 255).astype(np.int32)
                alive = self.check[slot] == state
                at, state, symbol = at[alive], slot[alive], symbol[alive]
        out[at] = self.accept[state]
        return out


def build(rows: np.ndarray) -> DoubleArray:
    """The trie of ``rows`` (one sequence each, all different, sorted lexicographically).

    States with many ways on are placed first, at random offsets with all their slots free or else at the end;
    the many with a single way on then fill free slots in one step. Unused slots keep ``check`` -2.
    """
    n, length = rows.shape
    largest = int(rows.max()) if n else 1
    digits = max(1, -(-largest.bit_length() // DIGIT))
    code = [((rows[:, j] >> (DIGIT * d)) & 255).astype(np.int64) for j in range(length) for d in range(digits - 1, -1, -1)]
    pick = np.random.default_rng(7)
    used = np.zeros(1 << 12, bool)
    used[0] = True
    end = 1
    base = np.zeros(1 << 12, np.int32)
    check = np.full(1 << 12, -2, np.int32)
    state = np.zeros(n, np.int64)

    def grow(size: int) -> None:
        nonlocal used, base, check
        if size > len(used):
            more = max(size, 2 * len(used)) - len(used)
            used = np.concatenate([used, np.zeros(more, bool)])
            base = np.concatenate([base, np.zeros(more, np.int32)])
            check = np.concatenate([check, np.full(more, -2, np.int32)])

    for digit in code:
        # One edge per (state, digit); rows are sorted, so the edges of a state follow each other.
        edge = np.ones(n, bool)
        edge[1:] = (state[1:] != state[:-1]) | (digit[1:] != digit[:-1])
        at = np.flatnonzero(edge)
        source, label = state[at], digit[at]
        head = np.ones(len(at), bool)
        head[1:] = source[1:] != source[:-1]
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(at)))
        target = np.zeros(len(at), np.int64)
        for g in np.flatnonzero(count > 1)[np.argsort(-count[count > 1], kind="stable")]:
            labels = label[first[g] : first[g] + count[g]]
            offset = -1
            if end > 512:
                for tried in pick.integers(0, end - 256, 24):
                    if not used[tried + labels].any():
                        offset = int(tried)
                        break
            if offset < 0:
                offset = end
                grow(offset + 257)
            end = max(end, offset + 256)
            used[offset + labels] = True
            target[first[g] : first[g] + count[g]] = offset + labels
        single = first[count == 1]
        if len(single):
            free = np.flatnonzero(~used[256:end]) + 256 if end > 256 else np.zeros(0, np.int64)
            if len(free) < len(single):
                grow(end + 256 + len(single))
                start = max(end, 256)
                free = np.concatenate([free, np.arange(start, start + len(single) - len(free))])
                end = int(free[-1]) + 1
            target[single] = free[: len(single)]
            used[target[single]] = True
        base[source] = (target - label).astype(np.int32)
        check[target] = source.astype(np.int32)
        state = target[np.cumsum(edge) - 1] if n else state
    size = end + 256
    grow(size)
    accept = np.full(size, -1, np.int64)
    accept[state] = np.arange(n)
    return DoubleArray(base[:size].copy(), check[:size].copy(), accept, length, digits)
