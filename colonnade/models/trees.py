"""Decision trees on binned columns, many at a time.

Rows are packed once into blocks of small numbers. Nodes with many rows are split level by level: every task adds up
histograms of its blocks for all these nodes of all trees, Spark adds the histograms, and the best split of a node is
found where its sums meet. Once a node has at most LOCAL_ROWS rows, they are sent to one task, which finishes that
subtree. Both ways search the same splits of the same sums, so the bound changes the speed and never the tree.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.session import cut_lineage

BINS = 64  # most bins of a column, at most 256
BLOCK_ROWS = 1 << 13
LOCAL_ROWS = 1 << 13  # up to MOST_LOCAL times as many where trees have many rows
MOST_LOCAL = 8
SEND_ROWS = 1 << 16  # rows of several blocks that are sent to their small nodes together
HISTOGRAM_BYTES = 64 << 20  # histograms a task holds in one pass
BATCH_ROWS = 1 << 17  # most rows of small nodes that are split together in a task
DENSE_BYTES = 32 << 20  # sums per bin that splitting them holds at once, a few times over
GRADIENT_STEP = 2.0**-30  # gradients are whole multiples of this, so their sums do not depend on the order
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit numbers over the whole number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_of(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:16], 16)


# --- bins and blocks ---------------------------------------------------------------------------------------------


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Cut points per column: between all values where there are at most ``bins``, else at quantiles.

    A value lies in bin b if b cuts are smaller than it. One aggregate, and a second one for columns of few values.
    """
    shares = [i / bins for i in range(1, bins)]
    got = df.agg(
        *[F.percentile_approx(c, shares, 100 * bins).alias(f"q{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(columns)],
    ).first()
    few = [i for i in range(len(columns)) if (got[f"n{i}"] or 0) <= 0.9 * bins]
    exact = df.agg(*[F.collect_set(columns[i]).alias(f"v{i}") for i in few]).first() if few else None
    out = []
    for i in range(len(columns)):
        if i in few and len(exact[f"v{i}"]) <= bins:
            values = np.sort(np.asarray(exact[f"v{i}"], float))
            out.append((values[1:] + values[:-1]) / 2)
        else:
            out.append(np.unique(np.asarray(got[f"q{i}"] or [], float)))
    return out


def binned(values: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, values[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


@dataclass
class Block:
    """Rows of one block: bins (n x p), target, fold and 64-bit key."""

    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    key: np.ndarray
    margins: np.ndarray | None = None

    _draws: dict = field(default_factory=dict)

    def draws(self, seed: int, mean: float, rows: np.ndarray | None = None) -> np.ndarray:
        """How often each row is drawn: a Poisson number of the row's key and the seed; ``mean`` 0 takes each once."""
        key = self.key if rows is None else self.key[rows]
        if not mean:
            return np.ones(len(key))
        bounds, table = poisson_table(mean)
        hashed = mixed(key ^ np.uint64(seed))
        out = table[(hashed >> np.uint64(52)).astype(np.int64)]
        open_ = np.flatnonzero(out < 0)
        out[open_] = np.searchsorted(bounds, (hashed[open_] >> np.uint64(11)).astype(float) * 2.0**-53, "right")
        return out

    def learned(self, fold: int) -> np.ndarray:
        """Rows a tree that leaves out ``fold`` learns from."""
        if ("fold", fold) not in self._draws:
            self._draws["fold", fold] = np.flatnonzero((self.fold >= 0) & (self.fold != fold))
        return self._draws["fold", fold]


def poisson_bounds(mean: float) -> np.ndarray:
    """Cumulative shares of 0, 1, 2, ... draws, as far as double precision tells them from 1."""
    bounds, term, total, j = [], math.exp(-mean), 0.0, 0
    while total + term > total:
        total += term
        bounds.append(total)
        j += 1
        term *= mean / j
    return np.asarray(bounds)


@functools.lru_cache
def poisson_table(mean: float) -> tuple[np.ndarray, np.ndarray]:
    """The bounds, and the draws by the first 12 bits of a hash; -1 where a bound lies between hashes that begin alike."""
    bounds = poisson_bounds(mean)
    start = np.arange(1 << 12) * 2.0**-12
    first, last = np.searchsorted(bounds, start, "right"), np.searchsorted(bounds, start + (2.0**-12 - 2.0**-53), "right")
    return bounds, np.where(first == last, first, -1).astype(float)


FORM = "x binary, y binary, fold binary, key binary"


def pack(
    df: DataFrame, columns: Sequence[str], edges: Sequence[np.ndarray], y: Column, key: Column, fold: Column | None = None, ids: Column | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` as a written table of blocks; ``fold`` -1 marks rows no tree learns from, ``ids`` go along on request."""
    named = [] if ids is None else [ids.alias("id")]
    rows = df.select(
        F.xxhash64(key).alias("key"), y.cast("double").alias("y"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"),
        *[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)], *named)
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:
        rows = rows.repartition(tasks)  # a small table in few files would leave cores idle in every later pass
    p, with_ids = len(columns), bool(named)
    form = FORM + (f", ids array<{rows.schema['id'].dataType.simpleString()}>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            x = binned(np.stack([t.column(f"c{j}").to_numpy() for j in range(p)], axis=1), edges)
            parts = [x, t.column("y").to_numpy().astype(float), t.column("fold").to_numpy().astype(np.int32), t.column("key").to_numpy().astype(np.int64)]
            out = [pa.array([v.tobytes()], pa.binary()) for v in parts]
            if with_ids:
                own = t.column("id").combine_chunks()
                out.append(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own))
            return pa.RecordBatch.from_arrays(out, ["x", "y", "fold", "key", "ids"][: len(out)])

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                piece = batch.slice(at, block_rows)
                if held and sum(b.num_rows for b in held) + piece.num_rows > block_rows:
                    yield block()
                    held.clear()
                held.append(piece)
        if held and sum(b.num_rows for b in held):
            yield block()

    return cut_lineage(rows.mapInArrow(run, form))


def joined(blocks: Iterator[Block], rows: int) -> Iterator[Block]:
    """Blocks without margins put together to at most ``rows`` rows, single blocks left whole."""
    held: list[Block] = []

    def one() -> Block:
        return held[0] if len(held) == 1 else Block(*(np.concatenate([getattr(b, name) for b in held]) for name in ("x", "y", "fold", "key")))

    for block in blocks:
        if held and sum(len(b.y) for b in held) + len(block.y) > rows:
            yield one()
            held.clear()
        held.append(block)
    if held:
        yield one()


def blocks_of(batches: Iterator[pa.RecordBatch], p: int, shape: tuple[int, int] | None = None) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            y = np.frombuffer(row["y"], float)
            margins = np.frombuffer(row["margins"], np.float32).reshape(len(y), *shape) if shape else None
            yield Block(
                np.frombuffer(row["x"], np.uint8).reshape(-1, p), y, np.frombuffer(row["fold"], np.int32),
                np.frombuffer(row["key"], np.int64).view(np.uint64), margins)


# --- what to grow and what has grown -----------------------------------------------------------------------------


@dataclass
class Plan:
    """One tree to grow. ``fold`` is left out; -2 leaves none out. ``draw`` features are tried per node (0: all)."""

    fold: int = -2
    seed: int = 0
    mean: float = 0.0
    columns: np.ndarray | None = None
    draw: int = 0
    min_leaf: int = 1
    min_split: int = 2
    max_depth: int = 30
    model: int = 0
    target: int = 0


@dataclass
class Forest:
    """Grown trees as arrays over all their nodes; ``feature`` -1 marks leaves, ``root`` starts each tree."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    depth: np.ndarray
    stats: np.ndarray
    root: np.ndarray

    def leaves(self, x: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree (rows x trees)."""
        node = np.repeat(self.root[trees][None, :], len(x), axis=0)
        rows = np.repeat(np.arange(len(x))[:, None], len(trees), axis=1)
        live = np.flatnonzero(self.feature[node].ravel() >= 0)
        flat, rows = node.ravel(), rows.ravel()
        while len(live):
            at = flat[live]
            down = x[rows[live], self.feature[at]] <= self.cut[at]
            flat[live] = np.where(down, self.left[at], self.right[at])
            live = live[self.feature[flat[live]] >= 0]
        return flat.reshape(node.shape)

    def reach(self, x: np.ndarray, rows: np.ndarray, tree: int, useful: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaf) of the ``rows`` that come to a useful leaf; the others are left as soon as no such leaf lies below."""
        flat, width = x.ravel(), x.shape[1]
        node = np.full(len(rows), self.root[tree])
        out = []
        while len(rows):
            feature = self.feature[node]
            at_end = feature < 0
            if at_end.any():
                out.append((rows[at_end], node[at_end]))
                on = np.flatnonzero(~at_end)
                rows, node, feature = rows[on], node[on], feature[on]
            above = flat[rows * width + feature] > self.cut[node]
            node = np.where(above, self.right[node], self.left[node])
            on = np.flatnonzero(useful[node])
            rows, node = rows[on], node[on]
        return tuple(np.concatenate(v) for v in zip(*out)) if out else (rows, node)

    def ends(self, kind: str, max_depth: int, min_split: int) -> np.ndarray:
        """Per node where a row that reaches it stops if the trees had been grown less: each is cut from the top."""
        count = counts_of(self.stats, kind)
        stop = (self.feature < 0) | (self.depth >= max_depth) | (count < min_split)
        end = np.arange(len(stop))
        inner = np.flatnonzero(self.feature >= 0)
        for at in np.split(inner[np.argsort(self.depth[inner], kind="stable")], np.cumsum(np.bincount(self.depth[inner]))[:-1]) if len(inner) else []:
            over = stop[at] | (end[at] != at)
            for side in (self.left, self.right):
                end[side[at]] = np.where(over, end[at], side[at])
        return end

    def shares(self) -> np.ndarray:
        """Class shares of every node."""
        total = self.stats.sum(axis=1, keepdims=True)
        return np.divide(self.stats, total, out=np.full_like(self.stats, 1.0 / self.stats.shape[1]), where=total > 0)

    def importance(self, kind: str, criterion: str, p: int) -> np.ndarray:
        return mean_importance([self.gain_shares(kind, criterion, p)])

    def gain_shares(self, kind: str, criterion: str, p: int) -> np.ndarray:
        """Share of the impurity that splits on each column take away, per tree (trees x columns)."""
        score = side_score(self.stats, criterion)
        inner = np.flatnonzero(self.feature >= 0)
        gain = score[self.left[inner]] + score[self.right[inner]] - score[inner]
        tree = np.searchsorted(self.root, inner, "right") - 1
        table = np.zeros((len(self.root), p))
        np.add.at(table, (tree, self.feature[inner]), np.maximum(gain, 0.0))
        total = table.sum(axis=1, keepdims=True)
        return np.divide(table, total, out=np.zeros_like(table), where=total > 0)


def mean_importance(tables: Sequence[np.ndarray]) -> np.ndarray:
    """Shares of the columns averaged over the trees of all ``tables``."""
    each = np.concatenate(tables).mean(axis=0)
    return each / each.sum() if each.sum() > 0 else each


def counts_of(stats: np.ndarray, kind: str) -> np.ndarray:
    return stats.sum(axis=-1) if kind == "class" else stats[..., 0]


def side_score(stats: np.ndarray, criterion: str) -> np.ndarray:
    """Minus the impurity of rows with these sums, times their number, up to a term that splits do not change."""
    if criterion == "variance":
        return np.divide(stats[..., 1] ** 2, stats[..., 0], out=np.zeros(stats.shape[:-1]), where=stats[..., 0] > 0)
    total = stats.sum(axis=-1)
    if criterion == "gini":
        return np.divide((stats * stats).sum(axis=-1), total, out=np.zeros(total.shape), where=total > 0)
    logs = stats * np.log(np.maximum(stats, 1.0))
    return logs.sum(axis=-1) - total * np.log(np.maximum(total, 1.0))


def row_stats(values: np.ndarray, weights: np.ndarray, kind: str, classes: int) -> np.ndarray:
    """Sums of single rows: weight per class, or (weight, value, second value), each times the weight."""
    if kind == "class":
        out = np.zeros((len(values), classes))
        out[np.arange(len(values)), values.astype(np.int64)] = weights
        return out
    if kind == "gradient":
        g = values * GRADIENT_STEP
        h = np.round(np.abs(g) * (1.0 - np.abs(g)) / GRADIENT_STEP) * GRADIENT_STEP
        return np.stack([weights, g * weights, h * weights], axis=1)
    return np.stack([weights, values * weights, values * values * weights], axis=1)


VALUE_TYPE = {"class": np.uint8, "gradient": np.int32, "real": np.float64}


class Nodes:
    """Rules shared by both ways of splitting, for nodes given as arrays: tree, depth, path, sums."""

    def __init__(self, plans: Sequence[Plan], kind: str, criterion: str, p: int):
        self.kind, self.criterion, self.p = kind, criterion, p
        self.draw = np.asarray([q.draw for q in plans])
        self.leaf = np.asarray([q.min_leaf for q in plans])
        self.split = np.asarray([q.min_split for q in plans])
        self.deep = np.asarray([q.max_depth for q in plans])
        self.seed = np.asarray([q.seed for q in plans], np.uint64)
        self.columns = np.asarray([np.ones(p, bool) if q.columns is None else q.columns for q in plans])

    def open(self, tree: np.ndarray, depth: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """Nodes that may be split: deep and large enough on no side, and not of one class."""
        n = counts_of(stats, self.kind)
        ok = (depth < self.deep[tree]) & (n >= self.split[tree]) & (n >= 2 * self.leaf[tree])
        return ok & (stats.max(axis=1) < n) if self.kind == "class" else ok

    def allowed(self, tree: np.ndarray, path: np.ndarray) -> np.ndarray:
        """Columns tried at each node: those of the tree, or the ``draw`` of them that come first by hash."""
        own = self.columns[tree]
        if not self.draw.any():
            return own
        draw = self.draw[tree]
        hashed = mixed(mixed(path ^ self.seed[tree])[:, None] + _ODD * np.arange(1, self.p + 1, dtype=np.uint64))
        hashed = np.where(own, hashed >> np.uint64(1), np.uint64(1 << 63))
        place = np.argsort(np.argsort(hashed, axis=1, kind="stable"), axis=1)
        return own & ((draw == 0)[:, None] | (place < draw[:, None]))

    def gains(self, left: np.ndarray, total: np.ndarray, whole: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """What a cut with ``left`` sums gains over the score of the ``whole`` node; -inf if a side is too small."""
        right = total - left
        least = self.leaf[tree]
        ok = (counts_of(left, self.kind) >= least) & (counts_of(right, self.kind) >= least)
        score = side_score(left, self.criterion) + side_score(right, self.criterion) - whole
        # A gain that is rounding noise counts as none.
        noise = np.abs(score) <= 1e-9 * np.maximum(counts_of(total, self.kind), 1.0)
        if self.kind != "class":
            ok &= (score > 0) & ~noise
        else:
            score[noise] = 0.0
        score[~ok] = -np.inf
        return score


def child_paths(path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mixed(path * np.uint64(2)), mixed(path * np.uint64(2) + np.uint64(1))


def split_dense(rule: Nodes, sums: np.ndarray, tree: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, cut, left sums) of nodes from sums (node, column, bin, stat); column -1 where none is valid.

    The first column and lowest cut of the best gain win.
    """
    total = sums[:, 0].sum(axis=1)
    whole = side_score(total, rule.criterion)
    best = np.full(len(sums), -np.inf)
    column, cut = np.full(len(sums), -1), np.zeros(len(sums), np.int64)
    left = np.zeros_like(total)
    for j in range(sums.shape[1]):
        run = np.cumsum(sums[:, j], axis=1)[:, :-1]
        if not run.shape[1]:
            continue
        gain = rule.gains(run, total[:, None], whole[:, None], tree[:, None])
        gain[~allowed[:, j]] = -np.inf
        at = np.argmax(gain, axis=1)
        value = gain[np.arange(len(gain)), at]
        better = value > best
        best[better], column[better], cut[better] = value[better], j, at[better]
        left[better] = run[better, at[better]]
    return column, cut, left


def split_sorted(rule: Nodes, x: np.ndarray, stats: np.ndarray, node: np.ndarray, total: np.ndarray, tree: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from rows with node numbers, by sorting on (node, bin): its cost does not grow with nodes times bins."""
    n = len(total)
    whole = side_score(total, rule.criterion)
    best = np.full(n, -np.inf)
    column, cut = np.full(n, -1), np.zeros(n, np.int64)
    left = np.zeros_like(total)
    for j in range(x.shape[1]):
        use = allowed[node, j]
        if not use.any():
            continue
        rows = slice(None) if use.all() else np.flatnonzero(use)
        key = node[rows] * 256 + x[rows, j]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cells = np.add.reduceat(stats[rows][order], start, axis=0)
        at = key[start] >> 8
        head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        run = np.cumsum(cells, axis=0)
        size = np.diff(np.append(head, len(at)))
        before = np.repeat(np.concatenate([np.zeros((1, run.shape[1])), run[head[1:] - 1]]), size, axis=0)
        run -= before
        gain = rule.gains(run, total[at], whole[at], tree[at])
        top = np.maximum.reduceat(gain, head)
        first = np.minimum.reduceat(np.where(gain == np.repeat(top, size), np.arange(len(gain)), len(gain)), head)
        owner = at[head]
        better = top > best[owner]
        owner, first = owner[better], first[better]
        best[owner], column[owner], cut[owner], left[owner] = top[better], j, key[start][first] & 255, run[first]
    return column, cut, left


def _sums(x: np.ndarray, stats: np.ndarray, node: np.ndarray, nodes: int, bins: int, used: int) -> np.ndarray:
    """Sums of the first ``used`` stats per (node, column, bin)."""
    out = np.empty((nodes, x.shape[1], bins, used))
    base = node * bins
    for j in range(x.shape[1]):
        key = base + x[:, j]
        for s in range(used):
            out[:, j, :, s] = np.bincount(key, stats[:, s], nodes * bins).reshape(-1, bins)
    return out


def grow_here(rule: Nodes, bins: int, x: np.ndarray, stats: np.ndarray, group: np.ndarray, tree: np.ndarray, depth: np.ndarray, path: np.ndarray) -> dict:
    """Whole subtrees below the nodes ``group`` numbers rows by; ``tree``, ``depth`` and ``path`` describe each.

    Returns node arrays with the start nodes first and ``group`` naming the subtree of each node. Sums of two children
    are read off the smaller one and their parent where the parent's are at hand; all sums are of whole numbers.
    """
    n, width = len(tree), stats.shape[1]
    used = width if rule.kind == "class" else 2  # the third sum decides no cut
    pair = lambda a, b: np.stack([a, b], axis=1).reshape(-1, *a.shape[1:])
    total = np.stack([np.bincount(group, stats[:, s], n) for s in range(width)], axis=1)
    levels = [{"group": np.arange(n), "depth": depth, "stats": total, "feature": np.full(n, -1), "cut": np.zeros(n, np.int64), "left": np.full(n, -1)}]
    made = n
    owner, node, parents = np.arange(n), group, None
    while True:
        go = rule.open(tree, depth, total)
        if not go.any():
            break
        sums = None
        cells = int(go.sum()) * bins
        if cells <= 4 * len(node) and cells * rule.p * used * 8 <= DENSE_BYTES:
            if parents is None:
                name = np.cumsum(go) - 1
                rows = go[node]
                sums = _sums(x[rows], stats[rows], name[node[rows]], int(go.sum()), bins, used)
            else:
                size = np.bincount(node, minlength=len(tree)).reshape(-1, 2)
                live = np.flatnonzero(go.reshape(-1, 2).any(axis=1))
                small = (size[live, 1] < size[live, 0]).astype(np.int64)
                name = np.full(len(tree), -1)
                name[2 * live + small] = np.arange(len(live))
                rows = name[node] >= 0
                own = _sums(x[rows], stats[rows], name[node[rows]], len(live), bins, used)
                other = parents[live] - own
                both = np.empty((2 * len(live), *own.shape[1:]))
                both[2 * np.arange(len(live)) + small], both[2 * np.arange(len(live)) + 1 - small] = own, other
                sums = both[go.reshape(-1, 2)[live].ravel()]
        number = np.flatnonzero(go)
        if not go.all():
            rows = np.flatnonzero(go[node])
            x, stats, node = x.take(rows, 0), stats.take(rows, 0), (np.cumsum(go) - 1)[node.take(rows)]
            tree, depth, path, total, owner = tree[go], depth[go], path[go], total[go], owner[go]
        allowed = rule.allowed(tree, path)
        if sums is not None:
            column, cut, left = split_dense(rule, sums, tree, allowed)
        else:
            column, cut, left = split_sorted(rule, x, stats[:, :used], node, total[:, :used], tree, allowed)
        done = column >= 0
        if not done.any():
            break
        parents = sums[done] if sums is not None else None
        last = levels[-1]
        at = number[done]
        last["feature"][at], last["cut"][at], last["left"][at] = column[done], cut[done], made + 2 * np.arange(done.sum())
        if not done.all():
            rows = np.flatnonzero(done[node])
            x, stats, node = x.take(rows, 0), stats.take(rows, 0), node.take(rows)
        side = x.ravel()[np.arange(0, x.size, x.shape[1]) + column[node]] > cut[node]
        node = 2 * (np.cumsum(done) - 1)[node] + side
        low, high = child_paths(path[done])
        total = pair(left[done], total[done][:, :used] - left[done])
        if used < width:
            total = np.column_stack([total, *(np.bincount(node, stats[:, s], len(total)) for s in range(used, width))])
        tree, depth, path, owner = np.repeat(tree[done], 2), np.repeat(depth[done] + 1, 2), pair(low, high), np.repeat(owner[done], 2)
        made += len(tree)
        levels.append({
            "group": owner, "depth": depth, "stats": total, "feature": np.full(len(tree), -1), "cut": np.zeros(len(tree), np.int64),
            "left": np.full(len(tree), -1)})
    return {k: np.concatenate([level[k] for level in levels]) for k in SUBTREE}


# --- growing -----------------------------------------------------------------------------------------------------


class _Partial:
    """The nodes of all trees on the driver while they grow."""

    def __init__(self, plans: Sequence[Plan], width: int):
        n = len(plans)
        self.width = width
        self.tree = np.arange(n)
        self.feature, self.cut = np.full(n, -1), np.zeros(n, np.int64)
        self.left = np.full(n, -1)
        self.depth, self.path = np.zeros(n, np.int64), np.asarray([q.seed for q in plans], np.uint64)
        self.path = mixed(self.path + _ODD)
        self.stats = np.zeros((n, width))

    def add(self, tree, feature, cut, left, depth, path, stats) -> int:
        at = len(self.feature)
        for name, new in zip(("tree", "feature", "cut", "left", "depth", "path", "stats"), (tree, feature, cut, left, depth, path, stats)):
            setattr(self, name, np.concatenate([getattr(self, name), new]))
        return at

    def walker(self) -> Forest:
        return Forest(self.feature, self.cut, self.left, self.left + 1, self.depth, self.stats, np.flatnonzero(self.depth == 0))

    def useful(self, nodes: np.ndarray) -> np.ndarray:
        """Per node whether it is one of ``nodes`` or lies above one."""
        inner = np.flatnonzero(self.left >= 0)
        parent = np.full(len(self.left), -1)
        parent[self.left[inner]] = parent[self.left[inner] + 1] = inner
        out, up = np.zeros(len(parent), bool), np.asarray(nodes)
        while len(up):
            out[up] = True
            up = np.unique(parent[up])
            up = up[up >= 0]
            up = up[~out[up]]
        return out

    def state(self, nodes: np.ndarray) -> tuple:
        return self.walker(), nodes, self.tree, self.useful(nodes)

    def only(self, low: int, high: int) -> tuple["_Partial", np.ndarray]:
        """The nodes of trees ``low`` to ``high`` alone, and the new number of each node."""
        use = np.flatnonzero((self.tree >= low) & (self.tree < high))
        place = np.full(len(self.tree), -1)
        place[use] = np.arange(len(use))
        out = _Partial([], self.width)
        for name in ("feature", "cut", "depth", "path", "stats"):
            setattr(out, name, getattr(self, name)[use])
        out.tree = self.tree[use] - low
        out.left = np.where(self.left[use] >= 0, place[self.left[use]], -1)
        return out, place

    def finished(self, trees: int) -> Forest:
        """Nodes in the order of their trees, roots first."""
        order = np.lexsort((np.arange(len(self.tree)), self.tree))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        left = np.where(self.left >= 0, place[self.left], -1)[order]
        right = np.where(self.left >= 0, place[np.minimum(self.left + 1, len(place) - 1)], -1)[order]
        root = np.searchsorted(self.tree[order], np.arange(trees))
        return Forest(self.feature[order].astype(np.int32), self.cut[order], left, right, self.depth[order].astype(np.int32), self.stats[order], root)


def _values(block: Block, plan: Plan, kind: str, gradients) -> np.ndarray:
    return gradients(block, plan) if gradients else block.y


def grow(*args, **options) -> Forest:
    """All trees of ``grow_parts`` as one forest; driver memory is the nodes of all trees."""
    return next(grow_parts(*args, **options, most_nodes=math.inf))


def grow_parts(
    blocks: DataFrame, plans: Sequence[Plan], kind: str, criterion: str, p: int, bins: int, classes: int = 1,
    expected: Callable[[Plan], float] = lambda q: math.inf, local_rows: int | None = None, shape: tuple[int, int] | None = None, gradients=None,
    most_nodes: float = math.inf,
) -> Iterator[Forest]:
    """Grow all ``plans`` on the packed ``blocks``; forests of leading, then following trees that hold about ``most_nodes`` nodes.

    ``expected`` says how many rows a tree will see (only to tell small trees at once); ``gradients`` replaces the
    target by whole numbers of GRADIENT_STEP that depend on the block's margins. The upper nodes of all trees, down to
    those of few rows, grow together; what lies below, nearly all nodes, is grown for one forest at a time (one
    tree at least).
    """
    spark = blocks.sparkSession
    size = np.asarray([expected(q) for q in plans], float)
    if local_rows is None:
        most = size[np.isfinite(size)].max(initial=0.0)
        local_rows = int(max(LOCAL_ROWS, min(MOST_LOCAL * LOCAL_ROWS, most / 64)))
    rule = Nodes(plans, kind, criterion, p)
    width = classes if kind == "class" else 3
    part = _Partial(plans, width)
    large = np.flatnonzero(size > local_rows)
    small = np.flatnonzero(size <= local_rows)
    room = max(1, HISTOGRAM_BYTES // (p * bins * width * 8))
    while len(large):
        grown = []
        # Nodes of a tree stand together, so that a pass walks few trees and adds to a narrow range of sums.
        large = large[np.argsort(part.tree[large], kind="stable")]
        for at in range(0, len(large), room):
            held = spark.sparkContext.broadcast(part.state(large[at : at + room]))
            grown.append(_split_large(blocks, held, plans, rule, bins, width, shape, gradients, part.path, part.depth))
        found = {k: np.concatenate([g[k] for g in grown]) for k in grown[0]}
        at, total, left = found["node"], found["total"], found["left"]
        part.stats[at] = total
        done = found["column"] >= 0
        at, total, left = at[done], total[done], left[done]
        part.feature[at], part.cut[at] = found["column"][done], found["cut"][done]
        low, high = child_paths(part.path[at])
        pair = lambda a, b: np.stack([a, b], axis=1).reshape(-1, *a.shape[1:])
        m = 2 * len(at)
        stats = pair(left, total - left)
        first = part.add(np.repeat(part.tree[at], 2), np.full(m, -1), np.zeros(m, np.int64), np.full(m, -1), np.repeat(part.depth[at] + 1, 2), pair(low, high), stats)
        part.left[at] = first + 2 * np.arange(len(at))
        new = first + np.arange(m)
        go = rule.open(part.tree[new], part.depth[new], stats)
        n = counts_of(stats, kind)
        large = new[go & (n > local_rows)]
        small = np.concatenate([small, new[go & (n <= local_rows)]])
    yield from _finished_parts(blocks, part, small, plans, rule, bins, size, shape, gradients, most_nodes)


def _finished_parts(blocks, part: _Partial, small: np.ndarray, plans, rule: Nodes, bins: int, size: np.ndarray, shape, gradients, most_nodes: float) -> Iterator[Forest]:
    """Whole trees, as many at a time as are likely to have ``most_nodes`` nodes."""
    spark = blocks.sparkSession
    # Rows waiting below each tree, and nodes a row makes: less than two, then what the last trees made.
    rows = counts_of(part.stats[small], rule.kind)
    rows = np.where(rows > 0, rows, size[part.tree[small]])
    waiting = np.bincount(part.tree[small], rows, len(plans))
    upper = np.bincount(part.tree, minlength=len(plans))
    low, rate = 0, 2.0
    while low < len(plans):
        if most_nodes == math.inf:
            high = len(plans)
        else:
            likely = np.cumsum(waiting[low:] * rate + upper[low:])
            high = low + max(1, int(np.searchsorted(likely, most_nodes, "right")))
        some, place = part.only(low, high)
        own = place[small[(part.tree[small] >= low) & (part.tree[small] < high)]]
        before = len(some.tree)
        if len(own):
            held = spark.sparkContext.broadcast(some.state(own))
            _finish_small(blocks, held, plans[low:high], Nodes(plans[low:high], rule.kind, rule.criterion, rule.p), bins, part.width, shape, gradients, some)
        if waiting[low:high].sum() > 0:
            rate = max((len(some.tree) - before) / waiting[low:high].sum(), 1e-6)
        yield some.finished(high - low)
        low = high


def _slots(block: Block, plans: Sequence[Plan], state, kind: str, gradients) -> Iterator[tuple]:
    """(node, rows, values, weights) of a block for every tree that has nodes in ``state``."""
    walker, nodes, tree, useful = state
    for t in np.unique(tree[nodes]):
        q = plans[t]
        rows, at = walker.reach(block.x, block.learned(q.fold), t, useful)
        if not len(rows):
            continue
        weights = block.draws(q.seed, q.mean, rows)
        if q.mean:
            drawn = np.flatnonzero(weights > 0)
            rows, at, weights = rows[drawn], at[drawn], weights[drawn]
        if len(rows):
            yield at, rows, _values(block, q, kind, gradients)[rows], weights


def _split_large(blocks, held, plans, rule, bins, width, shape, gradients, paths, depths) -> dict:
    """Best split of the held nodes: histograms per task, added up per node, searched where they meet."""
    p, kind = rule.p, rule.kind
    context = blocks.sparkSession.sparkContext
    fixed = context.broadcast((plans, rule, paths, depths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, rule, _, _ = fixed.value
        state = held.value
        nodes = state[1]
        slot_of = np.full(len(state[2]), -1)
        slot_of[nodes] = np.arange(len(nodes))
        cells = p * bins
        sums = np.zeros(len(nodes) * width * cells)
        seen = np.zeros(len(nodes), bool)
        column = np.arange(p) * bins

        def add(key: np.ndarray, weights: np.ndarray, low: int, high: int) -> None:
            """Add the rows' weights to all their columns; ``key`` tells node and sum."""
            key = (key[:, None] + columns).ravel()
            weights = np.repeat(weights, p)
            if high - low <= 4 * len(key):
                sums[low:high] += np.bincount(key - low, weights, high - low)
            else:
                np.add.at(sums, key, weights)

        for block in blocks_of(batches, p, shape):
            for at, rows, values, weights in _slots(block, plans, state, kind, gradients):
                slot = slot_of[at]
                low, high = int(slot.min()) * width * cells, (int(slot.max()) + 1) * width * cells
                seen[slot] = True
                columns = block.x[rows] + column
                key = slot * (width * cells)
                if kind == "class":
                    add(key + values.astype(np.int64) * cells, weights, low, high)
                else:
                    stats = row_stats(values, weights, kind, width)
                    for s in range(width):
                        add(key + s * cells, stats[:, s], low, high)
        at = np.flatnonzero(seen)
        sums = sums.reshape(len(nodes), -1)
        for k in at.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sums[k].tobytes()], pa.binary())], ["slot", "sums"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, rule, paths, depths = fixed.value
        _, nodes, tree, _ = held.value
        added: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(raw, float)
                added[k] = added[k] + part if k in added else part
        if not added:
            return
        at = nodes[np.asarray(list(added))]
        sums = np.stack(list(added.values())).reshape(len(at), width, p, bins).transpose(0, 2, 3, 1)
        total = sums[:, 0].sum(axis=1)
        column, cut, left = split_dense(rule, sums, tree[at], rule.allowed(tree[at], paths[at]))
        column[~rule.open(tree[at], depths[at], total)] = -1
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(column), pa.array(cut), pa.array([r.tobytes() for r in total], pa.binary()), pa.array([r.tobytes() for r in left], pa.binary())],
            ["node", "column", "cut", "total", "left"])

    got = (
        blocks.mapInArrow(count, "slot int, sums binary").repartition("slot")
        .mapInArrow(choose, "node bigint, column bigint, cut bigint, total binary, left binary").toArrow()
    )
    out = {k: got.column(k).to_numpy() for k in ("node", "column", "cut")}
    for k in ("total", "left"):
        out[k] = np.frombuffer(b"".join(got.column(k).to_pylist()), float).reshape(-1, width)
    return out


def _finish_small(blocks, held, plans, rule, bins, width, shape, gradients, part: _Partial) -> None:
    """Send the rows of each held node to one task (at most LOCAL_ROWS) and grow the subtree there."""
    p, kind = rule.p, rule.kind
    spark = blocks.sparkSession
    fixed = spark.sparkContext.broadcast((plans, rule, part.path, part.depth))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, rule, _, _ = fixed.value
        names, parts = [], []

        def out() -> pa.RecordBatch:
            columns = [pa.array(names, pa.int64()), *(pa.array([v[i] for v in parts], pa.binary()) for i in range(3))]
            return pa.RecordBatch.from_arrays(columns, ["node", "x", "v", "w"])

        blocks = blocks_of(batches, p, shape)
        for block in blocks if shape else joined(blocks, SEND_ROWS):
            for at, rows, values, weights in _slots(block, plans, held.value, kind, gradients):
                order = np.argsort(at, kind="stable") if (at != at[0]).any() else np.arange(len(at))
                at, rows, values, weights = at[order], rows[order], values[order], weights[order]
                edges = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
                x, v, w = block.x[rows], values.astype(VALUE_TYPE[kind]), weights.astype(np.float32)
                for low, high in zip(edges[:-1], edges[1:]):
                    names.append(int(at[low]))
                    parts.append((x[low:high].tobytes(), v[low:high].tobytes(), b"" if (w[low:high] == 1).all() else w[low:high].tobytes()))
                if len(names) >= 64:
                    yield out()
                    names.clear()
                    parts.clear()
        if names:
            yield out()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, rule, paths, depths = fixed.value
        tree = held.value[2]
        batch_rows = min(BATCH_ROWS, max(BLOCK_ROWS, DENSE_BYTES // (4 * p * width * 8)))
        names: list[int] = []
        x: list = []
        v: list = []
        w: list = []
        group: list = []
        rows, last = 0, None

        def done() -> pa.RecordBatch:
            at = np.asarray(names)
            stats = row_stats(np.concatenate(v), np.concatenate(w), kind, width)
            got = grow_here(rule, bins, np.concatenate(x), stats, np.concatenate(group), tree[at], depths[at], paths[at])
            return pa.RecordBatch.from_arrays(
                [pa.array([at.tobytes()], pa.binary()), *(pa.array([np.ascontiguousarray(got[k]).tobytes()], pa.binary()) for k in SUBTREE)],
                ["names", *SUBTREE])

        for batch in batches:
            for row in batch.to_pylist():
                if row["node"] != last:
                    if rows >= batch_rows:
                        yield done()
                        for held_list in (names, x, v, w, group):
                            held_list.clear()
                        rows = 0
                    last = row["node"]
                    names.append(last)
                x.append(np.frombuffer(row["x"], np.uint8).reshape(-1, p))
                v.append(np.frombuffer(row["v"], VALUE_TYPE[kind]).astype(float))
                w.append(np.frombuffer(row["w"], np.float32).astype(float) if row["w"] else np.ones(len(v[-1])))
                group.append(np.full(len(v[-1]), len(names) - 1))
                rows += len(v[-1])
        if names:
            yield done()

    got = (
        blocks.mapInArrow(send, "node bigint, x binary, v binary, w binary").repartition("node").sortWithinPartitions("node")
        .mapInArrow(finish, "names binary, " + ", ".join(f"{k} binary" for k in SUBTREE)).toArrow()
    )
    news: dict[str, list] = {k: [] for k in ("tree", "feature", "cut", "left", "depth", "path", "stats")}
    start = len(part.feature)
    for row in got.to_pylist():
        at = np.frombuffer(row["names"], np.int64)
        n = len(at)
        v = {k: np.frombuffer(row[k], float if k == "stats" else np.int64) for k in SUBTREE}
        stats = v["stats"].reshape(-1, width)
        # The start nodes exist already; the others follow in one run, so their numbers move by one distance.
        left = np.where(v["left"] >= 0, v["left"] - n + start, -1)
        part.feature[at], part.cut[at], part.left[at], part.stats[at] = v["feature"][:n], v["cut"][:n], left[:n], stats[:n]
        start += len(stats) - n
        for k, values in (("tree", part.tree[at][v["group"]]), ("feature", v["feature"]), ("cut", v["cut"]), ("left", left), ("depth", v["depth"]),
                          ("path", np.zeros(len(stats), np.uint64)), ("stats", stats)):
            news[k].append(values[n:])
    if news["tree"]:
        part.add(**{k: np.concatenate(v) for k, v in news.items()})


SUBTREE = ("group", "feature", "cut", "left", "depth", "stats")


# --- scoring -----------------------------------------------------------------------------------------------------


def share_column(spark, forest: Forest, edges: Sequence[np.ndarray], columns: Sequence[str], end: np.ndarray | None = None) -> Column:
    """Class shares averaged over all trees, as an array column over the raw ``columns``."""
    shares = forest.shares()
    held = spark.sparkContext.broadcast((forest, edges, shares if end is None else shares[end]))

    @F.pandas_udf("array<double>")
    def score(points: pd.DataFrame) -> pd.Series:
        forest, edges, shares = held.value
        if not len(points):
            return pd.Series([], dtype=object)
        x = binned(points.to_numpy(float), edges)
        out = np.zeros((len(x), shares.shape[1]))
        step = max(1, (1 << 20) // max(len(x), 1))
        for at in range(0, len(forest.root), step):
            trees = np.arange(at, min(at + step, len(forest.root)))
            out += shares[forest.leaves(x, trees)].sum(axis=1)
        return pd.Series(list(out / len(forest.root)))

    return score(F.struct(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)]))


def share_sums(spark, forest: Forest, edges: Sequence[np.ndarray], columns: Sequence[str], sums: Column) -> Column:
    """``sums`` of the class shares of earlier trees, with those of this forest added one tree after another."""
    held = spark.sparkContext.broadcast((forest, edges, forest.shares()))

    @F.pandas_udf("array<double>")
    def add(points: pd.DataFrame, before: pd.Series) -> pd.Series:
        forest, edges, shares = held.value
        if not len(points):
            return pd.Series([], dtype=object)
        x, out = binned(points.to_numpy(float), edges), np.vstack(before.to_list())
        step = max(1, (1 << 20) // len(x))
        for at in range(0, len(forest.root), step):
            trees = np.arange(at, min(at + step, len(forest.root)))
            out = np.concatenate([out[:, None], shares[forest.leaves(x, trees)]], axis=1).sum(axis=1)
        return pd.Series(list(out))

    return add(F.struct(*[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)]), sums)


def hits(
    blocks: DataFrame, forest: Forest, frames: Sequence[int], sizes: Sequence[int], cuts: Sequence[tuple[int, int]], p: int,
) -> np.ndarray:
    """Right guesses on the left-out folds: (fold, cut, size), where ``sizes`` are numbers of leading trees.

    ``frames`` gives the fold each tree left out; a cut is (depth, smallest split).
    """
    shares = forest.shares()
    tables = [shares[forest.ends("class", *c)] for c in cuts]
    of_fold = {int(f): np.flatnonzero(np.asarray(frames) == f) for f in sorted(set(frames))}
    held = blocks.sparkSession.sparkContext.broadcast((forest, tables, of_fold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, tables, of_fold = held.value
        total = np.zeros((len(of_fold), len(tables), len(sizes)), np.int64)
        for block in blocks_of(batches, p):
            for f, (fold, trees) in enumerate(of_fold.items()):
                rows = np.flatnonzero(block.fold == fold)
                if not len(rows):
                    continue
                leaf = forest.leaves(block.x[rows], trees)
                for c, table in enumerate(tables):
                    votes, at = np.zeros((len(rows), table.shape[1])), 0
                    for s, size in enumerate(sizes):
                        votes += table[leaf[:, at:size]].sum(axis=1)
                        at = size
                        # Shares are rounded so that sums in another order tie alike.
                        total[f, c, s] += int((np.argmax(np.round(votes, 9), axis=1) == block.y[rows]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["n"])

    out = np.zeros((len(of_fold), len(cuts), len(sizes)), np.int64)
    for row in blocks.mapInArrow(run, "n binary").toLocalIterator():
        out += np.frombuffer(row.n, np.int64).reshape(out.shape)
    return out
