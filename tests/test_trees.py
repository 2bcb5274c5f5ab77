"""The histogram tree builder, ensembles and boosting against plain loops."""

import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.models import ensembles, trees
from colonnade.models.frame import make_frame


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 7, n), rng.integers(0, 3, n)], axis=1).astype(float)
    label = np.where(x[:, 0] + x[:, 1] + rng.normal(0, 1.5, n) < 7, "low", np.where(x[:, 0] > 7, "top", "mid"))
    df = spark.createDataFrame([(i, *map(float, x[i]), str(label[i])) for i in range(n)], "id long, a double, b double, c double, y string")
    return make_frame(df, "y", ["a", "b", "c"], "id", folds=3)


@pytest.fixture(scope="module")
def packed(frame):
    return ensembles.Packed(frame.train, frame.columns, fold=F.col("fold"))


def block_of(packed):
    rows = packed.blocks.toArrow()
    parts = list(trees.blocks_of(rows.to_batches(), packed.p))
    return trees.Block(*(np.concatenate([getattr(b, k) for b in parts]) for k in ("x", "y", "fold", "key")))


def impurity(y, w, kind):
    total = w.sum()
    if kind == "variance":
        return float((w * (y - (w * y).sum() / total) ** 2).sum())
    shares = np.bincount(y.astype(int), w) / total
    shares = shares[shares > 0]
    return float(total * (1 - (shares**2).sum()) if kind == "gini" else -total * (shares * np.log(shares)).sum())


def brute(x, y, w, kind, plan, columns, depth=0, stop=0.0):
    """Nested tuples (column, cut, left, right) or the rows' total weight, by trying every cut."""
    n = w.sum()
    pure = len(set(y)) == 1
    if depth >= plan.max_depth or n < plan.min_split or n < 2 * plan.min_leaf or (pure and kind != "variance"):
        return float(n)
    whole, best = impurity(y, w, kind), None
    for j in columns:
        for cut in sorted(set(x[:, j]))[:-1]:
            low = x[:, j] <= cut
            if min(w[low].sum(), w[~low].sum()) < plan.min_leaf:
                continue
            gain = whole - impurity(y[low], w[low], kind) - impurity(y[~low], w[~low], kind)
            if best is None or gain > best[0] + 1e-7 * n:
                best = (gain, j, cut, low)
    if best is None or (kind == "variance" and best[0] <= 1e-7 * n):
        return float(n)
    _, j, cut, low = best
    return j, int(cut), *(brute(x[s], y[s], w[s], kind, plan, columns, depth + 1) for s in (low, ~low))


def shown(forest, node, kind):
    if forest.feature[node] < 0:
        return float(trees.counts_of(forest.stats, kind)[node])
    return int(forest.feature[node]), int(forest.cut[node]), shown(forest, forest.left[node], kind), shown(forest, forest.right[node], kind)


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_trees_equal_brute_force_whichever_way_they_grow(packed, criterion):
    rows = block_of(packed)
    plans = [
        trees.Plan(fold, trees.seed_of("t", i), mean, np.asarray(columns), 0, leaf, split, depth)
        for i, (fold, mean, columns, leaf, split, depth) in enumerate([
            (-2, 0.0, [True] * 3, 1, 2, 30), (0, 0.0, [True] * 3, 5, 2, 30), (1, 1.0, [True] * 3, 1, 12, 30),
            (2, 0.5, [True, False, True], 2, 2, 4), (-2, 1.0, [False, True, True], 1, 2, 2)])
    ]
    found = []
    for local in (0, 40, 10**6):
        forest = trees.grow(packed.blocks, plans, "class", criterion, packed.p, packed.bins, 3, packed.expected if local else lambda q: math.inf, local)
        found.append([shown(forest, r, "class") for r in forest.root])
    assert found[0] == found[1] == found[2]
    for plan, tree in zip(plans, found[0]):
        w = rows.draws(plan.seed, plan.mean) * (rows.fold != plan.fold)
        use = w > 0
        want = brute(rows.x[use].astype(int), rows.y[use], w[use], criterion, plan, np.flatnonzero(plan.columns))
        assert tree == want


def test_regression_trees_equal_brute_force(packed):
    rows = block_of(packed)
    plan = trees.Plan(-2, 7, 1.0, None, 0, 3, 2, 30)
    both = [trees.grow(packed.blocks, [plan], "real", "variance", packed.p, packed.bins, local_rows=n) for n in (0, 10**6)]
    w = rows.draws(7, 1.0)
    use = w > 0
    want = brute(rows.x[use].astype(int), rows.y[use], w[use], "variance", plan, range(3))
    assert [shown(f, f.root[0], "real") for f in both] == [want, want]
    weights = both[0].importance("real", "variance", 3)
    assert weights.sum() == pytest.approx(1.0) and weights[0] > weights[2]


def test_drawn_columns_do_not_depend_on_the_way_of_growing(packed):
    plans = ensembles.forest_plans(packed.p, fold=1, trees=6, min_rows=2)
    assert plans[0].draw == 1
    a, b = (trees.grow(packed.blocks, plans, "class", "gini", packed.p, packed.bins, 3, local_rows=n) for n in (20, 10**6))
    assert [shown(a, r, "class") for r in a.root] == [shown(b, r, "class") for r in b.root]


def test_cutting_a_tree_equals_growing_less(packed):
    full = trees.grow(packed.blocks, [trees.Plan(seed=5, mean=1.0)], "class", "gini", packed.p, packed.bins, 3)
    x = block_of(packed).x
    for depth, split in itertools.product([1, 3, 30], [2, 15]):
        less = trees.grow(packed.blocks, [trees.Plan(seed=5, mean=1.0, max_depth=depth, min_split=split)], "class", "gini", packed.p, packed.bins, 3)
        cut = full.stats[full.ends("class", depth, split)[full.leaves(x, np.arange(1))[:, 0]]]
        assert (cut == less.stats[less.leaves(x, np.arange(1))[:, 0]]).all()


@pytest.mark.parametrize("search,plans,grid,size", [
    (ensembles.random_forest, ensembles.forest_plans, {"trees": [2, 5], "max_depth": [2, 30], "min_split": [2, 9], "min_rows": [1, 3]}, "trees"),
    (ensembles.bagging, ensembles.bagging_plans, {"estimators": [1, 4], "row_share": [0.5, 1.0], "column_share": [0.7], "max_depth": [3, 30]}, "estimators"),
])
def test_one_growth_serves_all_settings(frame, search, plans, grid, size):
    """Every accuracy of the search equals that of single fits."""
    found = {r.params: r.mean_accuracy for r in search(frame, grid).cv.collect()}
    scaled = frame.scaled()
    rows = ensembles.Packed(scaled.train, scaled.columns, fold=F.col("fold"))
    all_rows = block_of(rows)
    assert len(found) == math.prod(map(len, grid.values()))
    for text, accuracy in found.items():
        point = json.loads(text)
        share = 0.0
        for f in range(frame.folds):
            forest = trees.grow(rows.blocks, plans(rows.p, fold=f, **point), "class", "gini", rows.p, rows.bins, 3)
            held = all_rows.fold == f
            votes = forest.shares()[forest.leaves(all_rows.x[held], np.arange(point[size]))].sum(axis=1)
            share += (np.round(votes, 9).argmax(axis=1) == all_rows.y[held]).mean() / frame.folds
        assert accuracy == pytest.approx(share)


def test_driver_holds_the_trees_of_few_folds(frame, monkeypatch):
    grid = {"estimators": [2, 5], "row_share": [1.0], "column_share": [0.7], "max_depth": [3, 30]}
    want, held, grow = sorted(ensembles.bagging(frame, grid).cv.collect()), [], trees.grow
    monkeypatch.setattr(ensembles, "NODES_AT_ONCE", 1)
    monkeypatch.setattr(trees, "grow", lambda blocks, plans, *a: (held.append(len(plans)), grow(blocks, plans, *a))[1])
    assert sorted(ensembles.bagging(frame, grid).cv.collect()) == want
    assert len(held) >= frame.folds and max(held) <= 5


def plain_boosting(x, y, learn, k, rounds, rate, plan):
    """Margins after every round, with a plain regression tree per class."""

    def fitted(rows, g, h, depth):
        n = len(rows)
        if depth < plan.max_depth and n >= plan.min_split and n >= 2 * plan.min_leaf:
            best = None
            for j in range(x.shape[1]):
                for cut in sorted(set(x[rows, j]))[:-1]:
                    low = x[rows, j] <= cut
                    a, b = low.sum(), n - low.sum()
                    if min(a, b) < plan.min_leaf:
                        continue
                    gain = a * b / n * (g[rows[low]].mean() - g[rows[~low]].mean()) ** 2
                    if gain > 1e-9 * n and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = (gain, j, cut, low)
            if best:
                _, j, cut, low = best
                left, right = fitted(rows[low], g, h, depth + 1), fitted(rows[~low], g, h, depth + 1)
                return lambda z: np.where(z[:, j] <= cut, left(z), right(z))
        value = g[rows].sum() / h[rows].sum() * (k - 1) / k * rate
        return lambda z: np.full(len(z), value)

    counts = np.bincount(y[learn].astype(int), minlength=k)
    margins = np.repeat(np.log(counts / counts.sum())[None], len(x), axis=0)
    out = []
    for _ in range(rounds):
        shares = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        g = np.stack([(y == c) - shares[:, c] for c in range(k)], axis=1)
        h = np.abs(g) * (1 - np.abs(g))
        margins = margins + np.stack([fitted(learn, g[:, c], h[:, c], 0)(x) for c in range(k)], axis=1)
        out.append(margins)
    return out


@pytest.mark.parametrize("local", [30, 10**6])
def test_boosting_equals_plain_loops(packed, monkeypatch, local):
    monkeypatch.setattr(trees, "LOCAL_ROWS", local)
    rows = block_of(packed)
    # The last four begin as one line and part, or not, as their trees demand.
    models = [({"rate": 0.3, "max_depth": 2, "min_rows": 3}, 0)] + [
        ({"rate": 0.2, "max_depth": 3, "min_split": split, "min_rows": leaf}, -2) for split, leaf in [(20, 1), (2, 1), (2, 15), (90, 1)]]
    run, got, lines = ensembles.Boosting(packed, 3, models), {}, []

    def at_stage(r, state):
        lines.append(len(run.lines))
        blocks = list(trees.blocks_of(state.toArrow().to_batches(), packed.p, run.shape))
        place = [run.place[m] for m in range(len(models))]
        got[r] = {int(k): m[place] for b in blocks for k, m in zip(b.key, b.margins)}

    run.run([1, 4], at_stage)
    for m, (point, fold) in enumerate(models):
        plan = trees.Plan(fold, min_leaf=point.get("min_rows", 1), min_split=point.get("min_split", 2), max_depth=point["max_depth"])
        want = plain_boosting(rows.x.astype(int), rows.y, np.flatnonzero(rows.fold != fold), 3, 4, point["rate"], plan)
        for r in (1, 4):
            own = np.stack([got[r][int(k)][m] for k in rows.key])
            assert np.abs(own - want[r - 1]).max() < 2e-4
    assert 2 < lines[-1] <= 5


def test_boosting_search_and_scorer(frame):
    grid = {"rounds": [2, 6], "rate": [0.3], "max_depth": [2, 3], "min_split": [2, 4], "min_rows": [1, 4]}
    found = ensembles.boosting(frame, grid)
    assert found.cv.count() == 16
    best = found.params
    scaled = frame.scaled()
    scorer = ensembles.fit_boosting(scaled.train, scaled, **best)
    single = {r.id: r.probability for r in scorer(scaled.data).select("id", "probability").collect()}
    kept = {r.id: r.probability for r in found.predictions.select("id", "probability").collect()}
    assert kept.keys() == single.keys() and len(kept) == frame.data.count()
    # Bins of the search come from the training rows, as do those of the single fit.
    assert max(abs(a - b) for i in kept for a, b in zip(kept[i], single[i])) < 1e-3


def test_draws_go_on_to_double_precision():
    assert len(trees.poisson_bounds(1.0)) > 15
    key = np.arange(200_000, dtype=np.uint64)
    block = trees.Block(np.zeros((len(key), 1), np.uint8), np.zeros(len(key)), np.zeros(len(key), int), key)
    for mean in (0.5, 1.0):
        drawn = block.draws(trees.seed_of("x"), mean)
        assert drawn.mean() == pytest.approx(mean, rel=0.01) and drawn.var() == pytest.approx(mean, rel=0.02)


def test_bins(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("wide"), (F.col("id") % 5).cast("double").alias("few"), F.lit(1.0).alias("one"))
    wide, few, one = trees.bin_edges(df, ["wide", "few", "one"])
    assert few.tolist() == [0.5, 1.5, 2.5, 3.5] and len(one) == 0 and 60 <= len(wide) <= 63
    x = trees.binned(np.asarray([[-5.0, 0.0, 1.0], [999.0, 4.0, 1.0]]), [wide, few, one])
    assert x.tolist() == [[0, 0, 0], [len(wide), 4, 0]]


def test_scoring_holds_few_trees(frame, monkeypatch):
    """A forest of many nodes is scored some trees at a time, with the shares of the whole forest."""
    point = {"trees": 5, "max_depth": 30, "min_rows": 2}
    want = {r.id: r.probability for r in ensembles.fit_forest(frame.train, frame, **point)(frame.data).collect()}
    weights = [tuple(r) for r in ensembles.classification_importance(frame, trees=5).collect()]
    held, shares = [], trees.Forest.shares
    monkeypatch.setattr(trees.Forest, "shares", lambda self: (held.append(len(self.root)), shares(self))[1])
    monkeypatch.setattr(ensembles, "NODES_AT_ONCE", 1)
    scorer = ensembles.fit_forest(frame.train, frame, **point)
    for _ in range(2):
        assert {r.id: r.probability for r in scorer(frame.data).collect()} == want
    assert set(held) == {1} and len(held) == 10
    assert [tuple(r) for r in ensembles.classification_importance(frame, trees=5).collect()] == weights


def test_a_pass_splits_nodes_of_few_trees(frame, packed, monkeypatch):
    plans = ensembles.forest_plans(packed.p, trees=6)
    want = trees.grow(packed.blocks, plans, "class", "gini", packed.p, packed.bins, 3, local_rows=10)
    passes, split = [], trees._split_large
    monkeypatch.setattr(trees, "_split_large", lambda blocks, held, *a: (passes.append(held.value[2][held.value[1]]), split(blocks, held, *a))[1])
    monkeypatch.setattr(trees, "HISTOGRAM_BYTES", 3 * packed.p * packed.bins * 3 * 8)
    got = trees.grow(packed.blocks, plans, "class", "gini", packed.p, packed.bins, 3, local_rows=10)
    x = block_of(packed).x
    for one, other in zip(*[[f.stats[f.leaves(x, np.asarray([t]))[:, 0]] for t in range(6)] for f in (got, want)]):
        assert (one == other).all()
    assert len(passes) > 6 and all((np.diff(own) >= 0).all() for own in passes)
    # Within a level the passes go on where the one before ended.
    again = [own[0] < before[-1] for before, own in zip(passes, passes[1:])]
    assert sum(again) <= want.depth.max()


def test_finishing_subtrees_holds_few_sums():
    import tracemalloc

    rng = np.random.default_rng(1)
    n, p = 1 << 17, 20
    x, y = rng.integers(0, 64, (n, p)).astype(np.uint8), rng.integers(0, 3, n).astype(float)
    rule, at = trees.Nodes([trees.Plan()] * 16, "class", "gini", p), np.arange(16)
    tracemalloc.start()
    try:
        trees.grow_here(rule, 64, x, trees.row_stats(y, np.ones(n), "class", 3), np.arange(n) // 8192, at, at * 0, at.astype(np.uint64))
        assert tracemalloc.get_traced_memory()[1] < 300e6
    finally:
        tracemalloc.stop()
