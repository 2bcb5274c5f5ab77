import numpy as np
import pytest
from pyspark.sql import functions as F

from colonnade.operators import cluster, density, neighbors


def _points(seed=5, n=240, d=2):
    """Two dense groups, a bridge, noise, and a third of the rows on one spot."""
    rng = np.random.default_rng(seed)
    spots = np.concatenate([
        rng.normal(0, 0.3, (n // 4, d)), rng.normal(3, 0.3, (n // 4, d)), rng.uniform(-4, 8, (n // 6, d)),
        np.tile([[1.0] * d], (n - 2 * (n // 4) - n // 6, 1))])
    return np.round(spots, 3)


def _frame(spark, x):
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in names))
    return df.withColumn("features", neighbors.feature_array(names)), names


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("block", [16, 512])
@pytest.mark.parametrize("d", [2, 5])
def test_knn_join_is_exact(spark, p, block, d):
    x = _points(d=d)
    df, _ = _frame(spark, x)
    got = neighbors.knn_join(df.repartition(3), df, 4, p=p, block_rows=block).toPandas().sort_values(["id", "rank"])
    dist = neighbors.distances(x, x, p)
    want = np.argsort(dist, axis=1, kind="stable")[:, :4]
    assert (got["neighbor"].to_numpy().reshape(-1, 4) == want).all()
    np.testing.assert_array_equal(got["distance"].to_numpy().reshape(-1, 4), np.take_along_axis(dist, want, 1))


def test_knn_join_within_groups_and_few_rows(spark):
    x = _points(n=60)
    df, _ = _frame(spark, x)
    df = df.withColumn("g", F.when(F.col("id") < 3, "small").otherwise("big"))
    got = neighbors.knn_join(df, df, 5, within="g", block_rows=8).toPandas()
    assert (got[got.id < 3].groupby("id").size() == 3).all() and got[got.id < 3].neighbor.max() < 3
    assert (got[got.id >= 3].groupby("id").size() == 5).all() and got[got.id >= 3].neighbor.min() >= 3


def test_knn_self_leaves_the_row_out(spark):
    x = _points(n=100)
    df, _ = _frame(spark, x)
    got = neighbors.knn_self(df, 3, block_rows=16).toPandas().sort_values(["id", "rank"])
    dist = neighbors.distances(x, x, 2)
    np.fill_diagonal(dist, np.inf)
    want = np.argsort(dist, axis=1, kind="stable")[:, :3]
    assert (got["neighbor"].to_numpy().reshape(-1, 3) == want).all()


def test_distance_votes_follow_touching_neighbours(spark):
    train = spark.createDataFrame([(1, "a", [0.0]), (2, "b", [1.0]), (3, "b", [1.1])], "id long, y string, features array<double>")
    ask = spark.createDataFrame([(9, [0.0]), (8, [0.6])], "id long, features array<double>")
    got = neighbors.knn_classify(ask, train, "y", [3], weights=["uniform", "distance"]).collect()
    assert {(r.id, r.weights): r.prediction for r in got} == {
        (9, "uniform"): "b", (9, "distance"): "a", (8, "uniform"): "b", (8, "distance"): "b"}


def test_smote_points_lie_between_rows_of_the_class(spark):
    x = _points()
    df, names = _frame(spark, x)
    df = df.withColumn("y", F.when(F.col("id") < 30, "rare").when(F.col("id") == 239, "single").otherwise("many"))
    out = neighbors.smote(df, "y", names, block_rows=16).toPandas()
    assert set(out.groupby("y").size()) == {209}
    made = out[out.base.notna()]
    label = {r.id: r.y for r in df.select("id", "y").collect()}
    a, b = x[made.base.astype(int)], x[made.other.astype(int)]
    np.testing.assert_allclose(made[names].to_numpy(), a + made.gap.to_numpy()[:, None] * (b - a), atol=1e-12)
    assert all(label[i] == y and label[j] == y for i, j, y in zip(made.base, made.other, made.y))
    assert (made[made.y == "rare"].base != made[made.y == "rare"].other).all()


def brute_dbscan(x, eps, least):
    gap = sum((x[:, i][:, None] - x[:, i][None, :]) ** 2 for i in range(x.shape[1]))
    near = gap <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                for v in np.nonzero(near[todo.pop()] & core)[0]:
                    if label[v] < 0:
                        label[v] = i
                        todo.append(v)
    for i in np.nonzero(~core)[0]:
        around = label[near[i] & core]
        label[i] = around.min() if len(around) else -1
    return label


@pytest.mark.parametrize("d,eps,least,hot", [(1, 0.05, 4, 20_000), (2, 0.35, 5, 20_000), (2, 0.35, 5, 3), (3, 0.6, 6, 20_000), (5, 1.3, 5, 4)])
def test_dbscan_equals_brute_force(spark, d, eps, least, hot, monkeypatch):
    monkeypatch.setattr(density, "HOT_CELL_POINTS", hot)
    x = _points(d=d)
    df, names = _frame(spark, x)
    want = brute_dbscan(x, eps, least)
    got = density.dbscan(df.repartition(3), "id", names, eps, least).toPandas().sort_values("id")["label"].to_numpy()
    assert (got == want).all() and len(set(want)) > 2
    flags = density.outliers(df, "id", names, eps, least).toPandas().sort_values("id")["outlier"].to_numpy()
    assert (flags == (want == -1)).all()


def test_drop_outliers_keeps_rows_with_nulls(spark):
    df, names = _frame(spark, _points())
    holed = df.withColumn("x0", F.when(F.col("id") != 0, F.col("x0"))).drop("features")
    out = density.drop_outliers(holed, "id", names, 0.3, 5)
    assert out.filter("id = 0").count() == 1 and out.count() < holed.count()


def test_silhouette_euclidean_with_copies_and_blocks(spark):
    x = _points(n=120)
    df, names = _frame(spark, x)
    df = df.withColumn("label", (F.col("id") % 3).cast("int"))
    label, gap, score = np.arange(120) % 3, neighbors.distances(x, x, 2), []
    for i in range(120):
        own = label == label[i]
        a = gap[i, own].sum() / (own.sum() - 1)
        b = min(gap[i, label == c].mean() for c in set(label) - {label[i]})
        score.append((b - a) / max(a, b))
    for block in (4096, 16):
        got = cluster.silhouette_euclidean(df, block_rows=block).first()[0]
        assert got == pytest.approx(np.mean(score), abs=1e-12)


def test_kmeans_finds_two_groups(spark):
    x = np.concatenate([np.random.default_rng(0).normal(m, 0.2, (40, 2)) for m in (0, 5)])
    df, names = _frame(spark, x)
    curve, labels = cluster.kmeans_sweep(df.drop("features"), names, range(2, 5), restarts=2)
    rows = curve.orderBy("k").collect()
    assert [r.k for r in rows if r.best] == [2] and rows[0].wcss > rows[1].wcss > rows[2].wcss
    assert labels.groupBy("cluster").count().count() == 2


@pytest.mark.parametrize("d", [2, 9])
def test_kmeans_models_step_together_as_each_alone(spark, d):
    x = np.random.default_rng(d).normal(0, 1, (300, d))
    x[:40] = x[0]
    df, names = _frame(spark, x)
    blocks = cluster._point_blocks(df.select(F.col("features").alias("x")), 3)
    starts = [x[at : at + k] for k in (2, 5) for at in (50, 120)] + [np.vstack([x[200], x[201] + 1e3])]
    for steps in (3, 100):
        for start, (centers, cost) in zip(starts, cluster.lloyd(blocks, starts, steps, 1e-4)):
            now = start.copy()
            for _ in range(steps):
                gap = ((x[:, None] - now) ** 2).sum(axis=2)
                near, before, want = gap.argmin(axis=1), now.copy(), gap.min(axis=1).sum()
                for c in set(near):
                    now[c] = x[near == c].mean(axis=0)
                if (((now - before) ** 2).sum(axis=1) <= 1e-8).all():
                    break
            np.testing.assert_allclose(centers, now, atol=1e-9)
            assert cost == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("d", [8, 24])
@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_nearest_by_products_equals_distances(d, shift):
    """Inner products only choose candidates: ties, copies and far origins give what plain distances give."""
    rng = np.random.default_rng(d)
    y = np.round(np.concatenate([rng.normal(0, 1, (4500, d)), np.tile(rng.normal(0, 1, (1, d)), (300, 1))]), 1) + shift
    x = np.concatenate([y[::37], rng.normal(0, 1, (40, d)) + shift])
    row, col, value = neighbors.smallest(x, y, 7, 2)
    dist = neighbors.distances(x, y, 2)
    want = np.argsort(dist, axis=1, kind="stable")[:, :7]
    assert (row.reshape(-1, 7) == np.arange(len(x))[:, None]).all() and (col.reshape(-1, 7) == want).all()
    np.testing.assert_array_equal(value.reshape(-1, 7), np.take_along_axis(dist, want, 1))


def test_rows_travel_once_per_large_block(spark):
    """Where every query cell sees all rows, cells are compared together: few copies of each row, many pairs."""
    x = np.random.default_rng(3).normal(0, 1, (1500, 32))
    df, _ = _frame(spark, x)
    t = df.select(F.col("id").alias("_id"), F.lit("").alias("_g"), F.col("features").alias("_x"))
    fine, vectors = neighbors._pivots(t, 8, 2)
    placed = neighbors._placed(t, fine, vectors, 2)
    blocks, plan = neighbors._plans(placed, placed, fine, vectors, 5, 2, 8)
    copies = plan.groupBy("_g", "unit").agg((F.sum("size") * F.first("qn")).alias("n")).agg(F.sum("n")).first()[0]
    assert copies < 30 * len(x) < fine.count() * len(x)
    got = neighbors.knn_join(df, df, 5, block_rows=8).toPandas().sort_values(["id", "rank"])
    want = np.argsort(neighbors.distances(x, x, 2), axis=1, kind="stable")[:, :5]
    assert (got["neighbor"].to_numpy().reshape(-1, 5) == want).all()


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_silhouette_of_many_dimensions(spark, shift):
    """Blocks meet once for both sides; distances by products agree with plain ones, copies and near points included."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 1, (40, 12)) for m in (0, 2)]) + shift
    x[60:70] = x[50] + 1e-4 * rng.normal(0, 1, (10, 12))
    x[5:9] = x[4]
    np.testing.assert_allclose(cluster.far_distances(x, x), neighbors.distances(x, x, 2), rtol=1e-9, atol=1e-12)
    label, gap, score = np.arange(80) // 40, neighbors.distances(x, x, 2), []
    for i in range(80):
        own = label == label[i]
        a = gap[i, own].sum() / (own.sum() - 1)
        b = gap[i, ~own].mean()
        score.append((b - a) / max(a, b))
    df, _ = _frame(spark, x)
    df = df.withColumn("label", F.floor(F.col("id") / 40).cast("int"))
    for block in (None, 16):
        assert cluster.silhouette_euclidean(df, block_rows=block).first()[0] == pytest.approx(np.mean(score), abs=1e-9)


def test_cells_of_many_columns_meet_in_blocks(spark, monkeypatch):
    """More columns than search axes: pairs of cells found in blocks are those of the plain join."""
    rng = np.random.default_rng(8)
    names = [f"x{i}" for i in range(5)]
    rows = np.concatenate([rng.normal(0, 0.2, (60, 5)), rng.normal(1, 0.05, (30, 5)), np.zeros((4, 5))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{c} double" for c in names))
    monkeypatch.setattr(density, "PAIR_CELLS", 7)
    grid = density.Grid(df, "id", names, 0.25, 4)
    keep = lambda pairs: sorted((tuple(r.a.cell), tuple(r.b.cell), r.b.weight) for r in pairs.collect())
    met, calls, inner = keep(grid.cell_pairs(grid.cells, grid.cells)), [], density.Grid._compared
    monkeypatch.setattr(density.Grid, "_compared", lambda self, a, b: (calls.append(1), inner(self, a, b))[1])
    labels = {r.id: r.label for r in density.dbscan(df, "id", names, 0.25, 4).collect()}
    assert calls
    grid.axes = list(range(5))
    monkeypatch.setattr(density, "SEARCH_AXES", 5)
    assert keep(grid.cell_pairs(grid.cells, grid.cells)) == met and len(met) > grid.cells.count()
    assert {r.id: r.label for r in density.dbscan(df, "id", names, 0.25, 4).collect()} == labels
    assert len(set(labels.values())) > 1


def test_blocks_of_few_dimensions_leave_out_boxes_out_of_reach(monkeypatch):
    draw = np.random.default_rng(4)
    x, y = draw.integers(0, 400, (900, 2)).astype(float), draw.integers(0, 400, (6000, 2)).astype(float)
    compared, distances = [], neighbors.distances

    def counted(a, b, p):
        compared.append(len(a) * len(b))
        return distances(a, b, p)

    for p in (1, 2):
        gap = distances(x, y, p)
        want = np.argsort(gap, axis=1, kind="stable")[:, :7]
        with monkeypatch.context() as m:
            m.setattr(neighbors, "distances", counted)
            row, col, value = neighbors.smallest(x, y, 7, p)
        assert (col.reshape(-1, 7) == want).all() and (row == np.repeat(np.arange(900), 7)).all()
        assert (value.reshape(-1, 7) == np.take_along_axis(gap, want, 1)).all()
    assert sum(compared) < 0.5 * 2 * len(x) * len(y)
