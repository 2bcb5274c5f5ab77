"""Exact nearest-neighbour join and what is built on it: k-distance curve, kNN classes, SMOTE.

Points go to cells around pivots of two levels, both as numerous as the rows ask for: a coarse one, whose number grows
with the square root of the rows, and the fine ones near it. Sizes and radii of cells are small tables. Joining them,
coarse cells first and then the fine ones of the coarse pairs that are left, gives by the triangle inequality a radius
that holds k neighbours of every query of a cell; only rows that reach into that radius are compared. Cells are cut
into blocks, identical points are merged before (keeping the k smallest ids, the only ones a tie rule can pick), and
every task returns at most k rows per query. Ties in distance go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.operators.ordering import hash_bucket, ranked
from colonnade.operators.sampling import SEED, class_counts, class_draws, digest, draw, unit_draw
from colonnade.session import cut_lineage, spread

BLOCK_ROWS = 512

# Rows whose fine cells one group of the assignment looks up.
ASSIGN_ROWS = 1 << 14

# Most rows of either side of a block of comparisons, and their vectors' bytes. Every row travels once per block of the
# other side, so larger blocks move less.
SIDE_ROWS, SIDE_BYTES = 1 << 15, 16 << 20

# Query cells of a coarse cell are compared as one where that makes at most this many times the comparisons.
JOINED_WORK = 1.25

# From this many dimensions on, inner products tell which rows can be among the nearest.
PRODUCT_DIMENSIONS = 8

# In fewer, rows of a block are put into boxes of so many neighbouring rows, and boxes out of reach are left out. A query
# then costs about the same whatever the number of train rows, so blocks hold as many of these as memory allows.
BOX_ROWS, BOXED_ROWS = 64, 1 << 17


def distances(x: np.ndarray, y: np.ndarray, p: int) -> np.ndarray:
    """Pairwise Manhattan (p=1) or Euclidean (p=2) distances, summed one dimension at a time."""
    total, gap = np.zeros((len(x), len(y))), np.empty((len(x), len(y)))
    for i in range(x.shape[1]):
        np.subtract(x[:, i][:, None], y[:, i][None, :], out=gap)
        total += np.abs(gap, out=gap) if p == 1 else np.multiply(gap, gap, out=gap)
    return total if p == 1 else np.sqrt(total, out=total)


def smallest(x: np.ndarray, y: np.ndarray, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of the k nearest rows of ``y`` to each row of ``x``, by distance and then place in y."""
    top = min(k, len(y))
    if p == 2 and x.shape[1] >= PRODUCT_DIMENSIONS:
        row, col, value = _by_products(x, y, top)
    else:
        row, col, value = (_by_boxes if x.shape[1] < PRODUCT_DIMENSIONS else _by_distances)(x, y, top, p)
    order = np.lexsort((col, value, row))
    row, col, value = row[order], col[order], value[order]
    keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(x)))[row] < top
    return row[keep], col[keep], value[keep]


def _by_distances(x: np.ndarray, y: np.ndarray, top: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = []
    step = min(128, max(1, (1 << 22) // max(len(y), 1)))  # a slice of some megabytes
    for start in range(0, len(x), step):
        d = distances(x[start:start + step], y, p)
        row, col = np.nonzero(d <= np.partition(d, top - 1, axis=1)[:, top - 1:top])
        found.append((row + start, col, d[row, col]))
    return tuple(np.concatenate(v) for v in zip(*found))


def _boxes(y: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, start, low, high): rows in an order where runs of at most ``size`` lie close together, and their boxes.

    Every run is halved in its widest dimension until the runs are short enough.
    """
    order, start = np.arange(len(y)), np.zeros(1, np.int64)
    while True:
        rows = y[order]
        low, high = np.minimum.reduceat(rows, start, axis=0), np.maximum.reduceat(rows, start, axis=0)
        count = np.diff(np.append(start, len(y)))
        if count.max() <= size:
            return order, start, low, high
        run = np.repeat(np.arange(len(start)), count)
        order = order[np.lexsort((rows[np.arange(len(y)), (high - low).argmax(axis=1)[run]], run))]
        # Halves of a run of one row would be empty; runs differ by one row at most, so there is none.
        start = np.stack([start, start + count // 2], axis=1).ravel()


def _by_boxes(x: np.ndarray, y: np.ndarray, top: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries of a box look at the nearest boxes of ``y`` first, then at those that their farthest candidate leaves open."""
    large = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
    if len(y) <= max(8 * BOX_ROWS, 4 * top) or not large < 1e150:
        return _by_distances(x, y, top, p)
    q_order, q_start, q_low, q_high = _boxes(x, BOX_ROWS)
    order, start, low, high = _boxes(y, BOX_ROWS)
    x, y = x[q_order], y[order]
    stop = np.append(start[1:], len(y))
    first = -(-top // int((stop - start).min())) + 1
    found = []
    for a, b, q_from, q_to in zip(q_start, np.append(q_start[1:], len(x)), q_low, q_high):
        gap = np.maximum(np.maximum(low - q_to, q_from - high), 0.0)
        least = gap.sum(axis=1) if p == 1 else np.sqrt((gap * gap).sum(axis=1))
        near = np.argpartition(least, min(first, len(least) - 1))[:first]
        rows = _ranges(start[near], stop[near])
        limit = np.partition(distances(x[a:b], y[rows], p), top - 1, axis=1)[:, top - 1].max()
        near = np.flatnonzero(least <= limit * (1 + 1e-9) + 1e-300)
        rows = _ranges(start[near], stop[near])
        d = distances(x[a:b], y[rows], p)
        row, col = np.nonzero(d <= np.partition(d, top - 1, axis=1)[:, top - 1:top])
        found.append((q_order[row + a], order[rows[col]], d[row, col]))
    return tuple(np.concatenate(v) for v in zip(*found))


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    size = stop - start
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _by_products(x: np.ndarray, y: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates by inner products with room for their rounding; the distances of these are those of ``distances``."""
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    if not np.isfinite(xx.max() + yy.max()) or xx.max() + yy.max() > 1e300:
        return _by_distances(x, y, top, 2)
    room = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + yy.max()) + 1e-300
    found = []
    for start in range(0, len(x), 256):
        a, slack, parts = x[start:start + 256], room[start:start + 256, None], []
        limit = np.full((len(a), 1), np.inf)
        for at in range(0, len(y), 4096):
            d = yy[None, at:at + 4096] - 2 * (a @ y[at:at + 4096].T)
            if at == 0 and d.shape[1] >= top:
                limit = np.partition(d, top - 1, axis=1)[:, top - 1:top] + slack
            row, col = np.nonzero(d <= limit)
            parts.append((row, col + at, d[row, col]))
        row, col, value = (np.concatenate(v) for v in zip(*parts))
        order = np.lexsort((value, row))
        row, col, value = row[order], col[order], value[order]
        last = value[np.searchsorted(row, np.arange(len(a))) + top - 1] + slack[:, 0]
        keep = value <= last[row]
        row, col = row[keep], col[keep]
        total = np.zeros(len(row))
        for i in range(x.shape[1]):
            gap = a[row, i] - y[col, i]
            total += gap * gap
        found.append((row + start, col, np.sqrt(total)))
    return tuple(np.concatenate(v) for v in zip(*found))


def feature_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in columns])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_list()) if len(column) else np.zeros((0, 0))


def _nearest(x: np.ndarray, pivots: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    at, r = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for start in range(0, len(x), 256):
        d = distances(x[start:start + 256], pivots, p)
        best = d.argmin(axis=1)
        at[start:start + 256] = best
        r[start:start + 256] = d[np.arange(len(d)), best]
    return at, r


def _coarse(pivots: np.ndarray, p: int):
    @F.pandas_udf("coarse int, rc double")
    def nearest(points: pd.Series) -> pd.DataFrame:
        if not len(points):
            return pd.DataFrame({"coarse": pd.Series(dtype="int32"), "rc": pd.Series(dtype="float64")})
        at, r = _nearest(_matrix(points), pivots, p)
        return pd.DataFrame({"coarse": at.astype(np.int32), "rc": r})

    return nearest


def _pivots(t: DataFrame, block_rows: int, p: int) -> tuple[DataFrame, np.ndarray]:
    """(coarse, cell, vector) of the fine pivots, about one per ``block_rows`` rows, and the vectors of the coarse ones.

    The coarse pivots are as many as the square root of the fine ones, and fine pivots themselves; they alone are
    collected and sent to all tasks.
    """
    points = t.select("_x").distinct()
    hashed = F.pmod(F.xxhash64("_x", F.lit(SEED)), F.lit(1 << 30))
    share = min(1.0, 1.0 / block_rows)
    fine = cut_lineage(points.filter(hashed < int(share * (1 << 30))))
    found = fine.count()
    if not found:
        fine, found = cut_lineage(points.orderBy(hashed, "_x").limit(1)), 1
    first = fine.orderBy(F.xxhash64("_x", F.lit(SEED + 1)), "_x").limit(math.ceil(math.sqrt(found))).collect()
    vectors = np.array([r["_x"] for r in first], dtype=float)
    placed = fine.withColumn("_n", _coarse(vectors, p)("_x")).select("_n.coarse", F.monotonically_increasing_id().alias("cell"), F.col("_x").alias("vector"))
    return cut_lineage(placed), vectors


def _placed(points: DataFrame, fine: DataFrame, vectors: np.ndarray, p: int) -> DataFrame:
    """``points`` (_id, _g, _x) with coarse, rc (distance to the coarse pivot), cell and r (to the fine pivot).

    A row looks only at the fine pivots of its coarse cell; any choice of cell gives right answers. Coarse cells of
    many rows are dealt out over several groups.
    """
    kept = cut_lineage(points.withColumn("_n", _coarse(vectors, p)("_x")).select("_id", "_g", "_x", "_n.coarse", "_n.rc"))
    parts = kept.groupBy("coarse").agg(F.ceil(F.count(F.lit(1)) / ASSIGN_ROWS).cast("int").alias("parts"))
    left = kept.join(F.broadcast(parts), "coarse").withColumn("part", F.pmod(F.xxhash64("_x"), F.col("parts")).cast("int")).drop("parts")
    right = fine.join(F.broadcast(parts), "coarse").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def assign(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"_id": [], "_g": [], "_x": [], "coarse": [], "rc": [], "cell": [], "r": []})
        at, r = _nearest(_matrix(rows["_x"]), _matrix(pivots["vector"]), p)
        return rows[["_id", "_g", "_x", "coarse", "rc"]].assign(cell=pivots["cell"].to_numpy()[at], r=r)

    form = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", cell bigint, r double"
    return cut_lineage(left.groupBy("coarse", "part").cogroup(right.groupBy("coarse", "part")).applyInPandas(assign, form))


def _gap(a: str, b: str, p: int) -> Column:
    """Distance between two vector columns."""
    steps = F.zip_with(a, b, lambda x, y: F.abs(x - y) if p == 1 else (x - y) * (x - y))
    total = F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)
    return total if p == 1 else F.sqrt(total)


def _reach(pairs: DataFrame, keys: Sequence[str], count: str, k: int) -> DataFrame:
    """(keys..., reach): the smallest ``upper`` within which ``count`` adds up to k rows; null if there are fewer."""
    so_far = F.sum(count).over(Window.partitionBy(*keys).orderBy("upper").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return pairs.withColumn("_seen", so_far).groupBy(*keys).agg(F.min(F.when(F.col("_seen") >= k, F.col("upper"))).alias("reach"))


def _within(reach: str) -> Column:
    """The radius with room for rounding; without k rows every distance is in reach."""
    return F.coalesce(F.col(reach) * (1 + 1e-9) + 1e-12, F.lit(math.inf))


def _plans(q: DataFrame, t: DataFrame, fine: DataFrame, vectors: np.ndarray, k: int, p: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Which train rows each query cell must see, as joined tables of cells.

    A unit is a query cell, or those of a coarse cell together where they see nearly the same rows or boxes of rows are
    searched. Returns (_g, qc,
    unit, qn, tn): the unit of each query cell, its blocks and those of the train rows it sees; and (_g, unit, tc, low,
    high, before, size, qn, tn): train rows of cell tc at a distance from its pivot between low and high can be a
    k-nearest neighbour, and take the places from ``before`` on among those of the unit.
    """
    spark = q.sparkSession
    pivot = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "coarse int, vector array<double>")
    outer_q = q.groupBy("_g", "coarse").agg(F.max("rc").alias("rq")).join(F.broadcast(pivot), "coarse").withColumnsRenamed({"coarse": "qo", "vector": "v"})
    outer_t = t.groupBy("_g", "coarse").agg(F.max("rc").alias("rt"), F.count(F.lit(1)).alias("n")).join(F.broadcast(pivot), "coarse").withColumnsRenamed(
        {"coarse": "to", "vector": "w"})
    wide = cut_lineage(outer_q.join(outer_t, "_g").withColumn("gap", _gap("v", "w", p)).drop("v", "w").withColumn("upper", F.expr("gap + rq + rt")))
    wide = wide.join(_reach(wide, ["_g", "qo"], "n", k), ["_g", "qo"]).filter(F.expr("gap - rq - rt") <= _within("reach")).select("_g", "qo", "to")

    cells_q = q.groupBy("_g", "coarse", "cell").agg(F.max("r").alias("rq"), F.count(F.lit(1)).alias("nq")).join(fine.drop("coarse"), "cell").select(
        "_g", F.col("coarse").alias("qo"), F.col("cell").alias("qc"), "rq", "nq", F.col("vector").alias("v"))
    # Rows of a cell by classes of their distance to its pivot.
    ring = F.floor(F.log2(F.greatest(F.col("r"), F.lit(1e-9))) * 2)
    rings = t.groupBy("_g", "coarse", "cell", ring.alias("ring")).agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"))
    cells_t = rings.groupBy("_g", "coarse", "cell").agg(
        F.collect_list(F.struct("n", "r")).alias("rings"), F.sum("n").alias("size"), F.max("r").alias("widest")
    ).join(fine.drop("coarse"), "cell").select("_g", F.col("coarse").alias("to"), F.col("cell").alias("tc"), "rings", "size", "widest", F.col("vector").alias("w"))
    pairs = cut_lineage(
        cells_q.join(wide, ["_g", "qo"]).join(cells_t, ["_g", "to"]).withColumn("gap", _gap("v", "w", p))
        .select("_g", "qo", "qc", "rq", "nq", "tc", "rings", "size", "widest", "gap"))
    opened = pairs.select("_g", "qc", "gap", "rq", F.explode("rings").alias("ring")).select(
        "_g", "qc", (F.col("gap") + F.col("rq") + F.col("ring.r")).alias("upper"), F.col("ring.n").alias("n"))
    near = cut_lineage(
        pairs.drop("rings").join(_reach(opened, ["_g", "qc"], "n", k), ["_g", "qc"]).withColumn("reach", _within("reach"))
        .filter(F.expr("gap - rq - widest") <= F.col("reach"))
        .select("_g", "qo", "qc", "nq", "tc", "size", F.expr("gap - rq - reach").alias("low"), F.expr("gap + rq + reach").alias("high")))

    # Query cells that see nearly the same rows become one unit.
    boxed = vectors.shape[1] < PRODUCT_DIMENSIONS
    each = near.groupBy("_g", "qo", "qc").agg(F.sum("size").alias("seen"), F.first("nq").alias("nq"))
    alone = each.groupBy("_g", "qo").agg(F.sum(F.col("nq").cast("double") * F.col("seen")).alias("work"), F.sum("nq").alias("rows"))
    union = near.select("_g", "qo", "tc", "size").distinct().groupBy("_g", "qo").agg(F.sum("size").alias("all"))
    joined = alone.join(union, ["_g", "qo"]).select(
        "_g", "qo", (F.lit(boxed) | (F.col("rows").cast("double") * F.col("all") <= JOINED_WORK * F.col("work"))).alias("one"))
    units = cut_lineage(each.join(joined, ["_g", "qo"]).select(
        "_g", "qc", "nq", F.when(F.col("one"), -1 - F.col("qo").cast("bigint")).otherwise(F.col("qc")).alias("unit")))
    seen = near.drop("nq").join(units.drop("nq"), ["_g", "qc"]).groupBy("_g", "unit", "tc").agg(
        F.first("size").alias("size"), F.min("low").alias("low"), F.max("high").alias("high"))
    order = Window.partitionBy("_g", "unit").orderBy("tc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = cut_lineage(seen.select("_g", "unit", "tc", "low", "high", (F.sum("size").over(order) - F.col("size")).alias("before"), "size"))
    sizes = cut_lineage(
        plan.groupBy("_g", "unit").agg(F.max(F.col("before") + F.col("size")).alias("rows"))
        .join(units.groupBy("_g", "unit").agg(F.sum("nq").alias("nq")), ["_g", "unit"]))
    tasks, width = 4 * spark.sparkContext.defaultParallelism, 8 * max(1, vectors.shape[1])
    # Blocks are large, but enough of them for all cores.
    if boxed:
        most = min(BOXED_ROWS, SIDE_BYTES // width)
        queries = sizes.agg(F.sum("nq")).first()[0] or 0
        query_rows, train_rows = max(2 * block_rows, min(most, queries // tasks)), max(8 * block_rows, most)
    else:
        work = sizes.agg(F.sum(F.col("nq").cast("double") * F.col("rows"))).first()[0] or 0.0
        side = min(SIDE_ROWS, SIDE_BYTES // width, int(math.sqrt(work / tasks)))
        query_rows, train_rows = max(2 * block_rows, side), max(8 * block_rows, side)
    parts = sizes.select(
        "_g", "unit", F.ceil(F.col("nq") / query_rows).cast("int").alias("qn"), F.ceil(F.col("rows") / train_rows).cast("int").alias("tn"))
    blocks = cut_lineage(parts.join(units.drop("nq"), ["_g", "unit"]))
    return blocks, plan.join(parts, ["_g", "unit"])


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    id_col: str = "id",
    features: str = "features",
    p: int = 2,
    within: str | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, rank, neighbor, distance): the k nearest train rows of every query row, exactly.

    With ``within`` only rows with the same value of that column are compared. An id may occur once per
    value of ``within``.
    """
    spark = queries.sparkSession
    group = F.col(within).cast("string") if within else F.lit("")
    q_all = queries.select(F.col(id_col).alias("_id"), group.alias("_g"), F.col(features).alias("_x"))
    t_all = train.select(F.col(id_col).alias("_id"), group.alias("_g"), F.col(features).alias("_x"))
    same = Window.partitionBy("_g", "_x").orderBy("_id")
    t = t_all.withColumn("_c", F.row_number().over(same)).filter(F.col("_c") <= k).drop("_c")
    q = q_all.groupBy("_g", "_x").agg(F.min("_id").alias("_id"))
    t = cut_lineage(t)
    id_type = train.schema[id_col].dataType.simpleString()
    if t.isEmpty():
        return spark.createDataFrame([], f"{id_col} {id_type}, rank int, neighbor {id_type}, distance double")
    fine, vectors = _pivots(t, block_rows, p)
    t = _placed(t, fine, vectors, p)
    if queries is train:  # the queries are among the placed rows
        places = ("coarse", "rc", "cell", "r")
        q = cut_lineage(t.groupBy("_g", "_x").agg(F.min("_id").alias("_id"), *[F.first(c).alias(c) for c in places]))
    else:
        q = _placed(q, fine, vectors, p)
    q_plan, t_plan = _plans(q, t, fine, vectors, k, p, block_rows)
    place = F.col("before") + F.pmod(F.xxhash64("_x"), F.col("size"))
    left = (
        spread(q).withColumnRenamed("cell", "qc").join(spread(q_plan), ["_g", "qc"])
        .select("_g", "unit", F.pmod(F.xxhash64("_x"), F.col("qn")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("tn") - 1)).alias("tb"), "_id", "_x")
    )
    right = (
        spread(t).withColumnRenamed("cell", "tc").join(spread(t_plan), ["_g", "tc"])
        .filter(F.col("r").between(F.col("low"), F.col("high")))
        .select("_g", "unit", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)).alias("qb"), F.pmod(place, F.col("tn")).cast("int").alias("tb"), "_id", "_x")
    )
    keys = ["_g", "unit", "qb", "tb"]

    def nearest_in_block(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ts):
            return pd.DataFrame({"_q": [], "neighbor": [], "distance": []})
        ts = ts.sort_values("_id", kind="stable")
        y, t_ids, q_ids = _matrix(ts["_x"]), ts["_id"].to_numpy(), qs["_id"].to_numpy()
        row, col, value = smallest(_matrix(qs["_x"]), y, k, p)
        return pd.DataFrame({"_q": q_ids[row], "neighbor": t_ids[col], "distance": value})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        nearest_in_block, f"_q {id_type}, neighbor {id_type}, distance double"
    )
    order = Window.partitionBy("_q").orderBy("distance", "neighbor")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    owners = q_all.join(q.select("_g", "_x", F.col("_id").alias("_q")), ["_g", "_x"]).select("_id", "_q")
    return owners.join(best, "_q").select(F.col("_id").alias(id_col), "rank", "neighbor", "distance")


def knn_self(df: DataFrame, k: int, id_col: str = "id", features: str = "features", p: int = 2,
             within: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """k nearest other rows of every row."""
    wide = knn_join(df, df, k + 1, id_col, features, p, within, block_rows).filter(F.col("neighbor") != F.col(id_col))
    order = Window.partitionBy(id_col).orderBy("rank")
    return wide.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def k_distance(df: DataFrame, k: int, id_col: str = "id", features: str = "features", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(position, id, distance): distance to the k-th neighbour, self counted first, ascending."""
    last = knn_join(df, df, k, id_col, features, block_rows=block_rows).filter(F.col("rank") == k)
    curve = cut_lineage(last.select(id_col, "distance"))  # read three times by the ranking
    return ranked(curve, [("distance", True), (id_col, True)], "position")


def _neighbor_lists(neighbors: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """One row per query with its neighbours by rank; at most k entries each."""
    known = labels.select(F.col(id_col).alias("neighbor"), F.col(label).cast("string").alias("_l"))
    return neighbors.join(known, "neighbor").groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("rank", "distance", F.col("_l").alias("label")))).alias("near")
    )


def class_votes(k: Column, weights: Column, classes: Sequence[str]) -> Column:
    """Vote per class among the first k entries of ``near``, in class order.

    'distance' weighs by 1/distance; neighbours at distance 0 then outvote all others.
    """
    def once(value: Column, use) -> Column:
        """``use`` of a value that is worked out once a row, not again for every element it is compared with."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def weigh(n: Column, touching: Column) -> Column:
        near = F.when(touching, (n["distance"] == 0.0).cast("double")).otherwise(
            F.coalesce(F.try_divide(F.lit(1.0), n["distance"]), F.lit(0.0))
        )
        return F.when(weights == "uniform", F.lit(1.0)).otherwise(near)

    def weighed(first: Column) -> Column:
        return once(
            F.exists(first, lambda n: n["distance"] == 0.0),
            lambda touching: F.transform(first, lambda n: F.struct(n["label"].alias("label"), weigh(n, touching).alias("w"))))

    return once(once(F.slice("near", 1, k), weighed), lambda votes: F.transform(
        F.array(*[F.lit(c) for c in classes]),
        lambda c: F.aggregate(votes, F.lit(0.0), lambda a, n: a + F.when(n["label"] == c, n["w"]).otherwise(0.0)),
    ))


def vote_winner(votes: Column, classes: Sequence[str]) -> Column:
    """Class with the most votes; the first class wins a tie."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(votes, F.array_max(votes)).cast("int"))


def knn_classify(
    queries: DataFrame, train: DataFrame, label: str, ks: Sequence[int], id_col: str = "id", features: str = "features",
    weights: Sequence[str] = ("uniform",), p: int = 2, within: str | None = None,
) -> DataFrame:
    """(id, k, weights, prediction, votes) for every k and weighting, from one neighbour join."""
    classes = sorted(str(c) for c in class_counts(train, label))
    near = _neighbor_lists(
        knn_join(queries, train, max(ks), id_col, features, p, within),
        train.select(id_col, label).dropDuplicates([id_col]) if within else train, id_col, label,
    )
    settings = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("weights")) for k in ks for w in weights])
    voted = near.withColumn("s", F.explode(settings)).select(id_col, "near", "s.*")
    return voted.select(
        id_col, "k", "weights", class_votes(F.col("k"), F.col("weights"), classes).alias("votes")
    ).withColumn("prediction", vote_winner(F.col("votes"), classes))


def other_folds(df: DataFrame, folds: int, fold: str = "fold", name: str = "context") -> DataFrame:
    """Copies each row into the training side of every fold but its own."""
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))
    return df.withColumn(name, F.explode(others))


def knn_cv(
    df: DataFrame, label: str, ks: Sequence[int], folds: int = 5, id_col: str = "id", features: str = "features",
    weights: Sequence[str] = ("uniform",), p: int = 2, fold: str = "fold",
) -> DataFrame:
    """(k, weights, p, accuracy): mean fold accuracy; the neighbours of all folds come from one join."""
    rows = df.withColumn("context", F.col(fold))
    voted = knn_classify(rows, other_folds(df, folds, fold), label, ks, id_col, features, weights, p, "context")
    hit = voted.join(df.select(id_col, fold, F.col(label).cast("string").alias("_l")), id_col)
    return (
        hit.groupBy("k", "weights", fold).agg(F.avg((F.col("_l") == F.col("prediction")).cast("double")).alias("a"))
        .groupBy("k", "weights").agg(F.avg("a").alias("accuracy")).withColumn("p", F.lit(p))
    )


def smote(
    df: DataFrame, label: str, columns: Sequence[str], id_col: str = "id", k: int = 5, seed: int = SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds synthetic rows until every class is as large as the largest.

    A synthetic row lies between a drawn row and one of its k nearest rows of the same class. A class of
    one row is copied. ``id`` is null for synthetic rows; ``base``, ``other`` and ``gap`` tell their origin.
    """
    counts = class_counts(df, label)
    top = max(counts.values(), default=0)
    needed = {c: top - n for c, n in counts.items() if n < top}
    origin = [F.lit(None).cast(df.schema[id_col].dataType).alias("base"), F.lit(None).cast(df.schema[id_col].dataType).alias("other"),
              F.lit(None).cast("double").alias("gap")]
    real = df.select(id_col, label, *[F.col(c).cast("double").alias(c) for c in columns], *origin)
    if not needed:
        return real
    small = df.filter(F.col(label).isin(list(needed))).select(F.col(id_col).alias("id"), F.col(label).alias("_y"), feature_array(columns).alias("features"))
    near = knn_self(small, k, within="_y", block_rows=block_rows).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbor"))).alias("near")
    )
    rows = ranked(small.withColumn("_h", digest("id", seed)), [("_h", True)], "_rn", ["_y"], bucket=hash_bucket("_h")).drop("_h")
    draws = class_draws(small.withColumnRenamed("_y", label), label, needed, {c: counts[c] for c in needed}, seed)
    base = draws.withColumnRenamed(label, "_y").join(rows, ["_y", "_rn"]).join(near, "id", "left")
    pick = draw(F.size("near"), F.col("_y"), F.col("draw"), "other", str(seed)).cast("int")
    chosen = base.select(
        "_y", F.col("id").alias("base"), F.col("features").alias("_a"),
        F.coalesce(F.when(F.size("near") > 0, F.get("near", pick)["neighbor"]), F.col("id")).alias("other"),
        unit_draw(F.col("_y"), F.col("draw"), "gap", str(seed)).alias("gap"),
    )
    ends = small.select(F.col("id").alias("other"), F.col("features").alias("_b"))
    made = chosen.join(ends, "other").select(
        F.lit(None).cast(df.schema[id_col].dataType).alias(id_col), F.col("_y").alias(label),
        *[(F.col("_a")[i] + F.col("gap") * (F.col("_b")[i] - F.col("_a")[i])).alias(c) for i, c in enumerate(columns)],
        "base", "other", "gap",
    )
    return real.unionByName(made)
