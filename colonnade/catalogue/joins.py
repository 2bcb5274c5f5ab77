"""Neighbour joins, density, clustering and association rules."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from colonnade.catalogue.registry import LABELLED, TRIPS, labelled, query, table, trips
from colonnade.catalogue.summaries import split_sql
from colonnade.operators import cluster, density, encode, itemsets, neighbors, sampling

EMB = "e AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def _embeddings(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("features"))


@query("kdistance_curve", f"""WITH {EMB},
d AS (SELECT a.id, list_distance(a.v, b.v) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r
      FROM e a, e b)
SELECT id, round(distance, 6) AS distance, row_number() OVER (ORDER BY distance, id) AS position FROM d WHERE r = 5""")
def kdistance_curve(spark, folder):
    return neighbors.k_distance(_embeddings(spark, folder), 5)


@query("knn_sweep", f"""WITH {EMB},
f AS (SELECT *, ntile(5) OVER (PARTITION BY label ORDER BY md5(CAST(id AS VARCHAR) || ':5805')) - 1 AS fold FROM e),
n AS (SELECT a.id, a.label, a.fold, b.label AS other,
             row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS r FROM f a JOIN f b ON a.fold <> b.fold),
v AS (SELECT id, label, fold, k, other, count(*) AS c FROM n, (SELECT unnest(generate_series(1, 30)) AS k) WHERE r <= k GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY c DESC, other) AS w FROM v),
a AS (SELECT k, fold, avg((label = other)::INT) AS a FROM w WHERE w = 1 GROUP BY 1, 2)
SELECT k, 'uniform' AS weights, round(avg(a), 6) AS accuracy, 2 AS p FROM a GROUP BY 1""")
def knn_sweep(spark, folder):
    folded = sampling.stratified_folds(_embeddings(spark, folder), "id", "label")
    return neighbors.knn_cv(folded, "label", list(range(1, 31)))


def _knn_sql(p):
    measure = "list_distance(a.v, b.v)" if p == 2 else "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))"
    return f"""SELECT id, k, weights, prediction, {p} AS p FROM (WITH
n AS (SELECT a.id, b.label AS other, {measure} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {measure}, b.id) AS r
      FROM splitted a, splitted b WHERE a.split = 'test' AND b.split = 'train'),
v AS (SELECT id, k, weights, other, sum(CASE WHEN weights = 'uniform' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / d END) AS c
      FROM n, (SELECT unnest([3, 5, 10]) AS k), (SELECT unnest(['uniform', 'distance']) AS weights) WHERE r <= k GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY id, k, weights ORDER BY c DESC, other) AS w FROM v)
SELECT id, k, weights, other AS prediction FROM w WHERE w = 1)"""


@query("knn_classify", f"WITH {EMB}, {split_sql('e', 'id', 'label')} {_knn_sql(2)} UNION ALL {_knn_sql(1)}")
def knn_classify(spark, folder):
    rows = sampling.stratified_split(_embeddings(spark, folder), "id", "label")
    test, train = rows.filter("split = 'test'"), rows.filter("split = 'train'")
    parts = [
        neighbors.knn_classify(test, train, "label", [3, 5, 10], weights=["uniform", "distance"], p=p)
        .select("id", "k", "weights", "prediction", F.lit(p).alias("p")) for p in (2, 1)
    ]
    return parts[0].unionByName(parts[1])


def _draw_sql(bound, *parts):
    """A repeatable whole number below ``bound``: the first 15 hexadecimal digits of the key's md5."""
    key = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({key}), 1, 15))::UBIGINT % ({bound})::UBIGINT)::BIGINT"


@query("smote", f"""WITH {LABELLED}, l AS (SELECT stop_id AS id, arrival_status AS y, delay_minutes::DOUBLE AS d, k::DOUBLE AS k FROM labelled),
c AS (SELECT y, count(*) AS n, max(count(*)) OVER () - count(*) AS need FROM l GROUP BY y),
small AS (SELECT l.*, row_number() OVER (PARTITION BY y ORDER BY md5(id::VARCHAR || ':5805')) AS rn FROM l JOIN c USING (y) WHERE need > 0),
pairs AS (SELECT a.id, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.d - b.d) * (a.d - b.d) + (a.k - b.k) * (a.k - b.k)), b.id) AS r
  FROM small a JOIN small b ON a.y = b.y AND a.id <> b.id),
near AS (SELECT id, list(other ORDER BY r) AS others FROM pairs WHERE r <= 5 GROUP BY id),
draws AS (SELECT y, n, unnest(range(1, need + 1)) AS draw FROM c WHERE need > 0),
based AS (SELECT s.*, draw, others FROM draws JOIN small s ON s.y = draws.y AND s.rn = {_draw_sql('n', 'draws.y', 'draw', "'5805'")} + 1 LEFT JOIN near USING (id)),
made AS (SELECT y, id, d, k, coalesce(others[{_draw_sql('len(others)', 'y', 'draw', "'other'", "'5805'")} + 1], id) AS other,
  {_draw_sql(2**52, 'y', 'draw', "'gap'", "'5805'")}::DOUBLE / {2**52}::DOUBLE AS gap FROM based)
SELECT id AS stop_id, y AS arrival_status, round(d, 6) AS delay_minutes, round(k, 6) AS k, NULL::BIGINT AS base, NULL::BIGINT AS other, NULL::DOUBLE AS gap FROM l
UNION ALL SELECT NULL, m.y, round(m.d + gap * (o.d - m.d), 6), round(m.k + gap * (o.k - m.k), 6), m.id, m.other, round(gap, 6) FROM made m JOIN l o ON o.id = m.other""")
def smote(spark, folder):
    return neighbors.smote(labelled(spark, folder), "arrival_status", ["delay_minutes", "k"], "stop_id")


@query("density_outliers", f"""WITH {LABELLED},
z AS (SELECT stop_id, (delay_minutes - avg(delay_minutes) OVER ()) / stddev_pop(delay_minutes) OVER () AS a,
             (long_delay - avg(long_delay) OVER ()) / stddev_pop(long_delay) OVER () AS b FROM labelled),
p AS (SELECT a, b, count(*) AS w FROM z GROUP BY 1, 2),
core AS (SELECT x.a, x.b FROM p x JOIN p y ON y.a BETWEEN x.a - 0.51 AND x.a + 0.51
         WHERE (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= 0.25 GROUP BY x.a, x.b HAVING sum(y.w) >= 5),
lonely AS (SELECT a, b FROM p EXCEPT SELECT a, b FROM core),
noise AS (SELECT a, b FROM lonely l WHERE NOT EXISTS (
  SELECT 1 FROM core c WHERE (l.a - c.a) * (l.a - c.a) + (l.b - c.b) * (l.b - c.b) <= 0.25))
SELECT stop_id, (z.a, z.b) IN (SELECT (a, b) FROM noise) AS outlier FROM z""")
def density_outliers(spark, folder):
    columns = ["delay_minutes", "long_delay"]
    scaled = encode.zscore(labelled(spark, folder).select("stop_id", *columns), columns)
    return density.outliers(scaled, "stop_id", columns, 0.5, 5)


DBSCAN = """WITH RECURSIVE z AS (
  SELECT p_partkey AS id, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS a,
         (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS b FROM part),
near AS (SELECT x.id AS i, y.id AS j FROM z x JOIN z y ON y.a BETWEEN x.a - 0.07 AND x.a + 0.07
         WHERE (x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) <= 0.0601 * 0.0601),
core AS (SELECT i AS id FROM near GROUP BY i HAVING count(*) >= 4),
link AS (SELECT i, j FROM near WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT link.j, reach.root FROM reach JOIN link ON link.i = reach.id),
label AS (SELECT id, min(root) AS label FROM reach GROUP BY id),
border AS (SELECT near.i AS id, min(label.label) AS label FROM near JOIN label ON near.j = label.id
           WHERE near.i NOT IN (SELECT id FROM core) GROUP BY 1),
every AS (SELECT z.id AS p_partkey, coalesce(label.label, border.label, -1) AS label
          FROM z LEFT JOIN label ON z.id = label.id LEFT JOIN border ON z.id = border.id)
"""


FIVE_GAPS = " + ".join(f"(x.v[{i}] - y.v[{i}]) * (x.v[{i}] - y.v[{i}])" for i in range(1, 6))
FIVE = f"""WITH RECURSIVE z AS (SELECT vec_id AS id, embedding[1:5]::DOUBLE[] AS v FROM embeddings),
near AS (SELECT x.id AS i, y.id AS j FROM z x JOIN z y ON {FIVE_GAPS} <= 0.12::DOUBLE * 0.12::DOUBLE),
core AS (SELECT i AS id FROM near GROUP BY i HAVING count(*) >= 4),
link AS (SELECT i, j FROM near WHERE i IN (SELECT id FROM core) AND j IN (SELECT id FROM core)),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT link.j, reach.root FROM reach JOIN link ON link.i = reach.id),
label AS (SELECT id, min(root) AS label FROM reach GROUP BY id),
border AS (SELECT near.i AS id, min(label.label) AS label FROM near JOIN label ON near.j = label.id
           WHERE near.i NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT z.id AS vec_id, coalesce(label.label, border.label, -1) AS label FROM z LEFT JOIN label ON z.id = label.id LEFT JOIN border ON z.id = border.id"""


@query("dbscan_five", FIVE)
def dbscan_five(spark, folder):
    """Five columns, more than the grid's search axes."""
    columns = [f"x{i}" for i in range(5)]
    rows = table(spark, folder, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    return density.dbscan(rows, "vec_id", columns, 0.12, 4).select("vec_id", "label")


def _dbscan(spark, folder):
    columns = ["p_size", "p_retailprice"]
    scaled = encode.zscore(table(spark, folder, "part").select("p_partkey", *columns), columns)
    return density.dbscan(scaled, "p_partkey", columns, 0.0601, 4)


@query("dbscan_labels", DBSCAN + "SELECT p_partkey, label FROM every")
def dbscan_labels(spark, folder):
    return _dbscan(spark, folder)


@query("dbscan_count", DBSCAN + """SELECT count(DISTINCT label) FILTER (WHERE label <> -1) AS clusters,
count(*) FILTER (WHERE label = -1) AS noise FROM every""")
def dbscan_count(spark, folder):
    return density.cluster_count(_dbscan(spark, folder))


def _silhouette_sql(distance):
    return f"""WITH {EMB},
m AS (SELECT a.id, a.label AS own, b.label AS other, sum({distance}) AS s, count(*) AS n FROM e a, e b GROUP BY ALL),
g AS (SELECT id, max(CASE WHEN own = other THEN n END) AS size, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a,
             min(CASE WHEN own <> other THEN s / n END) AS b FROM m GROUP BY id)
SELECT round(avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM g"""


@query("silhouette_fixed", _silhouette_sql("list_distance(a.v, b.v) * list_distance(a.v, b.v)"))
def silhouette_fixed(spark, folder):
    value = cluster.silhouette(_embeddings(spark, folder))
    return spark.createDataFrame([(float(value),)], "silhouette double")


@query("silhouette_euclidean", _silhouette_sql("list_distance(a.v, b.v)"))
def silhouette_euclidean(spark, folder):
    return cluster.silhouette_euclidean(_embeddings(spark, folder))


@query("kmeans_sweep")
def kmeans_sweep(spark, folder):
    columns = ["delay_minutes", "k"]
    scaled = encode.zscore(labelled(spark, folder).select("stop_id", *columns), columns)
    return cluster.kmeans_sweep(scaled, columns)[0]


@query("kmeans_labels")
def kmeans_labels(spark, folder):
    columns = ["delay_minutes", "k"]
    scaled = encode.zscore(labelled(spark, folder).select("stop_id", *columns), columns)
    return cluster.kmeans_sweep(scaled, columns, [3])[1].select("stop_id", "cluster")


ITEM_COLUMNS = ["arrival_status", "day_of_weeks", "time_of_day"]
ITEMS = TRIPS + ",\nitems AS (SELECT " + ", ".join(
    f"CASE WHEN {c} <> (SELECT min({c}) FROM trips) THEN '{c}_' || {c} END AS {c}" for c in ITEM_COLUMNS) + " FROM trips)"


def _set_name(columns):
    return " || ',' || ".join(columns)


def _sets_sql():
    parts = []
    for size in (1, 2, 3):
        for columns in itertools.combinations(ITEM_COLUMNS, size):
            there = " AND ".join(f"{c} IS NOT NULL" for c in columns)
            parts.append(f"SELECT {_set_name(columns)} AS itemset, {size} AS size, count(*) AS freq FROM items WHERE {there} GROUP BY 1")
    return ITEMS + f""",
sets AS (SELECT *, (SELECT count(*) FROM items) AS n, freq::DOUBLE / (SELECT count(*) FROM items) AS support
         FROM ({" UNION ALL ".join(parts)}) WHERE freq >= 0.05 * (SELECT count(*) FROM items))"""


def _rules_sql():
    parts = []
    for size in (2, 3):
        for columns in itertools.combinations(ITEM_COLUMNS, size):
            for left in range(1, size):
                for a in itertools.combinations(columns, left):
                    c = [x for x in columns if x not in a]
                    there = " AND ".join(f"{x} IS NOT NULL" for x in columns)
                    parts.append(f"SELECT DISTINCT {_set_name(columns)} AS itemset, {_set_name(a)} AS antecedent, {_set_name(c)} AS consequent FROM items WHERE {there}")
    return _sets_sql() + f""",
raw AS (SELECT antecedent, consequent, sa.support AS sa, sc.support AS sc, s.support AS s, s.support / sa.support AS conf
  FROM ({" UNION ALL ".join(parts)}) r JOIN sets s USING (itemset)
  JOIN sets sa ON sa.itemset = antecedent JOIN sets sc ON sc.itemset = consequent),
rules AS (SELECT antecedent, consequent, round(sa, 6) AS antecedent_support, round(sc, 6) AS consequent_support,
  round(s, 6) AS support, round(conf, 6) AS confidence, round(conf / sc, 6) AS lift, round(s - sa * sc, 6) AS leverage,
  round((1 - sc) / (1 - conf), 6) AS conviction, round((s - sa * sc) / greatest(s * (1 - sa), sa * (sc - s)), 6) AS zhangs_metric
  FROM raw WHERE conf >= 0.1)"""


def _itemsets(spark, folder):
    return itemsets.frequent_itemsets(itemsets.baskets(trips(spark, folder), ITEM_COLUMNS))


def _named(rules):
    return rules.withColumns({c: F.array_join(c, ",") for c in ("antecedent", "consequent")})


@query("frequent_itemsets", f"WITH {_sets_sql()} SELECT itemset, size, freq, n, round(support, 6) AS support FROM sets")
def frequent_itemsets(spark, folder):
    return _itemsets(spark, folder).withColumn("itemset", F.array_join("itemset", ","))


@query("association_rules", f"WITH {_rules_sql()} SELECT * FROM rules")
def association_rules(spark, folder):
    return _named(itemsets.association_rules(_itemsets(spark, folder)))


@query("strong_rules", f"WITH {_rules_sql()} SELECT * FROM rules WHERE lift > 1.05 ORDER BY lift DESC")
def strong_rules(spark, folder):
    return _named(itemsets.strong_rules(itemsets.association_rules(_itemsets(spark, folder)), 1.05))
