"""Neighbours, density, hierarchy, k-means and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query, rounded, run_sql, table
from plumbline.operators import cluster, neighbours, resample

FEATURES = """SELECT c_custkey, c_acctbal / 1000 AS bal, c_nationkey / 3.0 AS nation FROM {customer}"""
DIMS = [f"e{i}" for i in range(64)]


def vectors(spark, sf):
    df = table(spark, sf, "embeddings")
    return df.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(d) for i, d in enumerate(DIMS)])


@query("nearest_centre", """SELECT c_custkey, CAST(arg_min(i, d) AS INTEGER) AS cluster FROM (SELECT c_custkey, i, power(c_acctbal / 1000 - a, 2) + power(c_nationkey / 3.0 - b, 2) AS d
FROM {customer}, (SELECT 0 AS i, 1.0 AS a, 2.0 AS b UNION ALL SELECT 1, 8.0, 6.5 UNION ALL SELECT 2, 4.3, 4.1) c) x GROUP BY c_custkey""")
def _(spark, sf):
    df = run_sql(spark, sf, FEATURES)
    return cluster.nearest_centre(df, ["bal", "nation"], [(1.0, 2.0), (8.0, 6.5), (4.3, 4.1)]).select("c_custkey", "cluster")


@query("kmeans_sweep")
def _(spark, sf):
    return rounded(cluster.kmeans_sweep(run_sql(spark, sf, FEATURES), ["bal", "nation"])[0])


PAIRS = """d AS (SELECT a.vec_id AS i, b.vec_id AS j, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM {embeddings} a, {embeddings} b),
k AS (SELECT i, d AS distance FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS rn FROM d) r WHERE rn = 5)"""


@query("neighbour_distance", f"WITH {PAIRS} SELECT i AS vec_id, round(distance, 5) AS distance FROM k")
def _(spark, sf):
    return rounded(neighbours.neighbour_distance(vectors(spark, sf), DIMS, 5, ["vec_id"]), 5)


@query("neighbour_distance_copies", """WITH x AS (SELECT c_custkey AS k, CAST(c_nationkey AS DOUBLE) AS a, round(c_acctbal / 500) AS b FROM {customer}),
d AS (SELECT i.k, sqrt(power(i.a - j.a, 2) + power(i.b - j.b, 2)) AS d, row_number() OVER (PARTITION BY i.k ORDER BY power(i.a - j.a, 2) + power(i.b - j.b, 2)) AS rn FROM x i, x j)
SELECT k AS c_custkey, round(d, 6) AS distance FROM d WHERE rn = 5""")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("a"), F.round(F.col("c_acctbal") / 500).alias("b"))
    return rounded(neighbours.neighbour_distance(df, ["a", "b"], 5, ["c_custkey"]))


@query("density_radius", f"WITH {PAIRS} SELECT round(quantile_cont(distance, 0.9), 5) AS eps FROM k")
def _(spark, sf):
    eps = neighbours.density_radius(vectors(spark, sf), DIMS)
    return rounded(spark.createDataFrame([(eps,)], "eps double"), 5)


DENSITY = """WITH RECURSIVE x AS (SELECT c_custkey AS k, c_acctbal / 1000 AS a, c_nationkey / 3.0 AS b FROM {customer}),
d AS (SELECT i.k AS i, j.k AS j, sqrt(power(i.a - j.a, 2) + power(i.b - j.b, 2)) AS d FROM x i, x j WHERE abs(i.a - j.a) <= 0.2 AND abs(i.b - j.b) <= 0.2),
h AS (SELECT i, j, d FROM d WHERE d <= 0.2),
core AS (SELECT i FROM h GROUP BY i HAVING count(*) >= 5),
e AS (SELECT i, j FROM h WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
reach AS (SELECT i, j FROM e UNION SELECT r.i, e.j FROM reach r JOIN e ON r.j = e.i),
lab AS (SELECT i, min(j) AS label FROM reach GROUP BY i),
near AS (SELECT h.i, arg_min(lab.label, h.d) AS label FROM h JOIN lab ON lab.i = h.j WHERE h.i NOT IN (SELECT i FROM core) GROUP BY h.i),
every AS (SELECT i, label FROM lab UNION ALL SELECT i, label FROM near)
SELECT x.k AS c_custkey, CASE WHEN e.label IS NULL THEN -1 ELSE min(x.k) OVER (PARTITION BY e.label) END AS first_member FROM x LEFT JOIN every e ON e.i = x.k"""


@query("density_clusters", DENSITY)
def _(spark, sf):
    df = run_sql(spark, sf, FEATURES)
    out = neighbours.DensityScan(df, ["bal", "nation"], 0.2).clusters(5, ["c_custkey"])
    first = out.groupBy("cluster").agg(F.min("c_custkey").alias("first_member"))
    return out.join(first, "cluster").select(
        "c_custkey", F.when(F.col("cluster") == -1, F.lit(-1)).otherwise(F.col("first_member")).cast("bigint").alias("first_member")
    )


@query("density_clusters_vectors")
def _(spark, sf):
    df = vectors(spark, sf)
    return neighbours.DensityScan(df, DIMS, neighbours.density_radius(df, DIMS)).clusters(3, ["vec_id"]).select("vec_id", "cluster")


@query("hierarchical_ward")
def _(spark, sf):
    df = run_sql(spark, sf, FEATURES)
    return cluster.hierarchical(df, ["bal", "nation"], 4, "ward").transform(df)


@query("hierarchical_complete")
def _(spark, sf):
    df = run_sql(spark, sf, FEATURES)
    return cluster.hierarchical(df, ["bal", "nation"], 4, "complete").transform(df)


@query("hierarchical_average")
def _(spark, sf):
    df = run_sql(spark, sf, FEATURES)
    return cluster.hierarchical(df, ["bal", "nation"], 4, "average").transform(df)


@query("bisecting_kmeans")
def _(spark, sf):
    return cluster.bisecting(run_sql(spark, sf, FEATURES), ["bal", "nation"], 4).select("c_custkey", "cluster")


@query("discover_clusters")
def _(spark, sf):
    return rounded(cluster.discover(run_sql(spark, sf, FEATURES), ["bal", "nation"]).candidates)


@query("oversample_sizes", """SELECT toxic, max(count(*)) OVER () AS n, count(*) AS original FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id GROUP BY toxic""")
def _(spark, sf):
    return _grown(spark, sf).groupBy("toxic").agg(
        F.count(F.lit(1)).alias("n"), F.sum((~F.col("made")).cast("bigint")).alias("original")
    )


@query("oversample_rows")
def _(spark, sf):
    return rounded(_grown(spark, sf))


def _grown(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.log1p("n_chars").alias("size"), (F.length("source") + F.length("lang")).cast("double").alias("tag"))
    df = table(spark, sf, "labels").join(docs, "doc_id").select("size", "tag", F.col("quality").cast("double").alias("quality"), "toxic")
    return resample.oversample(df, ["size", "tag", "quality"], "toxic", mark="made")
