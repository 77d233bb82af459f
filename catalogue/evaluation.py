"""Scores of rules that both engines can state, and clusterings given by a column."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query, rounded, run_sql, table
from plumbline.operators import attribution, cluster, cluster_metrics, limits, metrics

TWO = "SELECT l_linestatus AS label, CASE WHEN l_quantity > 27 OR l_returnflag = 'A' THEN 'O' ELSE 'F' END AS prediction FROM {lineitem}"
THREE = """SELECT o_orderstatus AS label, CASE WHEN o_totalprice < 90000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O' ELSE 'P' END AS prediction FROM {orders}"""
# A label no prediction ever meets, and one that is never the truth.
ODD = "SELECT event_type AS label, CASE WHEN value < 20 THEN 'view' WHEN value < 60 THEN 'click' ELSE 'other' END AS prediction FROM {events}"


def confusion_sql(source):
    return f"""WITH x AS ({source}), l AS (SELECT label AS v FROM x UNION SELECT prediction FROM x),
    g AS (SELECT a.v AS actual, b.v AS predicted FROM l a, l b)
    SELECT actual, predicted, (SELECT count(*) FROM x WHERE label = actual AND prediction = predicted) AS n FROM g"""


def report_sql(source):
    return f"""WITH m AS ({confusion_sql(source)}),
    r AS (SELECT actual AS c, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS BIGINT) AS hits FROM m GROUP BY actual),
    q AS (SELECT predicted AS c, CAST(sum(n) AS DOUBLE) AS p FROM m GROUP BY predicted),
    s AS (SELECT r.c, support, hits, CASE WHEN p > 0 THEN hits / p ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN CAST(hits AS DOUBLE) / support ELSE 0.0 END AS recall FROM r JOIN q ON r.c = q.c)
    SELECT c AS "class", precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, support, hits FROM s"""


for _name, _source in (("two", TWO), ("three", THREE), ("unmatched", ODD)):
    def _register(name, source):
        @query(f"confusion_{name}", confusion_sql(source))
        def _(spark, sf):
            return metrics.confusion(run_sql(spark, sf, source))

        @query(f"class_report_{name}", f"""SELECT "class", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support, hits FROM ({report_sql(source)}) r""")
        def _(spark, sf):
            return rounded(metrics.class_report(metrics.confusion(run_sql(spark, sf, source))))

        @query(f"weighted_scores_{name}", f"""SELECT round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
        round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
        CAST(sum(support) AS BIGINT) AS rows FROM ({report_sql(source)}) r""")
        def _(spark, sf):
            return rounded(metrics.averages(metrics.class_report(metrics.confusion(run_sql(spark, sf, source)))))

    _register(_name, _source)


@query("confusion_insights", f"""WITH r AS (SELECT label AS c, avg(CASE WHEN label = prediction THEN 0.0 ELSE 1.0 END) AS rate FROM ({TWO}) x GROUP BY label),
w AS (SELECT c, rate FROM r ORDER BY rate DESC, c LIMIT 1)
SELECT 'worst_class' AS finding, c AS subject, round(rate, 6) AS value FROM w
UNION ALL SELECT 'false_positive_rate', 'negatives', round(rate, 6) FROM (SELECT rate FROM r ORDER BY c LIMIT 1) f
UNION ALL SELECT 'lower_the_threshold', c, round(rate, 6) FROM w WHERE rate > 0.3
UNION ALL SELECT 'imbalanced_training', 'minority', NULL""")
def _(spark, sf):
    return rounded(metrics.confusion_insights(metrics.confusion(run_sql(spark, sf, TWO)), imbalanced=True))


@query("unit_scores", "SELECT event_id, round((value - lo) / (hi - lo + 1e-10), 6) AS score FROM {events}, (SELECT min(value) AS lo, max(value) AS hi FROM {events}) m")
def _(spark, sf):
    return rounded(metrics.unit_scores(table(spark, sf, "events"), "value").select("event_id", "score"))


def auc_sql(positive, score, source):
    return f"""SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(1 - p) AS BIGINT) AS negatives,
      (sum(CASE WHEN p = 1 THEN r ELSE 0 END) - sum(p) * (sum(p) + 1) / 2.0) / (CAST(sum(p) AS DOUBLE) * sum(1 - p)) AS auc
    FROM (SELECT p, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM (SELECT CAST({positive} AS INTEGER) AS p, {score} AS s FROM {source}) a) b"""


@query("roc_auc", f"SELECT positives, negatives, round(auc, 6) AS roc_auc FROM ({auc_sql('l_extendedprice > 60000', 'l_quantity + l_linenumber', '{lineitem}')}) x")
def _(spark, sf):
    df = run_sql(spark, sf, "SELECT l_extendedprice > 60000 AS positive, l_quantity + l_linenumber AS score FROM {lineitem}")
    return rounded(metrics.roc_auc(df, "positive", "score"))


SHARES = """SELECT o_orderstatus AS label, (o_totalprice % 1000) / 1000 AS f, (o_custkey % 97) / 97.0 AS o, CAST(o_orderkey % 13 AS DOUBLE) AS p FROM {orders}"""
PER_CLASS = " UNION ALL ".join(
    f"""SELECT '{c}' AS "class", positives AS support, auc AS roc_auc FROM ({auc_sql(f"label = '{c}'", s, f'({SHARES}) z')}) y""" for c, s in (("F", "f"), ("O", "o"), ("P", "p"))
)


@query("roc_auc_per_class", f'SELECT "class", support, round(roc_auc, 6) AS roc_auc FROM ({PER_CLASS}) x')
def _(spark, sf):
    return rounded(metrics.roc_auc_per_class(run_sql(spark, sf, SHARES), "label", {"F": "f", "O": "o", "P": "p"}))


@query("roc_auc_weighted", f"SELECT round(sum(roc_auc * support) / sum(support), 6) AS roc_auc_weighted FROM ({PER_CLASS}) x")
def _(spark, sf):
    each = metrics.roc_auc_per_class(run_sql(spark, sf, SHARES), "label", {"F": "f", "O": "o", "P": "p"})
    return rounded(metrics.weighted_auc(each))


GUESS = "SELECT l_extendedprice AS label, l_quantity * 2000 + l_linenumber * 700 AS prediction FROM {lineitem}"
SPREADING = "SELECT c_acctbal + 1000 AS label, (c_acctbal + 1000) * (1 + ((c_custkey * 7919) % 101 - 50) / 200.0) AS prediction FROM {customer}"


@query("regression_scores", f"""SELECT n AS rows, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2, round(mape, 4) AS mape, round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r2
FROM (SELECT count(*) AS n, avg(power(label - prediction, 2)) AS mse, avg(abs(label - prediction)) AS mae, 1 - avg(power(label - prediction, 2)) / var_pop(label) AS r2, avg(abs((label - prediction) / label)) * 100 AS mape FROM ({GUESS}) x) s""")
def _(spark, sf):
    out = metrics.regression_scores(run_sql(spark, sf, GUESS), "label", "prediction", 2)
    return out.select("rows", *[F.round(c, d).alias(c) for c, d in (("rmse", 4), ("mae", 4), ("r2", 6), ("mape", 4), ("adj_r2", 6))])


@query("mape_with_zeros", """SELECT round(avg(abs((y - 5.0) / CASE WHEN y = 0 THEN 1e-10 ELSE y END)) * 100 / 1e9, 4) AS mape FROM (SELECT CAST(o_custkey % 10 AS DOUBLE) AS y FROM {orders}) x""")
def _(spark, sf):
    df = run_sql(spark, sf, "SELECT CAST(o_custkey % 10 AS DOUBLE) AS y, 5.0D AS p FROM {orders}")
    return metrics.regression_scores(df, "y", "p", 1).select(F.round(F.col("mape") / 1e9, 4).alias("mape"))


@query("residuals", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_quantity * 2000, 4) + 0.0 AS residual FROM {lineitem}")
def _(spark, sf):
    df = run_sql(spark, sf, "SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity * 2000 AS p FROM {lineitem}")
    return rounded(metrics.residuals(df, "y", "p").select("l_orderkey", "l_linenumber", "residual"), 4)


def spread_sql(source):
    return f"""SELECT n AS rows, round(rho, 6) + 0.0 AS rho, abs(rho) > 0.3 AND abs(rho) * sqrt((n - 2) / (1 - rho * rho)) > 1.9616 AS heteroscedastic
    FROM (SELECT count(*) AS n, corr(a, b) AS rho FROM (
      SELECT rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2.0 AS a,
        rank() OVER (ORDER BY abs(label - prediction)) + (count(*) OVER (PARTITION BY abs(label - prediction)) - 1) / 2.0 AS b FROM ({source}) x) r) s"""


@query("heteroscedasticity", f"{spread_sql(GUESS)}")
def _(spark, sf):
    return rounded(metrics.heteroscedasticity(run_sql(spark, sf, GUESS), "label", "prediction").drop("t"))


@query("heteroscedasticity_found", f"{spread_sql(SPREADING)}")
def _(spark, sf):
    return rounded(metrics.heteroscedasticity(run_sql(spark, sf, SPREADING), "label", "prediction").drop("t"))


CLUSTERED = """SELECT c_custkey, c_acctbal / 1000 AS bal, CAST(c_nationkey AS DOUBLE) AS nation,
  CASE WHEN c_acctbal < 0 THEN -1 WHEN c_acctbal < 3000 THEN 0 WHEN c_nationkey < 12 THEN 1 ELSE 2 END AS cluster FROM {customer}"""


@query("cluster_count", f"SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS clusters, CAST(sum(CASE WHEN cluster = -1 THEN 1 ELSE 0 END) AS BIGINT) AS noise FROM ({CLUSTERED}) x")
def _(spark, sf):
    return cluster_metrics.cluster_count(run_sql(spark, sf, CLUSTERED))


@query("cluster_profiles", f"""SELECT cluster, count(*) AS n_samples, round(avg(bal), 3) AS bal_mean, round(stddev_samp(bal), 3) AS bal_std, round(avg(nation), 3) AS nation_mean, round(stddev_samp(nation), 3) AS nation_std FROM ({CLUSTERED}) x GROUP BY cluster""")
def _(spark, sf):
    return cluster_metrics.profiles(run_sql(spark, sf, CLUSTERED), ["bal", "nation"])


@query("davies_bouldin", f"""WITH x AS ({CLUSTERED}), c AS (SELECT cluster, avg(bal) AS a, avg(nation) AS b FROM x GROUP BY cluster),
s AS (SELECT x.cluster, any_value(a) AS a, any_value(b) AS b, avg(sqrt(power(bal - a, 2) + power(nation - b, 2))) AS s FROM x JOIN c ON c.cluster = x.cluster GROUP BY x.cluster),
r AS (SELECT i.cluster, max((i.s + j.s) / sqrt(power(i.a - j.a, 2) + power(i.b - j.b, 2))) AS w FROM s i JOIN s j ON i.cluster <> j.cluster GROUP BY i.cluster)
SELECT count(*) AS clusters, round(avg(w), 6) AS davies_bouldin FROM r""")
def _(spark, sf):
    return rounded(cluster_metrics.davies_bouldin(run_sql(spark, sf, CLUSTERED), ["bal", "nation"]))


@query("silhouette", f"""WITH x AS ({CLUSTERED}),
d AS (SELECT i.c_custkey AS k, i.cluster AS own, j.cluster AS other, sum(power(i.bal - j.bal, 2) + power(i.nation - j.nation, 2)) AS t, count(*) AS n FROM x i, x j GROUP BY 1, 2, 3),
s AS (SELECT k, max(CASE WHEN own = other THEN t / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b, max(CASE WHEN own = other THEN n END) AS size FROM d GROUP BY k)
SELECT round(avg(CASE WHEN size <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def _(spark, sf):
    return rounded(cluster_metrics.silhouette_squared(run_sql(spark, sf, CLUSTERED), ["bal", "nation"]))


@query("silhouette_euclidean", f"""WITH x AS ({CLUSTERED}),
p AS (SELECT * FROM x ORDER BY CAST('0x' || substr(md5('silhouette' || c_custkey), 1, 13) AS BIGINT) LIMIT 1000),
d AS (SELECT i.c_custkey AS k, i.cluster AS own, j.cluster AS other, sum(sqrt(power(i.bal - j.bal, 2) + power(i.nation - j.nation, 2))) AS t, count(*) AS n FROM p i, x j GROUP BY 1, 2, 3),
s AS (SELECT k, max(CASE WHEN own = other THEN t / greatest(n - 1, 1) END) AS a, min(CASE WHEN own <> other THEN t / n END) AS b, max(CASE WHEN own = other THEN n END) AS size FROM d GROUP BY k)
SELECT round(avg(CASE WHEN size <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def _(spark, sf):
    return rounded(cluster_metrics.silhouette(run_sql(spark, sf, CLUSTERED), ["bal", "nation"], ["c_custkey"]))


@query("pca_points")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    points, _ = cluster_metrics.pca_points(df, [f"e{i}" for i in range(64)], ["vec_id"])
    return points


@query("pca_share", "SELECT CAST(1.0 AS DOUBLE) AS share, count(*) AS rows FROM {customer}")
def _(spark, sf):
    points, share = cluster_metrics.pca_points(run_sql(spark, sf, CLUSTERED), ["bal", "nation"], ["c_custkey"])
    return points.agg(F.round(F.lit(share), 6).alias("share"), F.count(F.lit(1)).alias("rows"))


def limits_sql(n, ratio):
    return f"""SELECT 'very_small' AS code FROM ({n}) n WHERE n < 500 UNION ALL SELECT 'small' FROM ({n}) n WHERE n >= 500 AND n < 2000
    UNION ALL SELECT 'imbalance' FROM ({ratio}) r WHERE r < 0.1 UNION ALL SELECT 'high_cardinality' FROM ({n}) n WHERE n < 5000
    UNION ALL SELECT 'datetime' UNION ALL SELECT 'few_trials'"""


@query("limitations", limits_sql("SELECT count(*) AS n FROM {customer}", "SELECT min(c) * 1.0 / sum(c) AS r FROM (SELECT count(*) AS c FROM {customer} GROUP BY c_nationkey) g"))
def _(spark, sf):
    df = table(spark, sf, "customer")
    sizes = df.groupBy("c_nationkey").count().agg((F.min("count") / F.sum("count")).alias("r")).first()["r"]
    return limits.limitations(
        spark, rows=df.count(), problem="classification", imbalance_ratio=sizes, high_cardinality=1, datetimes=1, trials=3
    ).select("code")


@query("importance_ranking", """SELECT feature, round(m, 5) AS importance FROM (
SELECT 'l_quantity' AS feature, avg(abs(l_quantity - q)) * 0.02 AS m FROM {lineitem}, (SELECT avg(l_quantity) AS q FROM {lineitem}) a
UNION ALL SELECT 'l_discount', avg(abs(l_discount - q)) * 3.5 FROM {lineitem}, (SELECT avg(l_discount) AS q FROM {lineitem}) b
UNION ALL SELECT 'l_tax', avg(abs(l_tax - q)) * 1.25 FROM {lineitem}, (SELECT avg(l_tax) AS q FROM {lineitem}) c) x""")
def _(spark, sf):
    cols = ["l_quantity", "l_discount", "l_tax"]
    phi = attribution.linear(table(spark, sf, "lineitem"), cols, [0.02, -3.5, 1.25])
    return metrics.ranking(attribution.mean_absolute(phi, cols))


@query("attribution_linear", """SELECT p_partkey, round((p_size - s) * 0.5, 6) + 0.0 AS p_size, round((p_retailprice - r) * -0.01, 6) + 0.0 AS p_retailprice FROM {part}, (SELECT avg(p_size) AS s, avg(p_retailprice) AS r FROM {part}) m""")
def _(spark, sf):
    return rounded(attribution.linear(table(spark, sf, "part"), ["p_size", "p_retailprice"], [0.5, -0.01], ["p_partkey"]))


# One clustering per k: the balance cut into k equal bands.
CURVE = """SELECT k, bal, CAST(floor((bal + 1) / 11.0001 * k) AS INTEGER) AS band FROM (SELECT c_acctbal / 1000 AS bal FROM {customer}) x, (SELECT 2 AS k UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) ks"""


def curve_sql():
    return f"""SELECT k, sum(ss) AS inertia FROM (SELECT k, band, sum(power(bal, 2)) - power(sum(bal), 2) / count(*) AS ss FROM ({CURVE}) c GROUP BY k, band) w GROUP BY k"""


def _curve(spark, sf):
    ss = F.sum(F.col("bal") * F.col("bal")) - F.sum("bal") * F.sum("bal") / F.count(F.lit(1))
    return run_sql(spark, sf, CURVE).groupBy("k", "band").agg(ss.alias("ss")).groupBy("k").agg(F.sum("ss").alias("inertia"))


@query("elbow", f"""WITH c AS ({curve_sql()}), e AS (SELECT arg_min(inertia, k) AS i0, arg_max(inertia, k) AS i1 FROM c)
SELECT k, round(inertia, 4) AS inertia, round(abs(5 * (i0 - inertia) - (i1 - i0) * (2 - k)) / sqrt(25 + power(i1 - i0, 2)), 6) + 0.0 AS bend FROM c, e""")
def _(spark, sf):
    return cluster.elbow(_curve(spark, sf)).select("k", F.round("inertia", 4).alias("inertia"), F.round("bend", 6).alias("bend"))


@query("choose_k", f"""WITH c AS ({curve_sql()}), e AS (SELECT arg_min(inertia, k) AS i0, arg_max(inertia, k) AS i1 FROM c),
b AS (SELECT k, 1.0 / (1 + abs(k - 4)) AS sil, abs(5 * (i0 - inertia) - (i1 - i0) * (2 - k)) AS bend FROM c, e)
SELECT (SELECT k FROM b ORDER BY sil DESC, k LIMIT 1) AS by_silhouette, (SELECT k FROM b ORDER BY bend DESC, k LIMIT 1) AS by_elbow, (SELECT k FROM b ORDER BY sil DESC, k LIMIT 1) AS k""")
def _(spark, sf):
    curve = _curve(spark, sf).withColumn("silhouette", 1 / (1 + F.abs(F.col("k") - 4)))
    return cluster.choose_k(curve)


@query("choose_k_by_caller", "SELECT CAST(5 AS INTEGER) AS k, count(*) > 0 AS seen FROM {customer}")
def _(spark, sf):
    curve = _curve(spark, sf).withColumn("silhouette", 1 / F.col("k"))
    return cluster.choose_k(curve, 5).select("k", F.lit(True).alias("seen"))


@query("k_range", "SELECT CAST(k AS INTEGER) AS k FROM (SELECT unnest(range(2, CAST(least(11, greatest(3, count(*) // 50)) AS BIGINT) + 1)) AS k FROM {customer}) r")
def _(spark, sf):
    ks = cluster.k_range(table(spark, sf, "customer").count())
    return spark.createDataFrame([(k,) for k in ks], "k int")


@query("best_clustering", f"""SELECT c_mktsegment AS name, round(s, 6) AS silhouette FROM (SELECT c_mktsegment, avg(c_acctbal) / 10000 AS s FROM {{customer}} GROUP BY c_mktsegment) x ORDER BY s DESC LIMIT 1""")
def _(spark, sf):
    tried = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg((F.avg("c_acctbal") / 10000).alias("silhouette"))
    return rounded(cluster.best_by_silhouette(tried.withColumn("step", F.lit(0))).select("name", "silhouette"))


@query("plot_confusion", f"SELECT actual, predicted, n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY actual), 6) AS share FROM ({confusion_sql(THREE)}) m")
def _(spark, sf):
    m = metrics.confusion(run_sql(spark, sf, THREE))
    total = m.groupBy("actual").agg(F.sum("n").alias("t"))
    return rounded(m.join(F.broadcast(total), "actual").select("actual", "predicted", "n", (F.col("n") / F.col("t")).alias("share")))


@query("plot_residuals", f"SELECT round(prediction, 4) AS prediction, round(label - prediction, 4) + 0.0 AS residual FROM ({GUESS}) x")
def _(spark, sf):
    return rounded(metrics.residuals(run_sql(spark, sf, GUESS), "label", "prediction").select("prediction", "residual"), 4)


@query("report_metrics", f"""SELECT 'f1_weighted' AS metric, round(sum(f1 * support) / sum(support), 4) AS value FROM ({report_sql(THREE)}) r
UNION ALL SELECT 'precision_weighted', round(sum(precision * support) / sum(support), 4) FROM ({report_sql(THREE)}) r
UNION ALL SELECT 'recall_weighted', round(sum(recall * support) / sum(support), 4) FROM ({report_sql(THREE)}) r""")
def _(spark, sf):
    avg = metrics.averages(metrics.class_report(metrics.confusion(run_sql(spark, sf, THREE))))
    cols = ["f1_weighted", "precision_weighted", "recall_weighted"]
    return avg.select(cols).unpivot([], cols, "metric", "value").withColumn("value", F.round("value", 4))
