"""Scoring new rows with fixed rules and with fitted, saved models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query, rounded, run_sql, table
from plumbline.config import Settings
from plumbline.functions.columns import scratch
from plumbline.operators import cluster, score, search
from plumbline.operators.detect import detect
from plumbline.operators.findings import run_audit
from plumbline.operators.prepare import prepare
from plumbline.sources.artifacts import FittedModel, timestamp
from plumbline.streaming.score import score_stream


@query("score_columns", "SELECT p_partkey, p_retailprice, p_size, p_type FROM {part}")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_type", "p_size", "p_partkey", "p_retailprice")
    return score.check_columns(df, ["p_retailprice", "p_size", "p_type"], ["p_partkey"])


@query("score_columns_refused", "SELECT 'missing' AS problem, 'p_shape' AS name FROM {part} GROUP BY 1 UNION ALL SELECT 'unexpected', 'p_name' FROM {part} GROUP BY 1")
def _(spark, sf):
    try:
        score.check_columns(table(spark, sf, "part").select("p_size", "p_name"), ["p_size", "p_shape"])
    except score.SchemaMismatch as e:
        rows = [("missing", c) for c in e.missing] + [("unexpected", c) for c in e.unexpected]
        return spark.createDataFrame(rows, "problem string, name string")
    raise AssertionError("a wrong schema was accepted")


RAW = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'many' ELSE CAST(o_custkey AS {text}) END AS cust, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_totalprice AS {text}) END AS price, o_orderstatus AS status FROM {orders}"
TYPES = {"cust": "bigint", "price": "double", "status": "string"}


@query("score_coerce", f"SELECT o_orderkey, try_cast(cust AS BIGINT) AS cust, round(try_cast(price AS DOUBLE), 4) AS price, status FROM ({RAW.replace('{text}', 'VARCHAR')}) x WHERE try_cast(cust AS BIGINT) IS NOT NULL")
def _(spark, sf):
    return rounded(score.coerce(run_sql(spark, sf, RAW.replace("{text}", "STRING")), TYPES)[0], 4)


@query("score_rejects", f"SELECT o_orderkey, cust, status FROM ({RAW.replace('{text}', 'VARCHAR')}) x WHERE try_cast(cust AS BIGINT) IS NULL")
def _(spark, sf):
    return score.coerce(run_sql(spark, sf, RAW.replace("{text}", "STRING")), TYPES)[1].select("o_orderkey", "cust", "status")


@query("score_binary", """SELECT p_partkey, CASE WHEN p > 0.5 THEN 'yes' ELSE 'no' END AS prediction, round(p, 6) AS probability, CAST(2 AS INTEGER) AS labels FROM (SELECT p_partkey, 1 / (1 + exp(-(0.08 * p_size - 0.002 * p_retailprice + 0.4))) AS p FROM {part}) x""")
def _(spark, sf):
    df = score.linear_score(table(spark, sf, "part"), ["p_size", "p_retailprice"], [0.08, -0.002], 0.4)
    p = 1 / (1 + F.exp(-F.col("margin")))
    out = score.binary_output(df, p, (p > 0.5).cast("double"), ["no", "yes"], ["p_partkey"])
    return rounded(out.withColumn("labels", F.size("class_labels")).drop("class_labels"))


@query("score_multiclass", """SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN 'low' WHEN b >= c THEN 'mid' ELSE 'high' END AS prediction, round(a / (a + b + c), 6) AS low, round(b / (a + b + c), 6) AS mid, round(c / (a + b + c), 6) AS high
FROM (SELECT p_partkey, exp(1 - 0.03 * p_size) AS a, exp(0.01 * p_size) AS b, exp(0.05 * p_size - 1) AS c FROM {part}) x""")
def _(spark, sf):
    df = table(spark, sf, "part")
    for name, w, b in (("a", -0.03, 1.0), ("b", 0.01, 0.0), ("c", 0.05, -1.0)):
        df = score.linear_score(df, ["p_size"], [w], b, name)
    e = [F.exp(c) for c in ("a", "b", "c")]
    shares = F.array(*[x / (e[0] + e[1] + e[2]) for x in e])
    best = F.array_position(shares, F.array_max(shares)) - 1
    out = score.multiclass_output(df, shares, best, ["low", "mid", "high"], ["p_partkey"])
    return rounded(out.select("p_partkey", "prediction", *[F.col("probabilities")[n].alias(n) for n in ("low", "mid", "high")]))


@query("score_regression", "SELECT p_partkey, round(exp(0.02 * p_size + 1) - 1, 6) AS prediction, 'regression' AS prediction_type FROM {part}")
def _(spark, sf):
    df = score.linear_score(table(spark, sf, "part"), ["p_size"], [0.02], 1.0)
    return rounded(score.regression_output(df, F.col("margin"), ["p_partkey"], log_target=True))


@query("score_clusters", """SELECT p_partkey, CAST(CASE WHEN abs(p_size - 10) <= abs(p_size - 40) THEN 0 ELSE 1 END AS INTEGER) AS cluster FROM {part}""")
def _(spark, sf):
    df = cluster.nearest_centre(table(spark, sf, "part"), ["p_size"], [[10.0], [40.0]])
    return score.cluster_output(df, F.col("cluster"), ["p_partkey"])


QUESTION = """SELECT p_partkey, p_brand, p_type, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS price,
  CASE WHEN p_retailprice + p_size * 3 < 1000 THEN 'yes' ELSE 'no' END AS cheap FROM {part}"""


def fitted(spark, sf) -> tuple[FittedModel, object]:
    """A model of the whole raw table, without a search."""
    df = run_sql(spark, sf, QUESTION)
    settings = Settings(target="cheap", id_cols=["p_partkey"])
    found = detect(df, "cheap", "classification")
    plan, matrix = prepare(df, run_audit(df, "cheap", id_cols=["p_partkey"]), found, settings)
    facts = search.Facts("classification", df.count(), 2, 1.0, False, 42)
    model = search.build("logistic_regression", {"c": 1.0}, plan.outputs, facts).fit(matrix)
    meta = {"problem": "classification", "model_name": "logistic_regression", "trained_at": timestamp(), "metrics": {"rows": float(facts.rows)}}
    return FittedModel(plan, plan.outputs, model, "supervised", meta), df.drop("cheap")


@query("score_batch", "SELECT p_partkey, CAST(2 AS INTEGER) AS labels FROM {part}")
def _(spark, sf):
    model, rows = fitted(spark, sf)
    return model.score(rows, ["p_partkey"]).select("p_partkey", F.size("class_labels").alias("labels"))


@query("score_single", "SELECT max(p_partkey) AS p_partkey, CAST(2 AS INTEGER) AS labels FROM {part}")
def _(spark, sf):
    model, rows = fitted(spark, sf)
    one = rows.where(F.col("p_partkey") == rows.agg(F.max("p_partkey")).scalar())
    return model.score(one, ["p_partkey"]).select("p_partkey", F.size("class_labels").alias("labels"))


@query("model_round_trip", "SELECT count(*) AS rows, CAST(0 AS DOUBLE) AS gap, CAST(0 AS BIGINT) AS changed FROM {part}")
def _(spark, sf):
    """A saved and loaded model gives the answers of the one in memory."""
    model, rows = fitted(spark, sf)
    loaded = FittedModel.load(model.save(scratch(spark, "model"), spark), spark)
    a = model.score(rows, ["p_partkey"])
    b = loaded.score(rows, ["p_partkey"]).select("p_partkey", F.col("prediction").alias("p2"), F.col("probability").alias("q2"))
    return a.join(b, "p_partkey").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.max(F.abs(F.col("probability") - F.col("q2"))), 9).alias("gap"),
        F.sum((F.col("prediction") != F.col("p2")).cast("bigint")).alias("changed"),
    )


@query("model_card", "SELECT 'logistic_regression' AS model_name, 'classification' AS problem, CAST(4 AS INTEGER) AS n_features, CAST(count(*) AS DOUBLE) AS rows FROM {part}")
def _(spark, sf):
    model, _ = fitted(spark, sf)
    return model.card(spark).select("model_name", "problem", "n_features", F.col("metrics")["rows"].alias("rows"))


@query("prepared_matrix")
def _(spark, sf):
    model, rows = fitted(spark, sf)
    return rounded(model.prepared.transform(rows, ["p_partkey"]))


@query("score_stream", "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM {part}")
def _(spark, sf):
    """A stream of files gets the answers of the batch."""
    model, rows = fitted(spark, sf)
    source, sink = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    score_stream(model, stream, sink, scratch(spark, "stream-state"), ["p_partkey"]).awaitTermination()
    a = spark.read.parquet(sink).select("p_partkey", F.col("prediction").alias("p1"))
    return a.join(model.score(rows, ["p_partkey"]), "p_partkey").agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col("prediction") != F.col("p1")).cast("bigint")).alias("changed")
    )
