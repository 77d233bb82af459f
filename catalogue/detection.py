"""What kind of problem is it?"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query, rounded, table
from plumbline.operators import audit, detect


def moments_sql(t, c):
    return f"""SELECT n, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) AS g1,
      avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) AS b2
    FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {{{t}}} WHERE {c} IS NOT NULL) v,
      (SELECT avg({c}) AS m, CAST(count({c}) AS DOUBLE) AS n FROM {{{t}}}) a GROUP BY n"""


def k2_sql(t, c):
    return f"""WITH mo AS ({moments_sql(t, c)}),
    a AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
      sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
      (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s FROM mo),
    b AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS aa FROM a)
    SELECT n, exp(-(zs * zs + power((1 - 2 / (9 * aa) - cbrt((1 - 2 / aa) / (1 + x * sqrt(2 / (aa - 4))))) / sqrt(2 / (9 * aa)), 2)) / 2) AS p FROM b"""


def gaps_sql(t, c):
    return f"""SELECT count(*) AS "distinct", coalesce(var_pop(gap), 0.0) AS gap_variance FROM (
      SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM (SELECT DISTINCT CAST({c} AS DOUBLE) AS v FROM {{{t}}} WHERE {c} IS NOT NULL) d) g"""


def entropy_sql(t, c):
    return f"""SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS "distinct", -sum(n / s * ln(n / s)) AS entropy FROM (
      SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM {{{t}}} WHERE {c} IS NOT NULL GROUP BY {c}) q"""


@query("normality_k2", f"SELECT 'o_totalprice' AS target, CAST(n AS BIGINT) AS rows, round(p, 6) + 0.0 AS p_normal FROM ({k2_sql('orders', 'o_totalprice')}) k UNION ALL SELECT 'value', CAST(n AS BIGINT), round(p, 6) + 0.0 FROM ({k2_sql('events', 'value')}) k")
def _(spark, sf):
    out = [
        detect.moments(table(spark, sf, t), c).select(F.lit(c).alias("target"), "rows", "p_normal")
        for t, c in (("orders", "o_totalprice"), ("events", "value"))
    ]
    return rounded(out[0].union(out[1]))


@query("integer_valued", """SELECT 'l_quantity' AS target, bool_and(l_quantity = floor(l_quantity)) AS integer_valued FROM {lineitem}
UNION ALL SELECT 'l_tax', bool_and(l_tax = floor(l_tax)) FROM {lineitem}""")
def _(spark, sf):
    df = table(spark, sf, "lineitem")
    out = [detect.moments(df, c).select(F.lit(c).alias("target"), "integer_valued") for c in ("l_quantity", "l_tax")]
    return out[0].union(out[1])


@query("target_entropy", " UNION ALL ".join(f"SELECT '{c}' AS target, rows, \"distinct\", round(entropy, 6) AS entropy FROM ({entropy_sql(t, c)}) e" for t, c in (("events", "event_type"), ("lineitem", "l_quantity"), ("orders", "o_totalprice"))))
def _(spark, sf):
    out = [
        detect.value_entropy(table(spark, sf, t), c).select(F.lit(c).alias("target"), "*")
        for t, c in (("events", "event_type"), ("lineitem", "l_quantity"), ("orders", "o_totalprice"))
    ]
    return rounded(out[0].union(out[1]).union(out[2]))


@query("gap_variance", " UNION ALL ".join(f"SELECT '{c}' AS target, \"distinct\", round(gap_variance, 4) + 0.0 AS gap_variance FROM ({gaps_sql(t, c)}) g" for t, c in (("lineitem", "l_quantity"), ("orders", "o_totalprice"))))
def _(spark, sf):
    out = [
        detect.gap_variance(table(spark, sf, t), c).select(F.lit(c).alias("target"), "*")
        for t, c in (("lineitem", "l_quantity"), ("orders", "o_totalprice"))
    ]
    return rounded(out[0].union(out[1]), 4)


def votes_sql(t, c, kind):
    """Evidence and scores; the Shapiro vote of small tables is not stated in SQL."""
    if kind == "category":
        ev = f"""SELECT rows, "distinct" AS d, entropy AS e, 0.0 AS g, FALSE AS whole, 0.0 AS p, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM ({entropy_sql(t, c)}) x"""
    else:
        ev = f"""SELECT x.rows, x."distinct" AS d, entropy AS e, gap_variance AS g, whole, CASE WHEN x.rows > 5000 THEN p ELSE 0.0 END AS p, lo, hi
          FROM ({entropy_sql(t, c)}) x, ({gaps_sql(t, c)}) y, ({k2_sql(t, c)}) z,
          (SELECT bool_and({c} = floor({c})) AS whole, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {{{t}}}) w"""
    numeric = "FALSE" if kind == "category" else "TRUE"
    real = "TRUE" if kind == "number" else "FALSE"
    return f"""SELECT *, (CASE WHEN e > 0 AND e < 1 THEN 2.0 ELSE 0 END + CASE WHEN {numeric} AND d > 2 AND g < 0.1 THEN 1.0 ELSE 0 END
        + CASE WHEN NOT {numeric} THEN 3.0 ELSE 0 END + CASE WHEN d <= 2 THEN 4.0 WHEN d <= 5 THEN 2.5 ELSE 0 END)::DOUBLE AS cs,
      (CASE WHEN e > 2.5 THEN 2.0 ELSE 0 END + CASE WHEN {numeric} AND p > 0.05 THEN 2.5 ELSE 0 END
        + CASE WHEN {numeric} AND d > 2 AND g > 5 THEN 1.0 ELSE 0 END + CASE WHEN {real} AND NOT whole THEN 3.0 ELSE 0 END
        + CASE WHEN d > 50 AND {numeric} THEN 2.0 ELSE 0 END)::DOUBLE AS rs,
      {numeric} AND (whole OR NOT {real}) AND d > 5 AND d <= 100 AS unclear FROM ({ev}) ev"""


def decide_sql(t, c, kind, choice="classification"):
    return f"""WITH v AS ({votes_sql(t, c, kind)}),
    w AS (SELECT *, unclear OR cs = rs AS asked, CASE WHEN unclear OR cs = rs THEN '{choice}' WHEN cs > rs THEN 'classification' ELSE 'regression' END AS problem FROM v)
    SELECT '{c}' AS target, problem,
      CASE WHEN asked THEN 'high' WHEN greatest(cs, rs) / (cs + rs) >= 0.75 THEN 'high' WHEN greatest(cs, rs) / (cs + rs) >= 0.6 THEN 'medium' ELSE 'low' END AS confidence,
      asked AS ambiguous, cs AS class_score, rs AS value_score, d AS "distinct",
      CASE WHEN problem = 'classification' THEN CASE WHEN d = 2 THEN 'binary' WHEN d BETWEEN 3 AND 15 THEN 'multiclass' ELSE 'many_class' END
        WHEN lo IS NULL THEN 'standard' WHEN lo >= 0 AND hi <= 1 THEN 'probability' WHEN lo >= 0 THEN 'bounded_positive' ELSE 'unbounded' END AS subtype FROM w"""


TARGETS = [
    ("lineitem", "l_linestatus", "category"), ("orders", "o_orderstatus", "category"),
    ("events", "event_type", "category"), ("orders", "o_totalprice", "number"),
    ("lineitem", "l_quantity", "number"), ("lineitem", "l_discount", "number"),
    ("labels", "toxic", "integer"), ("customer", "c_nationkey", "integer"), ("customer", "c_acctbal", "number"),
]


def _register(t, c, kind):
    @query(f"detect_{c}", decide_sql(t, c, kind))
    def _(spark, sf):
        # Small tables: the SQL states every vote but Shapiro's, so it is left out on both sides.
        return detect.decide(detect.evidence(table(spark, sf, t), c, shapiro=False))


for _t, _c, _kind in TARGETS:
    _register(_t, _c, _kind)


@query("detect_choose_regression", decide_sql("lineitem", "l_quantity", "number", "regression"))
def _(spark, sf):
    return detect.decide(detect.evidence(table(spark, sf, "lineitem"), "l_quantity"), "regression")


@query("detect_votes", f"""WITH v AS ({votes_sql('lineitem', 'l_quantity', 'number')})
SELECT 'l_quantity' AS target, 'entropy' AS signal, round(e, 6) AS value, CASE WHEN e < 1 THEN 'classification' ELSE 'regression' END AS vote, 2.0::DOUBLE AS weight FROM v WHERE e > 0 AND (e < 1 OR e > 2.5)
UNION ALL SELECT 'l_quantity', 'gap_variance', round(g, 6) + 0.0, CASE WHEN g < 0.1 THEN 'classification' ELSE 'regression' END, 1.0 FROM v WHERE g < 0.1 OR g > 5
UNION ALL SELECT 'l_quantity', 'normality', round(p, 6), 'regression', 2.5 FROM v WHERE p > 0.05""")
def _(spark, sf):
    return rounded(detect.votes(detect.evidence(table(spark, sf, "lineitem"), "l_quantity")))


@query("detect_override", "SELECT 'o_orderpriority' AS target, 'classification' AS problem, 'high' AS confidence, 'user' AS method, CASE WHEN count(DISTINCT o_orderpriority) = 2 THEN 'binary' WHEN count(DISTINCT o_orderpriority) <= 15 THEN 'multiclass' ELSE 'many_class' END AS subtype FROM {orders}")
def _(spark, sf):
    d = detect.detect(table(spark, sf, "orders"), "o_orderpriority", force="classification")
    return spark.createDataFrame([("o_orderpriority", d.problem, d.confidence, d.method, d.subtype)], "target string, problem string, confidence string, method string, subtype string")


@query("regression_subtype", """SELECT 'l_discount' AS target, CASE WHEN min(l_discount) >= 0 AND max(l_discount) <= 1 THEN 'probability' WHEN min(l_discount) >= 0 THEN 'bounded_positive' ELSE 'unbounded' END AS subtype FROM {lineitem}
UNION ALL SELECT 'l_extendedprice', CASE WHEN min(l_extendedprice) >= 0 AND max(l_extendedprice) <= 1 THEN 'probability' WHEN min(l_extendedprice) >= 0 THEN 'bounded_positive' ELSE 'unbounded' END FROM {lineitem}
UNION ALL SELECT 'c_acctbal', CASE WHEN min(c_acctbal) >= 0 AND max(c_acctbal) <= 1 THEN 'probability' WHEN min(c_acctbal) >= 0 THEN 'bounded_positive' ELSE 'unbounded' END FROM {customer}""")
def _(spark, sf):
    rows = []
    for t, c in (("lineitem", "l_discount"), ("lineitem", "l_extendedprice"), ("customer", "c_acctbal")):
        m = detect.moments(table(spark, sf, t), c).withColumn("distinct", F.lit(0))
        rows.append(m.select(F.lit(c).alias("target"), detect.subtype(F.lit("regression")).alias("subtype")))
    return rows[0].union(rows[1]).union(rows[2])


@query("log_target", f"""SELECT 'value' AS target, round(g1, 6) AS skew, abs(g1) > 1 AND (SELECT min(value) >= 0 FROM {{events}}) AS log_target FROM ({moments_sql('events', 'value')}) m""")
def _(spark, sf):
    return rounded(detect.log_target(detect.evidence(table(spark, sf, "events"), "value")))


@query("sanity_warnings", """SELECT 'l_linestatus' AS target, 'regression' AS problem, count(DISTINCT l_linestatus) AS "distinct", 'regression on a target of two values or fewer' AS warning FROM {lineitem} HAVING count(DISTINCT l_linestatus) <= 2
UNION ALL SELECT 'o_totalprice', 'classification', count(DISTINCT o_totalprice), 'classification on a real-valued target with more than 50 values' FROM {orders} HAVING count(DISTINCT o_totalprice) > 50""")
def _(spark, sf):
    a = detect.sanity(detect.evidence(table(spark, sf, "lineitem"), "l_linestatus"), "regression")
    b = detect.sanity(detect.evidence(table(spark, sf, "orders"), "o_totalprice"), "classification")
    return a.union(b)


@query("feature_mix", "SELECT round(CAST(sum(CASE WHEN min_b THEN 0 ELSE 1 END) AS DOUBLE) / (sum(CASE WHEN min_b THEN 0 ELSE 1 END) + 3), 6) AS numeric_share, CASE WHEN CAST(sum(CASE WHEN min_b THEN 0 ELSE 1 END) AS DOUBLE) / (sum(CASE WHEN min_b THEN 0 ELSE 1 END) + 3) > 0.75 THEN 'regression' WHEN CAST(sum(CASE WHEN min_b THEN 0 ELSE 1 END) AS DOUBLE) / (sum(CASE WHEN min_b THEN 0 ELSE 1 END) + 3) < 0.25 THEN 'classification' ELSE 'neutral' END AS vote, CASE WHEN CAST(sum(CASE WHEN min_b THEN 0 ELSE 1 END) AS DOUBLE) / (sum(CASE WHEN min_b THEN 0 ELSE 1 END) + 3) BETWEEN 0.25 AND 0.75 THEN 0.0 ELSE 0.5 END::DOUBLE AS weight FROM (SELECT bool_and(p_partkey IN (0, 1)) AS min_b FROM {part} UNION ALL SELECT bool_and(p_size IN (0, 1)) FROM {part} UNION ALL SELECT bool_and(p_retailprice IN (0, 1)) FROM {part}) b")
def _(spark, sf):
    return rounded(detect.feature_mix(audit.logical_types(table(spark, sf, "part"))))
