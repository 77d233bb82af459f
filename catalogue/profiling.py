"""Sources, drops and the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query, rounded, run_sql, table
from plumbline.functions.columns import scratch
from plumbline.operators import association, audit, drops, findings
from plumbline.sources import tables

# A table with every pathology the audit looks for, written alike for both engines.
LINES = """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS qty,
  l_extendedprice AS price,
  l_extendedprice * (1 - l_discount) AS net,
  l_discount AS discount,
  CASE WHEN l_orderkey % 100 < 95 THEN NULL ELSE l_tax END AS mostly_null,
  CAST(1 AS DOUBLE) AS constant,
  CASE WHEN l_orderkey % 500 = 0 THEN 'a' ELSE 'b' END AS nearly_constant,
  l_returnflag AS flag, l_linestatus AS status
FROM {lineitem}
"""
LINE_NUMERIC = ["qty", "price", "net", "discount", "mostly_null"]

# Rows repeated on purpose, nulls included.
REPEATED = """
SELECT o_custkey % 50 AS a, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS b, o_orderpriority AS c
FROM {orders}
"""

SKEWED = "SELECT event_id, value, value * value AS squared, -value AS negative, CAST(user_id AS DOUBLE) AS user_id FROM {events}"


def _each(cols, template, source):
    parts = [template.replace("{c}", c) for c in cols]
    return f"WITH x AS ({source}) " + " UNION ALL ".join(parts)


@query("csv_round_trip", "SELECT c_custkey, c_name, CAST(c_nationkey AS INTEGER) AS c_nationkey, c_acctbal, c_mktsegment FROM {customer}")
def _(spark, sf):
    path = scratch(spark, "csv")
    tables.write_table(table(spark, sf, "customer"), path, format="csv")
    return tables.read_table(
        spark, path, format="csv",
        schema="c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    )


@query("csv_inferred", "SELECT CAST(o_orderkey AS BIGINT) AS k, round(o_totalprice, 2) AS p, o_orderstatus AS s FROM {orders}")
def _(spark, sf):
    path = scratch(spark, "csv")
    tables.write_table(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, format="csv", sep=";")
    df = tables.read_table(spark, path, format="csv", sep=";")
    return df.select(F.col("o_orderkey").cast("bigint").alias("k"), F.round("o_totalprice", 2).alias("p"), F.col("o_orderstatus").alias("s"))


@query("input_shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM {lineitem}")
def _(spark, sf):
    return tables.describe_input(table(spark, sf, "lineitem"))


@query("records_table", "SELECT c_custkey, c_mktsegment, c_acctbal FROM {customer}")
def _(spark, sf):
    cols = ["c_custkey", "c_mktsegment", "c_acctbal"]
    records = table(spark, sf, "customer").select(F.to_json(F.struct(*cols)).alias("value"))
    return tables.records_table(records, "c_custkey bigint, c_mktsegment string, c_acctbal double")


@query("drop_duplicates", f"SELECT DISTINCT * FROM ({REPEATED}) x")
def _(spark, sf):
    return drops.drop_duplicates(run_sql(spark, sf, REPEATED))


@query("drop_duplicates_keyed", f"SELECT a, b, c, min(k) AS k FROM (SELECT o_custkey % 50 AS a, o_orderstatus AS b, o_orderpriority AS c, o_orderkey AS k FROM {{orders}}) x GROUP BY a, b, c")
def _(spark, sf):
    df = run_sql(spark, sf, "SELECT o_custkey % 50 AS a, o_orderstatus AS b, o_orderpriority AS c, o_orderkey AS k FROM {orders}")
    return drops.drop_duplicates(df, ["k"])


@query("drop_listed", "SELECT c_custkey, c_nationkey, c_acctbal FROM {customer}")
def _(spark, sf):
    return drops.drop_listed(table(spark, sf, "customer"), ["c_name", "c_mktsegment"])


@query("drop_found", f"SELECT l_orderkey, l_linenumber, qty, price, net, discount, flag, status FROM ({LINES}) x")
def _(spark, sf):
    df = run_sql(spark, sf, LINES)
    return drops.drop_found(df, findings.drop_ledger(findings.structural_findings(df)))


@query("drop_null_target", f"SELECT l_orderkey, qty FROM ({LINES}) x WHERE qty IS NOT NULL")
def _(spark, sf):
    return drops.with_target(run_sql(spark, sf, LINES), "qty").select("l_orderkey", "qty")


@query("split_target", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM {orders}")
def _(spark, sf):
    x, _ = drops.split_target(table(spark, sf, "orders").drop("o_orderdate"), "o_orderstatus")
    return x


@query("strict_order", "SELECT c_mktsegment, c_acctbal, c_custkey FROM {customer}")
def _(spark, sf):
    return drops.in_order(table(spark, sf, "customer"), ["c_mktsegment", "c_acctbal", "c_custkey"])


@query("numeric_columns", "SELECT p_partkey, p_size, p_retailprice FROM {part}")
def _(spark, sf):
    df = table(spark, sf, "part")
    return df.select(*drops.by_type(df)[0])


@query("audit_shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM {lineitem}")
def _(spark, sf):
    return audit.table_shape(table(spark, sf, "lineitem"))


@query(
    "audit_memory",
    """SELECT 'c_custkey' AS "column", CAST(count(c_custkey) * 8 AS BIGINT) AS bytes FROM {customer}
    UNION ALL SELECT 'c_name', CAST(sum(strlen(c_name)) AS BIGINT) FROM {customer}
    UNION ALL SELECT 'c_nationkey', CAST(count(c_nationkey) * 4 AS BIGINT) FROM {customer}
    UNION ALL SELECT 'c_acctbal', CAST(count(c_acctbal) * 8 AS BIGINT) FROM {customer}
    UNION ALL SELECT 'c_mktsegment', CAST(sum(strlen(c_mktsegment)) AS BIGINT) FROM {customer}""",
)
def _(spark, sf):
    return audit.memory(table(spark, sf, "customer"))


@query(
    "audit_size_class",
    """SELECT count(*) AS rows, CASE WHEN count(*) < 500 THEN 'very_small' WHEN count(*) < 5000 THEN 'small'
    WHEN count(*) < 50000 THEN 'medium' ELSE 'large' END AS size_class, count(*) > 50000 AS sampling_advised,
    CASE WHEN count(*) > 50000 THEN round(CAST(50000 AS DOUBLE) / count(*), 3) END AS sampling_share FROM {lineitem}""",
)
def _(spark, sf):
    return audit.size_class(table(spark, sf, "lineitem"))


@query(
    "audit_sample",
    """WITH n AS (SELECT count(*) AS n FROM {orders})
    SELECT o_orderkey FROM {orders}, n WHERE n.n <= 10000 OR
    CAST('0x' || substr(md5('sample' || CAST(o_orderkey AS VARCHAR)), 1, 13) AS BIGINT)
      < CAST(floor(CAST(10000 AS DOUBLE) / n.n * 4503599627370496) AS BIGINT)""",
)
def _(spark, sf):
    return audit.hash_sample(table(spark, sf, "orders"), ["o_orderkey"], 10_000).select("o_orderkey")


@query("audit_duplicates", f"SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM ({REPEATED}) x GROUP BY a, b, c) g")
def _(spark, sf):
    return audit.duplicate_rows(run_sql(spark, sf, REPEATED))


@query(
    "audit_target",
    f"""SELECT 'qty' AS target, 'double' AS spark_type, count(*) AS rows,
    round(avg(CASE WHEN qty IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, count(DISTINCT qty) AS "distinct" FROM ({LINES}) x""",
)
def _(spark, sf):
    return rounded(audit.target_profile(run_sql(spark, sf, LINES), "qty"))


CLASSES = """SELECT CAST(event_type AS VARCHAR) AS "class", count(*) AS n,
  CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM {events} GROUP BY event_type"""


@query("audit_class_shares", f'SELECT "class", n, round(share, 6) AS share FROM ({CLASSES}) s')
def _(spark, sf):
    return rounded(audit.class_shares(table(spark, sf, "events"), "event_type"))


@query(
    "audit_imbalance",
    """WITH s AS (SELECT CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM {orders} GROUP BY o_orderkey % 29 = 0)
    SELECT round(min(share), 6) AS ratio, min(share) < 0.1 AS imbalanced,
    CASE WHEN min(share) < 0.05 THEN 'severe' WHEN min(share) < 0.1 THEN 'moderate' ELSE 'balanced' END AS severity,
    min(share) < 0.1 AS resample_advised FROM s""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select((F.col("o_orderkey") % 29 == 0).alias("rare"))
    return rounded(audit.imbalance(audit.class_shares(df, "rare")))


@query(
    "audit_types",
    """SELECT 'o_orderkey' AS "column", 'bigint' AS spark_type, 'numeric' AS logical_type
    UNION ALL SELECT 'o_totalprice', 'double', 'numeric'
    UNION ALL SELECT 'o_orderpriority', 'string', 'categorical'
    UNION ALL SELECT 'flag_number', 'int', (SELECT CASE WHEN bool_and(o_custkey % 2 IN (0, 1)) THEN 'boolean' ELSE 'numeric' END FROM {orders})
    UNION ALL SELECT 'flag_text', 'string', 'boolean'
    UNION ALL SELECT 'all_null', 'double', 'boolean'
    UNION ALL SELECT 'when_text', 'string', (SELECT CASE WHEN avg(CASE WHEN try_cast(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.8 THEN 'datetime' ELSE 'categorical' END FROM {orders})
    UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', 'datetime'""",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderpriority",
        (F.col("o_custkey") % 2).cast("int").alias("flag_number"),
        F.when(F.col("o_custkey") % 2 == 0, "True").otherwise("False").alias("flag_text"),
        F.lit(None).cast("double").alias("all_null"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("when_text"), "o_orderdate",
    )
    return audit.logical_types(df)


@query(
    "audit_types_first_value",
    """SELECT 'when_text' AS "column", 'string' AS spark_type,
    CASE WHEN try_cast(arg_min(t, k) AS TIMESTAMP) IS NOT NULL THEN 'datetime' ELSE 'categorical' END AS logical_type
    FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 1 THEN 'not-a-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM {orders}) x""",
)
def _(spark, sf):
    df = run_sql(
        spark, sf,
        "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN 'not-a-date' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS when_text FROM {orders}",
    )
    return audit.logical_types(df, ["when_text"], order_key="o_orderkey")


@query(
    "audit_missing",
    _each(["qty", "mostly_null"], """SELECT '{c}' AS "column", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.9 AS "drop" FROM x""", LINES),
)
def _(spark, sf):
    return rounded(audit.missing_shares(run_sql(spark, sf, LINES)))


@query(
    "audit_stats",
    _each(LINE_NUMERIC, """SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
    round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max FROM x""", LINES),
)
def _(spark, sf):
    return rounded(audit.numeric_stats(run_sql(spark, sf, LINES), LINE_NUMERIC), 4)


ALL_LINES = ["l_orderkey", "l_linenumber", *LINE_NUMERIC, "constant", "nearly_constant", "flag", "status"]
CARD = _each(ALL_LINES, """SELECT '{c}' AS "column", count(*) AS "distinct", CAST(sum(n) AS BIGINT) AS present, max(n) AS top
  FROM (SELECT {c}, count(*) AS n FROM x WHERE {c} IS NOT NULL GROUP BY {c}) g""", LINES)


@query("audit_distinct", CARD)
def _(spark, sf):
    return audit.cardinality(run_sql(spark, sf, LINES))


@query(
    "audit_quasi_constant",
    f"""SELECT "column", "distinct", round(CAST(top AS DOUBLE) / present, 6) AS top_share FROM ({CARD}) c
    WHERE "distinct" <= 1 OR ("distinct" = 2 AND CAST(top AS DOUBLE) / present > 0.99)""",
)
def _(spark, sf):
    return rounded(audit.quasi_constant(audit.cardinality(run_sql(spark, sf, LINES))))


@query(
    "audit_id_like",
    """SELECT 'c_custkey' AS "column", count(*) AS "distinct" FROM {customer} HAVING count(DISTINCT c_custkey) = count(c_custkey)
    UNION ALL SELECT 'c_name', count(*) FROM {customer} HAVING count(DISTINCT c_name) = count(c_name)""",
)
def _(spark, sf):
    df = table(spark, sf, "customer")
    return audit.id_like(df, audit.cardinality(df))


@query(
    "audit_high_cardinality",
    """SELECT 'p_brand' AS "column", count(DISTINCT p_brand) AS "distinct" FROM {part} HAVING count(DISTINCT p_brand) > 15
    UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM {part} HAVING count(DISTINCT p_name) > 15
    UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM {part} HAVING count(DISTINCT p_type) > 15""",
)
def _(spark, sf):
    df = table(spark, sf, "part")
    kinds = audit.logical_types(df).where("logical_type = 'categorical'").select("column")
    return audit.cardinality(df).join(F.broadcast(kinds), "column").where("distinct > 15").select("column", "distinct")


@query(
    "audit_outliers",
    _each(["value", "squared", "negative"], """SELECT '{c}' AS "column", round(q1, 4) AS q1, round(q3, 4) AS q3, round(s, 6) AS outlier_share,
    CASE WHEN s > 0.1 THEN 'significant' WHEN s > 0.05 THEN 'moderate' ELSE 'none' END AS severity
    FROM (SELECT any_value(q1) AS q1, any_value(q3) AS q3, avg(CASE WHEN {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS s
      FROM x, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM x) q) r""", SKEWED),
)
def _(spark, sf):
    out = audit.outlier_shares(run_sql(spark, sf, SKEWED), ["value", "squared", "negative"])
    return out.select("column", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), F.round("outlier_share", 6).alias("outlier_share"), "severity")


@query(
    "audit_skew",
    _each(["value", "squared", "negative", "user_id"], """SELECT '{c}' AS "column", round(s, 6) AS skew, abs(s) > 1 AS skewed,
    CASE WHEN abs(s) > 1 AND lo >= 0 THEN 'log_transform' ELSE 'none' END AS action
    FROM (SELECT avg(power({c} - m, 3)) / power(avg(power({c} - m, 2)), 1.5) AS s, min({c}) AS lo FROM x, (SELECT avg({c}) AS m FROM x) a) r""", SKEWED),
)
def _(spark, sf):
    return rounded(audit.skewness(run_sql(spark, sf, SKEWED), ["value", "squared", "negative", "user_id"]))


PAIR_COLS = ["qty", "price", "net", "discount"]


@query(
    "pearson_pairs",
    f"WITH x AS ({LINES}) " + " UNION ALL ".join(
        f"SELECT '{b}' AS later, '{a}' AS earlier, round(abs(corr({a}, {b})), 6) AS r FROM x"
        for i, a in enumerate(PAIR_COLS) for b in PAIR_COLS[i + 1 :]
    ),
)
def _(spark, sf):
    return rounded(association.pearson_pairs(run_sql(spark, sf, LINES), PAIR_COLS))


@query("correlated_pairs", f"WITH x AS ({LINES}) SELECT 'net' AS later, 'price' AS earlier, round(abs(corr(price, net)), 6) AS r FROM x HAVING abs(corr(price, net)) > 0.95")
def _(spark, sf):
    return rounded(association.pearson_pairs(run_sql(spark, sf, LINES), PAIR_COLS, above=0.95))


def _spearman(col, target, source):
    return f"""SELECT '{col}' AS "column", count(*) AS rows, round(corr(rx, ry), 6) + 0.0 AS rho FROM (
      SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS ry
      FROM (SELECT {col} AS a, {target} AS b FROM ({source}) s WHERE {col} IS NOT NULL AND {target} IS NOT NULL) p) r"""


@query("spearman", " UNION ALL ".join(_spearman(c, "net", LINES) for c in ["qty", "price", "discount"]))
def _(spark, sf):
    return rounded(association.spearman(run_sql(spark, sf, LINES), ["qty", "price", "discount"], "net"))


@query("spearman_text_target", _spearman("price", "flag", LINES))
def _(spark, sf):
    return rounded(association.spearman(run_sql(spark, sf, LINES), ["price"], "flag"))


@query(
    "spearman_leakage",
    f"""SELECT "column", round(abs(rho), 6) AS score, 'spearman' AS signal FROM ({" UNION ALL ".join(_spearman(c, "net", LINES) for c in ["qty", "price", "discount"])}) s WHERE abs(rho) > 0.95""",
)
def _(spark, sf):
    rho = association.spearman(run_sql(spark, sf, LINES), ["qty", "price", "discount"], "net")
    return rounded(association.leakage(rho, "rho", "spearman"))


ORDER_CATS = """SELECT o_orderstatus AS y, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  lower(o_orderstatus) AS leak, CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE o_orderstatus END AS partial FROM {orders}"""


def _mi(col, scale):
    return f"""SELECT '{col}' AS "column", max(t.n) AS rows,
      round(sum(j.n * 1.0 / t.n * ln(j.n * 1.0 * t.n / (a.n * 1.0 * b.n))), 6) + 0.0 AS mi,
      round(sum(j.n * 1.0 / t.n * ln(j.n * 1.0 * t.n / (a.n * 1.0 * b.n))) / max({scale}), 6) + 0.0 AS score
    FROM (SELECT coalesce({col}, 'missing') AS v, y, count(*) AS n FROM x GROUP BY 1, 2) j
    JOIN (SELECT coalesce({col}, 'missing') AS v, count(*) AS n FROM x GROUP BY 1) a ON a.v = j.v
    JOIN (SELECT y, count(*) AS n FROM x GROUP BY 1) b ON b.y = j.y,
    (SELECT count(*) AS n FROM x) t,
    (SELECT -sum(n * 1.0 / s * ln(n * 1.0 / s)) AS h FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS s FROM x GROUP BY y) q) e"""


@query("mutual_information", f"WITH x AS ({ORDER_CATS}) " + " UNION ALL ".join(_mi(c, "e.h") for c in ["priority", "leak", "partial"]))
def _(spark, sf):
    return rounded(association.mutual_information(run_sql(spark, sf, ORDER_CATS), ["priority", "leak", "partial"], "y"))


@query("mutual_information_log_rows", f"WITH x AS ({ORDER_CATS}) " + " UNION ALL ".join(_mi(c, "ln(t.n)") for c in ["priority", "leak", "partial"]))
def _(spark, sf):
    return rounded(association.mutual_information(run_sql(spark, sf, ORDER_CATS), ["priority", "leak", "partial"], "y", "log_n"))


@query("mi_leakage", f"""WITH x AS ({ORDER_CATS}), m AS ({" UNION ALL ".join(_mi(c, "e.h") for c in ["priority", "leak", "partial"])})
SELECT "column", score, 'mutual_info' AS signal FROM m WHERE score > 0.95""")
def _(spark, sf):
    scores = association.mutual_information(run_sql(spark, sf, ORDER_CATS), ["priority", "leak", "partial"], "y")
    return rounded(association.leakage(scores, "score", "mutual_info"))


@query(
    "audit_findings",
    f"""WITH c AS ({CARD}), n AS (SELECT count(*) AS rows FROM {{lineitem}}) SELECT "column", reason FROM (
      SELECT "column", CASE WHEN "distinct" <= 1 OR ("distinct" = 2 AND CAST(top AS DOUBLE) / present > 0.99) THEN 'quasi_constant'
        WHEN 1 - CAST(present AS DOUBLE) / n.rows > 0.9 THEN 'missing' END AS reason FROM c, n) r WHERE reason IS NOT NULL""",
)
def _(spark, sf):
    return findings.drop_ledger(findings.structural_findings(run_sql(spark, sf, LINES)))


@query(
    "audit_findings_user_drops",
    f"""WITH c AS ({CARD}), n AS (SELECT count(*) AS rows FROM {{lineitem}}) SELECT "column", reason FROM (
      SELECT "column", CASE WHEN "distinct" <= 1 OR ("distinct" = 2 AND CAST(top AS DOUBLE) / present > 0.99) THEN 'quasi_constant'
        WHEN 1 - CAST(present AS DOUBLE) / n.rows > 0.9 THEN 'missing' END AS reason FROM c, n) r
    WHERE reason IS NOT NULL AND "column" <> 'constant'""",
)
def _(spark, sf):
    return findings.drop_ledger(findings.structural_findings(run_sql(spark, sf, LINES)), ["constant"])


def _profile(c, numeric):
    if numeric:
        extra = f"""round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std,
          CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max"""
    else:
        extra = "NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max"
    return f"""SELECT '{c}' AS "column", count(*) AS rows, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing,
      count(DISTINCT {c}) AS "distinct", {extra} FROM {{lineitem}}"""


@query("column_profile", " UNION ALL ".join(
    _profile(c, c not in ("l_returnflag", "l_linestatus", "l_shipdate"))
    for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
))
def column_profile(spark, sf):
    out = audit.column_profile(table(spark, sf, "lineitem"))
    return out.select(
        "column", "rows", F.round("missing", 6).alias("missing"), "distinct",
        *[F.round(c, 4).alias(c) for c in ("mean", "median", "std")], "min", "max",
    )
