"""Repairs, encoders and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import query, rounded, run_sql, table
from plumbline.operators import clean, encode, split

GAPPED = """SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS who,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS kind FROM {events}"""

MIXED = """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'n/a' ELSE CAST(o_custkey AS {text}) END AS mostly_number,
  CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE CAST(o_custkey AS {text}) END AS half_number,
  CASE WHEN o_orderkey % 2 = 0 THEN ' 7 ' ELSE '1e3' END AS padded FROM {orders}"""
MIXED_SPARK, MIXED_SQL = MIXED.replace("{text}", "STRING"), MIXED.replace("{text}", "VARCHAR")


@query("clip_outliers", f"""WITH x AS ({GAPPED}), q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM x)
SELECT event_id, round(CASE WHEN value IS NOT NULL THEN greatest(least(value, hi), lo) END, 6) AS value FROM x, q""")
def _(spark, sf):
    df = run_sql(spark, sf, GAPPED)
    lo, hi = clean.clip_bounds(df, ["value"])["value"]
    return rounded(clean.select_as(df, {"value": clean.clip("value", lo, hi)}, ["event_id"]))


@query("clip_bounds", f"""WITH x AS ({GAPPED}) SELECT 'value' AS "column", round(quantile_cont(value, 0.01), 6) AS low, round(quantile_cont(value, 0.99), 6) AS high FROM x
UNION ALL SELECT 'who', round(quantile_cont(who, 0.01), 6), round(quantile_cont(who, 0.99), 6) FROM x""")
def _(spark, sf):
    found = clean.clip_bounds(run_sql(spark, sf, GAPPED), ["value", "who"])
    return rounded(spark.createDataFrame([(c, *b) for c, b in found.items()], "column string, low double, high double"))


@query("log1p_skewed", f"SELECT event_id, round(ln(1 + value), 6) AS value FROM ({GAPPED}) x")
def _(spark, sf):
    return rounded(clean.select_as(run_sql(spark, sf, GAPPED), {"value": clean.log1p("value")}, ["event_id"]))


DOC_SOURCES = "SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN 'odd-' || (doc_id % 5) WHEN doc_id % 19 = 0 THEN NULL ELSE source END AS source FROM {documents}"


@query("rare_categories", f"""WITH x AS ({DOC_SOURCES}), f AS (SELECT source, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM x WHERE source IS NOT NULL GROUP BY source)
SELECT doc_id, CASE WHEN share < 0.01 THEN '__other__' ELSE x.source END AS source FROM x LEFT JOIN f ON f.source = x.source""")
def _(spark, sf):
    df = run_sql(spark, sf, DOC_SOURCES)
    keep = clean.common_values(df, ["source"])
    return clean.select_as(df, {"source": clean.group_rare("source", keep["source"]) if keep else "source"}, ["doc_id"])


@query("boolean_cast", """SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(o_custkey % 2 AS DOUBLE) END AS from_text, CAST(o_custkey % 2 AS DOUBLE) AS from_flag FROM {orders}""")
def _(spark, sf):
    df = run_sql(
        spark, sf,
        "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'maybe' WHEN o_custkey % 2 = 1 THEN 'True' ELSE '0' END AS t, o_custkey % 2 = 1 AS f FROM {orders}",
    )
    return clean.select_as(df, {"from_text": clean.boolean("t", "string"), "from_flag": clean.boolean("f", "boolean")}, ["o_orderkey"])


@query("datetime_parts", """SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS d_year, CAST(month(o_orderdate) AS DOUBLE) AS d_month,
CAST(day(o_orderdate) AS DOUBLE) AS d_day, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS d_dow FROM {orders}""")
def _(spark, sf):
    return clean.select_as(table(spark, sf, "orders"), clean.date_parts("d", "o_orderdate"), ["o_orderkey"])


@query("datetime_parts_text", """SELECT o_orderkey, CAST(year(t) AS DOUBLE) AS d_year, CAST(month(t) AS DOUBLE) AS d_month,
CAST(day(t) AS DOUBLE) AS d_day, CAST(isodow(t) - 1 AS DOUBLE) AS d_dow FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderdate END AS t FROM {orders}) x""")
def _(spark, sf):
    df = run_sql(spark, sf, "SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'unknown-date' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS t FROM {orders}")
    return clean.select_as(df, clean.date_parts("d", "t"), ["o_orderkey"])


@query("coerce_share", f"""WITH x AS ({MIXED_SQL}) SELECT 'mostly_number' AS "column", round(avg(CASE WHEN try_cast(mostly_number AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM x
UNION ALL SELECT 'half_number', round(avg(CASE WHEN try_cast(half_number AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM x
UNION ALL SELECT 'padded', round(avg(CASE WHEN try_cast(padded AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM x""")
def _(spark, sf):
    return rounded(clean.coercible(run_sql(spark, sf, MIXED_SPARK), ["mostly_number", "half_number", "padded"]))


@query("coerce_numeric", f"SELECT o_orderkey, try_cast(mostly_number AS DOUBLE) AS mostly_number, half_number, try_cast(padded AS DOUBLE) AS padded FROM ({MIXED_SQL}) x")
def _(spark, sf):
    df = run_sql(spark, sf, MIXED_SPARK)
    cols = ["mostly_number", "half_number", "padded"]
    good = clean.coerced(df, cols)
    return clean.select_as(df, {c: clean.to_number(c) if c in good else c for c in cols}, ["o_orderkey"])


@query("label_encode", "SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type FROM {events}")
def _(spark, sf):
    return encode.label_encode(table(spark, sf, "events").select("event_id", "event_type"), "event_type")


@query("outlier_cell_share", f"""WITH x AS (SELECT coalesce(value, 0) AS a, coalesce(who, 0) AS b FROM ({GAPPED}) g),
q AS (SELECT quantile_cont(a, 0.25) AS a1, quantile_cont(a, 0.75) AS a3, quantile_cont(b, 0.25) AS b1, quantile_cont(b, 0.75) AS b3 FROM x),
s AS (SELECT (avg(CASE WHEN a < a1 - 1.5 * (a3 - a1) OR a > a3 + 1.5 * (a3 - a1) THEN 1.0 ELSE 0.0 END) + avg(CASE WHEN b < b1 - 1.5 * (b3 - b1) OR b > b3 + 1.5 * (b3 - b1) THEN 1.0 ELSE 0.0 END)) / 2 AS share FROM x, q)
SELECT round(share, 6) AS share, CASE WHEN share > 0.15 THEN 'robust' ELSE 'standard' END AS scaler FROM s""")
def _(spark, sf):
    share = clean.outlier_cell_share(run_sql(spark, sf, GAPPED), ["value", "who"])
    return rounded(spark.createDataFrame([(share, clean.scaler_choice(share))], "share double, scaler string"))


@query("impute_median", f"WITH x AS ({GAPPED}) SELECT event_id, round(coalesce(value, m), 6) AS value FROM x, (SELECT median(value) AS m FROM x) q")
def _(spark, sf):
    df = run_sql(spark, sf, GAPPED)
    m = clean.fit_scaler(df, ["value"], "standard")["value"][0]
    return rounded(df.select("event_id", F.coalesce("value", F.lit(m)).alias("value")))


@query("scale_standard", f"""WITH x AS ({GAPPED}), i AS (SELECT event_id, coalesce(value, (SELECT median(value) FROM x)) AS v, coalesce(who, (SELECT median(who) FROM x)) AS w FROM x)
SELECT event_id, round((v - (SELECT avg(v) FROM i)) / (SELECT stddev_pop(v) FROM i), 6) + 0.0 AS value, round((w - (SELECT avg(w) FROM i)) / (SELECT stddev_pop(w) FROM i), 6) + 0.0 AS who FROM i""")
def _(spark, sf):
    df = run_sql(spark, sf, GAPPED)
    p = clean.fit_scaler(df, ["value", "who"], "standard")
    return rounded(clean.select_as(df, {c: clean.scale(c, p[c]) for c in p}, ["event_id"]))


@query("scale_robust", f"""WITH x AS ({GAPPED}), i AS (SELECT event_id, coalesce(value, (SELECT median(value) FROM x)) AS v FROM x)
SELECT event_id, round((v - (SELECT median(v) FROM i)) / (SELECT quantile_cont(v, 0.75) - quantile_cont(v, 0.25) FROM i), 6) + 0.0 AS value FROM i""")
def _(spark, sf):
    df = run_sql(spark, sf, GAPPED)
    p = clean.fit_scaler(df, ["value"], "robust")
    return rounded(clean.select_as(df, {"value": clean.scale("value", p["value"])}, ["event_id"]))


@query("scale_constant", "SELECT event_id, CAST(0 AS DOUBLE) AS one FROM {events}")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.lit(1.0).alias("one"))
    p = clean.fit_scaler(df, ["one"], "standard")
    return clean.select_as(df, {"one": clean.scale("one", p["one"])}, ["event_id"])


@query("impute_mode", f"""WITH x AS ({GAPPED}) SELECT event_id, coalesce(kind, (SELECT kind FROM x WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM x""")
def _(spark, sf):
    df = run_sql(spark, sf, GAPPED)
    return df.select("event_id", F.coalesce("kind", F.lit(encode.most_frequent(df, ["kind"])["kind"])).alias("kind"))



@query("onehot", f"""WITH x AS ({GAPPED}), f AS (SELECT event_id, coalesce(kind, (SELECT kind FROM x WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM x),
c AS (SELECT DISTINCT kind FROM x WHERE kind IS NOT NULL)
SELECT event_id, 'kind_' || c.kind AS feature, CASE WHEN f.kind = c.kind THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM f, c""")
def _(spark, sf):
    df = run_sql(spark, sf, GAPPED)
    values = encode.categories(df, "kind", 15)
    cols = encode.onehot("kind", "kind", values, encode.most_frequent(df, ["kind"])["kind"])
    return clean.select_as(df, cols, ["event_id"]).unpivot(["event_id"], list(cols), "feature", "value")


@query("impute_constant", f"SELECT event_id, coalesce(kind, 'missing') AS kind FROM ({GAPPED}) x")
def _(spark, sf):
    return run_sql(spark, sf, GAPPED).select("event_id", F.coalesce("kind", F.lit("missing")).alias("kind"))


PARTS = """SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS brand, p_retailprice AS price,
  CASE WHEN p_size > 25 THEN 1.0 ELSE 0.0 END AS big FROM {part}"""


@query("ordinal_encode", f"""WITH x AS (SELECT p_partkey, coalesce(brand, 'missing') AS brand FROM ({PARTS}) p)
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY brand) - 1 AS DOUBLE) AS brand FROM x""")
def _(spark, sf):
    df = run_sql(spark, sf, PARTS)
    values = encode.categories(df.select(F.coalesce("brand", F.lit("missing")).alias("brand")), "brand", 50)
    return clean.select_as(df, {"brand": encode.ordinal("brand", values)}, ["p_partkey"])


@query("hash_encode", f"""SELECT p_partkey, 'name_' || s.i AS feature, CASE WHEN CAST('0x' || substr(md5(p_name), 1, 8) AS BIGINT) % 16 = s.i THEN 1.0 ELSE 0.0 END::DOUBLE AS value
FROM {{part}}, (SELECT unnest(range(16)) AS i) s""")
def _(spark, sf):
    cols = encode.hashed("name", "p_name")
    return clean.select_as(table(spark, sf, "part"), cols, ["p_partkey"]).unpivot(["p_partkey"], list(cols), "feature", "value")



@query("target_encode", f"""WITH x AS (SELECT p_partkey, coalesce(brand, 'missing') AS brand, price, big FROM ({PARTS}) p),
o AS (SELECT avg(price) AS om, var_pop(price) AS v, avg(big) AS ob, var_pop(big) AS vb FROM x),
c AS (SELECT brand, count(*) AS n, avg(price) AS m, var_pop(price) AS vc, avg(big) AS mb, var_pop(big) AS vcb FROM x GROUP BY brand)
SELECT p_partkey, round((n * v / (n * v + vc)) * m + (1 - n * v / (n * v + vc)) * om, 6) AS brand_price,
  round((n * vb / (n * vb + vcb)) * mb + (1 - n * vb / (n * vb + vcb)) * ob, 6) AS brand_big FROM x JOIN c USING (brand), o""")
def _(spark, sf):
    df = run_sql(spark, sf, PARTS).withColumn("big", F.col("big").cast("double"))
    codes = encode.fit_target_codes(df, "brand", ["price", "big"], ["brand_price", "brand_big"])
    keyed = df.select("p_partkey", F.coalesce("brand", F.lit("missing")).alias("brand"))
    return rounded(codes.apply(keyed, "brand").drop("brand"))


@query("target_encode_unseen", f"""WITH x AS (SELECT p_partkey, coalesce(brand, 'missing') AS brand, price FROM ({PARTS}) p),
f AS (SELECT * FROM x WHERE brand <> 'Brand#11'),
o AS (SELECT avg(price) AS om, var_pop(price) AS v FROM f),
c AS (SELECT brand, count(*) AS n, avg(price) AS m, var_pop(price) AS vc FROM f GROUP BY brand)
SELECT p_partkey, round(coalesce((n * v / (n * v + vc)) * m + (1 - n * v / (n * v + vc)) * om, om), 6) AS code FROM x LEFT JOIN c USING (brand), o""")
def _(spark, sf):
    df = run_sql(spark, sf, PARTS).withColumn("brand", F.coalesce("brand", F.lit("missing")))
    codes = encode.fit_target_codes(df.where("brand <> 'Brand#11'"), "brand", ["price"], ["code"])
    return rounded(codes.apply(df.select("p_partkey", "brand"), "brand").drop("brand"))


@query("target_encode_folds", f"""WITH x AS (SELECT p_partkey, coalesce(brand, 'missing') AS brand, price, p_partkey % 5 AS fold FROM ({PARTS}) p),
o AS (SELECT k.fold, avg(price) AS om, var_pop(price) AS v FROM x, (SELECT DISTINCT fold FROM x) k WHERE x.fold <> k.fold GROUP BY k.fold),
c AS (SELECT k.fold, brand, count(*) AS n, avg(price) AS m, var_pop(price) AS vc FROM x, (SELECT DISTINCT fold FROM x) k WHERE x.fold <> k.fold GROUP BY k.fold, brand)
SELECT p_partkey, round(coalesce((n * v / (n * v + vc)) * m + (1 - n * v / (n * v + vc)) * om, om), 5) AS code FROM x JOIN o USING (fold) LEFT JOIN c ON c.fold = x.fold AND c.brand = x.brand""")
def _(spark, sf):
    df = run_sql(spark, sf, PARTS).withColumn("fold", F.col("p_partkey") % 5)
    return rounded(encode.cross_fitted(df, "brand", ["price"], ["code"], "fold").select("p_partkey", "code"), 5)


HASH = "CAST('0x' || substr(md5('{salt}' || CAST({k} AS VARCHAR)), 1, 13) AS BIGINT)"


def _hash(salt, k):
    return HASH.replace("{salt}", salt).replace("{k}", k)


@query("split_stratified", f"""SELECT o_orderkey, rn <= floor(0.2 * n + 0.5) AS is_test FROM (SELECT o_orderkey,
row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_hash('split', 'o_orderkey')}) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {{orders}}) x""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.assign_test(df, ["o_orderkey"], stratify="o_orderstatus").select("o_orderkey", "is_test")


@query("split_random", f"""SELECT o_orderkey, rn <= floor(0.2 * n + 0.5) AS is_test FROM (SELECT o_orderkey,
row_number() OVER (ORDER BY {_hash('split', 'o_orderkey')}) AS rn, count(*) OVER () AS n FROM {{orders}}) x""")
def _(spark, sf):
    return split.assign_test(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])


@query("split_second", f"""WITH x AS (SELECT o_orderkey, rn <= floor(0.2 * n + 0.5) AS t FROM (SELECT o_orderkey,
row_number() OVER (ORDER BY {_hash('split', 'o_orderkey')}) AS rn, count(*) OVER () AS n FROM {{orders}}) a)
SELECT o_orderkey, rn <= floor(0.2 * n + 0.5) AS is_test FROM (SELECT o_orderkey,
row_number() OVER (ORDER BY {_hash('second', 'o_orderkey')}) AS rn, count(*) OVER () AS n FROM x WHERE NOT t) b""")
def _(spark, sf):
    train, _ = split.split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"])
    return split.assign_test(train, ["o_orderkey"], salt="second")


def _folds(k, by, key, source, salt):
    steps = " + ".join(f"CASE WHEN rn > (n * {j}) // {k} THEN 1 ELSE 0 END" for j in range(1, k))
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {key}, CAST({steps} AS INTEGER) AS fold FROM (SELECT {key}, row_number() OVER ({part}ORDER BY {_hash(salt, key)}) AS rn, count(*) OVER ({part}) AS n FROM {source}) x"""


@query("folds_stratified", _folds(5, "event_type", "event_id", "{events}", "fold"))
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type")
    return split.assign_folds(df, ["event_id"], k=5, stratify="event_type").select("event_id", "fold")


@query("folds_plain", _folds(5, None, "o_orderkey", "{orders}", "fold"))
def _(spark, sf):
    return split.assign_folds(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], k=5)


@query("folds_three", _folds(3, "o_orderstatus", "o_orderkey", "{orders}", "fold"))
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return split.assign_folds(df, ["o_orderkey"], k=3, stratify="o_orderstatus").select("o_orderkey", "fold")
