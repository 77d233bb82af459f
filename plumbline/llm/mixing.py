"""Sources mixed to target weights: every document is repeated a Poisson number of times.

A source's rate is its target mass over its own mass, in characters. The number of copies is the
inverse of the Poisson distribution at a uniform number hashed from seed and document, so it is the same in
every run and no row looks at another. Copies get a hashed place and are dealt out by it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import hash52, quoted
from plumbline.llm.common import stored

SEED = "mix-1"
#: Without given weights a source weighs its mass to this power.
FLATTEN = 0.7
#: A higher rate is the sum of equal parts of at most this rate, each with a number of its own.
PART = 16.0
#: With a rate of at most PART, fewer than 1e-17 of the numbers lie beyond this count.
MOST = 63


def rates(docs: DataFrame, source_col: str, text_col: str, weights: Mapping[str, float] | None = None, total: float | None = None, flatten: float = FLATTEN) -> DataFrame:
    """(source, rate): mean copies of a document so that sources have masses in proportion to their weights.

    Null is a source of its own, and a source that ``weights`` leaves out has weight 0. A source without a
    character of text cannot be brought to any mass; its documents keep the rate 1. ``total``
    is the mass of the mixture, by default that of the corpus.
    """
    mass = docs.groupBy(quoted(source_col).cast("string").alias("source")).agg(F.sum(F.coalesce(F.char_length(quoted(text_col)), F.lit(0))).cast("double").alias("mass"))
    if weights is None:
        weight = F.pow("mass", F.lit(flatten))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, weight double")
        mass = mass.join(given, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        weight = F.coalesce("weight", F.lit(0.0))
    weighed = stored(mass.select("source", "mass", weight.alias("weight")), "masses")
    sums = weighed.where("mass > 0").agg(F.sum("mass").alias("mass"), F.sum("weight").alias("weight")).first()
    whole = float(total if total is not None else sums["mass"] or 0.0)
    share = F.col("weight") / F.lit(sums["weight"] or 1.0) * F.lit(whole) / F.col("mass")
    return weighed.select("source", F.when(F.col("mass") > 0, share).otherwise(1.0).alias("rate"))


def poisson(rate: Column, number: Column) -> Column:
    """The least k with P(X <= k) > number, for X of mean ``rate`` <= PART."""
    start = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("below"), F.lit(0).alias("k"))

    def step(s, j):
        term = s["term"] * rate / j
        return F.struct(term.alias("term"), (s["below"] + term).alias("below"), (s["k"] + F.when(s["below"] <= number, 1).otherwise(0)).alias("k"))

    steps = F.sequence(F.lit(1), F.lit(MOST))
    return F.aggregate(steps, start, step, lambda s: s["k"])


def mixed(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights: Mapping[str, float] | None = None, total: float | None = None, seed: str = SEED, flatten: float = FLATTEN) -> DataFrame:
    """The given columns with ``copy`` (from 0) and ``place``; each row as often as its count says.

    The count hangs on seed and id, or on the text where the id is null, so rows that repeat an id are
    repeated alike. Rows of a null or empty text take part. Rows are dealt to partitions by place, a
    hash of seed, document and copy, and sorted by it. Columns called copy or place are replaced.
    """
    rate = rates(docs, source_col, text_col, weights, total, flatten).withColumnRenamed("source", "mix__source")
    key = F.coalesce(quoted(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(quoted(text_col), F.lit("")).cast("binary"))))
    columns = [c for c in docs.columns if c not in ("copy", "place")]
    rows = docs.select(*[quoted(c) for c in columns], key.alias("mix__key"), quoted(source_col).cast("string").alias("mix__of"))
    rows = rows.join(rate, F.col("mix__of").eqNullSafe(F.col("mix__source")))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")
    draw = lambda j: poisson(F.col("rate") / parts, hash52(F.concat_ws("|", F.lit(seed), F.col("mix__key"), j.cast("string"))) / F.lit(2.0**52))
    count = F.aggregate(F.transform(F.sequence(F.lit(0), parts - 1), draw), F.lit(0), lambda a, b: a + b)
    copies = rows.withColumn("mix__n", count).where("mix__n > 0").select(*[quoted(c) for c in columns], "mix__key", F.explode(F.sequence(F.lit(0), F.col("mix__n") - 1)).alias("copy"))
    placed = copies.withColumn("place", hash52(F.concat_ws("|", F.lit(seed), F.lit("place"), F.col("mix__key"), F.col("copy").cast("string")))).drop("mix__key")
    return placed.repartition("place").sortWithinPartitions("place")


HASH = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"
SQL = f"""
WITH m AS (SELECT source, CAST(sum(length(text)) AS DOUBLE) AS mass, power(CAST(sum(length(text)) AS DOUBLE), {FLATTEN}) AS weight FROM documents GROUP BY source),
t AS (SELECT sum(mass) AS mass, sum(weight) AS weight FROM m),
r AS (SELECT source, m.weight / t.weight * t.mass / m.mass AS rate FROM m, t),
s AS (SELECT source, rate, greatest(1, ceil(rate / {PART})) AS parts FROM r),
c AS (SELECT source, parts, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM s, (SELECT unnest(generate_series(0, {MOST - 1})) AS k) z),
d AS (SELECT doc_id, d.source, text, unnest(generate_series(0, CAST(parts AS BIGINT) - 1)) AS part FROM documents d JOIN s ON d.source = s.source),
u AS (SELECT doc_id, source, text, {HASH.format(f"'{SEED}|' || doc_id || '|' || part")} / power(2.0, 52) AS number FROM d),
n AS (SELECT doc_id, u.source, text, count(*) FILTER (WHERE below <= number) AS copies FROM u JOIN c ON u.source = c.source GROUP BY ALL),
e AS (SELECT doc_id, source, text, unnest(generate_series(0, copies - 1)) AS copy FROM n WHERE copies > 0)
SELECT doc_id, source, text, CAST(copy AS INTEGER) AS copy, {HASH.format(f"'{SEED}|place|' || doc_id || '|' || copy")} AS place FROM e
"""


def op10_mixing(spark, sf: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "source", "text", "copy", "place")
