"""Correlation between features and leakage of the target into a feature."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import Thresholds
from plumbline.functions.columns import quoted, union_all
from plumbline.operators.ranks import spearman  # noqa: F401

LIMITS = Thresholds()
PAIRS = "later string, earlier string, r double"
# Ten correlations fill one compiled aggregate.
PAIRS_PER_SCAN = 10
PAIRS_BY_AGGREGATE = 96


def pearson_pairs(df: DataFrame, cols: Sequence[str], above: float | None = None) -> DataFrame:
    """|r| of every column pair over rows where both are present.

    The pair is listed as (later column, earlier column), the order the tie rule of
    selection relies on. A few columns are fixed-size aggregates of shared scans. Many
    columns without nulls go through one covariance matrix, again of a single scan.
    """
    cols = list(cols)
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIRS)
    if len(pairs) <= PAIRS_BY_AGGREGATE:
        out = _pairs_by_aggregate(df, pairs)
    else:
        gaps = df.agg(*[F.count(F.when(quoted(c).isNull(), 1)) for c in cols]).first()
        whole = [c for c, n in zip(cols, gaps) if not n]
        rest = [p for p in pairs if p[0] not in set(whole) or p[1] not in set(whole)]
        parts = [_pairs_by_matrix(df, whole)] if len(whole) > 1 else []
        parts += [_pairs_by_aggregate(df, rest)] if rest else []
        out = union_all(parts)
    return out if above is None else out.where(F.col("r") > above)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows with both values; null, not an error, when one is constant."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), spread)


def _pairs_by_aggregate(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    frames = []
    for s in range(0, len(pairs), PAIRS_PER_SCAN):
        structs = [
            F.struct(
                F.lit(b).alias("later"), F.lit(a).alias("earlier"),
                F.abs(correlation(quoted(a).cast("double"), quoted(b).cast("double"))).alias("r"),
            )
            for a, b in pairs[s : s + PAIRS_PER_SCAN]
        ]
        frames.append(df.agg(F.array(*structs).alias("p")).select(F.inline("p")))
    return union_all(frames)


def _pairs_by_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    names = [f"c{i}" for i in range(len(cols))]
    data = df.select(*[quoted(c).cast("double").alias(n) for c, n in zip(cols, names)])
    data = VectorAssembler(inputCols=names, outputCol="v").transform(data).select("v")
    m = Correlation.corr(data, "v").first()[0].toArray()
    rows = [
        (cols[j], cols[i], None if math.isnan(m[i, j]) else abs(float(m[i, j])))
        for i in range(len(cols)) for j in range(i + 1, len(cols))
    ]
    return df.sparkSession.createDataFrame(rows, PAIRS)


def mutual_information(df: DataFrame, cols: Sequence[str], target: str, normalise: str = "target_entropy") -> DataFrame:
    """Plug-in mutual information (nats) of every categorical column with the target.

    ``normalise`` divides by the target entropy or by ln(rows) (``'log_n'``). The
    target must have few classes; the columns may have any number of values.
    """
    present = df.where(quoted(target).isNotNull())
    wide = present.select(
        quoted(target).cast("string").alias("y"),
        *[F.coalesce(quoted(c).cast("string"), F.lit("missing")).alias(c) for c in cols],
    )
    joint = wide.unpivot(["y"], list(cols), "column", "value").groupBy("column", "value", "y").agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most one row per class and value, so this window stays small.
    joint = joint.withColumn("nx", F.sum("n").over(Window.partitionBy("column", "value")))
    classes = wide.groupBy("y").agg(F.count(F.lit(1)).alias("ny"))
    rows = classes.agg(F.sum("ny")).scalar()
    entropy = classes.agg(F.log(F.sum("ny")) - F.sum(F.col("ny") * F.log("ny")) / F.sum("ny")).scalar()
    n = F.col("n")
    joint = joint.join(F.broadcast(classes), "y").withColumn("rows", rows)
    part = n / F.col("rows") * F.log(n * F.col("rows") / (F.col("nx").cast("double") * F.col("ny")))
    out = joint.withColumn("part", part).groupBy("column").agg(
        F.max("rows").alias("rows"), F.sum("part").alias("mi")
    )
    out = out.withColumn("scale", entropy if normalise == "target_entropy" else F.log("rows"))
    return out.select(
        "column", "rows", "mi", F.when(F.col("scale") > 0, F.col("mi") / F.col("scale")).otherwise(0.0).alias("score")
    )


def leakage(scores: DataFrame, score: str | Column, signal: str, limits: Thresholds = LIMITS) -> DataFrame:
    """Columns whose association with the target is too good to be true."""
    s = F.abs(F.col(score) if isinstance(score, str) else score)
    return scores.where(s > limits.leakage).select("column", s.alias("score"), F.lit(signal).alias("signal"))
