"""Turning labels and categories into numbers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import Thresholds
from plumbline.functions.columns import materialise, quoted, sql_text
from plumbline.operators.ordering import numbered, skew_lookup

LIMITS = Thresholds()
MAX_CLASSES = 10_000
# A lookup of at most this many rows is broadcast; a larger one is joined by key.
BROADCAST_ROWS = 100_000


@dataclass
class Labels:
    """Class names in sorted order; a class's code is its place."""

    names: list[str]

    def column(self, target: str) -> Column:
        listed = F.array(*[F.lit(n) for n in self.names])
        at = F.array_position(listed, quoted(target).cast("string"))
        return F.when(at > 0, at.cast("double") - 1)


def label_codes(df: DataFrame, target: str) -> Labels:
    """The class names of a model, which keeps weights for each class; ``label_table`` has no such bound."""
    rows = (
        df.select(quoted(target).cast("string").alias("v")).where("v is not null").distinct()
        .limit(MAX_CLASSES + 1).collect()
    )
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} classes to learn")
    return Labels(sorted(r["v"] for r in rows))


def label_table(df: DataFrame, target: str) -> DataFrame:
    """(label, code, n): codes from 0 on in the order of the labels' texts, for any number of labels."""
    counts = value_counts(df, target).withColumnRenamed("value", "label")
    return numbered(counts, [F.col("label")], "code")


def label_encode(df: DataFrame, target: str) -> DataFrame:
    """The target's codes in place of its labels; null stays null. Labels with many rows are spread over tasks."""
    key, code = f"{target}__label", f"{target}__code"
    table = label_table(df, target).select(F.col("label").alias(key), "n", F.col("code").alias(code))
    labels, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    keyed = df.withColumn(key, quoted(target).cast("string"))
    if labels <= BROADCAST_ROWS:
        found = keyed.join(F.broadcast(table.drop("n")), key, "left")
    else:
        found = skew_lookup(keyed, table.withColumn("total", F.lit(total)), [key], [code])
    return found.select(*[quoted(code).cast("bigint").alias(c) if c == target else quoted(c) for c in df.columns])


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(quoted(col).isNotNull()).groupBy(quoted(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def most_frequent(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """The most frequent value of every column, the smallest on ties."""
    wide = df.select(*[quoted(c).cast("string").alias(c) for c in cols])
    counts = wide.unpivot([], list(cols), "column", "value").where("value is not null").groupBy(
        "column", "value"
    ).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    found = {r["column"]: r["value"] for r in best.collect()}
    return {c: found.get(c) for c in cols}


def categories(df: DataFrame, col: str, at_most: int) -> list[str] | None:
    """Sorted distinct values, or None when there are more than ``at_most``."""
    rows = value_counts(df, col).select("value").limit(at_most + 1).collect()
    return sorted(r["value"] for r in rows) if len(rows) <= at_most else None


def onehot(name: str, x: str, values: Sequence[str], fill: str | None) -> dict[str, str]:
    """One 0/1 column per category; an unseen value is all zeros."""
    filled = f"coalesce({x}, {sql_text(fill)})" if fill is not None else x
    return {f"{name}_{v}": f"CASE WHEN {filled} = {sql_text(v)} THEN 1.0D ELSE 0.0D END" for v in values}


def ordinal(x: str, values: Sequence[str]) -> str:
    """Place in sorted order, -1 when unseen; null is the value 'missing'."""
    listed = ", ".join(sql_text(v) for v in values)
    return f"CAST(array_position(array({listed}), coalesce({x}, 'missing')) - 1 AS DOUBLE)"


def hashed(name: str, x: str, width: int = LIMITS.hash_width) -> dict[str, str]:
    """Indicator columns of the value's hash slot."""
    slot = f"pmod(CAST(conv(substr(md5(coalesce({x}, 'missing')), 1, 8), 16, 10) AS BIGINT), {width})"
    return {f"{name}_{i}": f"CASE WHEN {slot} = {i} THEN 1.0D ELSE 0.0D END" for i in range(width)}


@dataclass
class TargetCodes:
    """Shrunken target mean per category, one output per target column."""

    source: str
    outputs: list[str]
    table: DataFrame
    overall: list[float]
    rows: int

    def apply(self, df: DataFrame, key: str) -> DataFrame:
        """Add the outputs; ``key`` is the column holding the category ('missing' for null)."""
        table = self.table.withColumnRenamed("value", key)
        if self.rows <= BROADCAST_ROWS:
            out = df.join(F.broadcast(table.drop("n", "total")), key, "left")
        else:
            out = skew_lookup(df, table, [key], self.outputs)
        return out.select(
            *[quoted(c) for c in df.columns],
            *[F.coalesce(quoted(o), F.lit(m)).alias(o) for o, m in zip(self.outputs, self.overall)],
        )


def _shrunk(n: Column, s: Column, ss: Column, mean: Column, var: Column) -> Column:
    """Empirical-Bayes mean of a category from its count, sum and sum of squares.

    Sums are of y minus the overall mean, so the squares do not cancel badly.
    """
    own = F.try_divide(s, n)
    spread = F.greatest(F.try_divide(ss, n) - own * own, F.lit(0.0))
    weight = F.try_divide(n * var, n * var + spread)
    return F.when(n.isNull() | (n <= 0) | ((var <= 0) & (spread <= 0)), mean).otherwise(
        weight * (own + mean) + (1 - weight) * mean
    )


def _sums(ys: Sequence[str], centres: Sequence[float]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("n")]
    for i, (y, c) in enumerate(zip(ys, centres)):
        d = quoted(y) - F.lit(c)
        out += [F.sum(d).alias(f"s{i}"), F.sum(d * d).alias(f"q{i}")]
    return out


def fit_target_codes(df: DataFrame, col: str, ys: Sequence[str], outputs: Sequence[str]) -> TargetCodes:
    """Fit on rows (category ``col``, numeric targets ``ys``); null is the value 'missing'."""
    base = df.select(
        F.coalesce(quoted(col).cast("string"), F.lit("missing")).alias("value"),
        *[quoted(y).cast("double").alias(y) for y in ys],
    )
    overall = base.agg(
        F.count(F.lit(1)), *[f(quoted(y)) for y in ys for f in (F.avg, F.var_pop)]
    ).first()
    means = [overall[1 + 2 * i] for i in range(len(ys))]
    spreads = [overall[2 + 2 * i] for i in range(len(ys))]
    sums = base.groupBy("value").agg(*_sums(ys, means))
    table = sums.select(
        "value", "n", F.lit(overall[0]).alias("total"),
        *[
            _shrunk(F.col("n"), F.col(f"s{i}"), F.col(f"q{i}"), F.lit(means[i]), F.lit(spreads[i])).alias(o)
            for i, o in enumerate(outputs)
        ],
    )
    table = materialise(table)
    return TargetCodes(col, list(outputs), table, means, table.count())


def cross_fitted(df: DataFrame, col: str, ys: Sequence[str], outputs: Sequence[str], fold: str) -> DataFrame:
    """Add codes fitted without the row's own fold: total sums minus the fold's sums."""
    keyed = df.withColumn("__value", F.coalesce(quoted(col).cast("string"), F.lit("missing")))
    centres = list(df.agg(*[F.avg(quoted(y).cast("double")) for y in ys]).first())
    per = keyed.groupBy("__value", quoted(fold)).agg(*_sums(ys, centres))
    names = ["n", *[f"{p}{i}" for i in range(len(ys)) for p in "sq"]]
    # One row per fold and category: the window holds as many rows as there are folds.
    w = Window.partitionBy("__value")
    rest = per.select("__value", fold, F.col("n").alias("own"), *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in names])
    folds = keyed.groupBy(quoted(fold)).agg(*_sums(ys, centres))
    everything = Window.partitionBy(F.lit(1))
    others = folds.select(
        fold, *[(F.sum(c).over(everything) - F.col(c)).alias(f"{c}__all") for c in names],
        F.sum("n").over(everything).alias("total"),
    )
    joined = rest.join(F.broadcast(others), fold)
    codes = []
    for i, (o, c) in enumerate(zip(outputs, centres)):
        n_all = F.col("n__all")
        shift = F.try_divide(F.col(f"s{i}__all"), n_all)
        var = F.try_divide(F.col(f"q{i}__all"), n_all) - shift * shift
        # Re-centre the category sums on the mean of the other folds.
        n, s, q = F.col("n"), F.col(f"s{i}"), F.col(f"q{i}")
        codes.append(
            _shrunk(n, s - n * shift, q - 2 * shift * s + n * shift * shift, shift + F.lit(c), var).alias(o)
        )
    table = joined.select("__value", fold, F.col("own").alias("n"), "total", *codes)
    return skew_lookup(keyed, table, ["__value", fold], list(outputs)).drop("__value")
