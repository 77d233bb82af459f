"""Table and column profiling. Each operator is a DataFrame in, a DataFrame out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import Thresholds
from plumbline.functions.columns import (
    hash52,
    is_datetime,
    is_float,
    is_numeric,
    long_form,
    numeric_columns,
    per_column,
    quoted,
    row_key,
    type_families,
    union_all,
)
from plumbline.operators import drops
from plumbline.operators.ordering import quantiles

LIMITS = Thresholds()

# Texts that mark a two-valued column.
BOOLEAN_TEXTS = ["True", "False", "1", "0"]

# Bytes a fixed-width cell takes; text is measured instead.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("bigint")
    )


def memory(df: DataFrame) -> DataFrame:
    """Estimated bytes per column: measured for text, count times width otherwise."""
    types = dict(df.dtypes)

    def measure(c: str) -> dict[str, Column]:
        if is_text(df, c):
            size = F.coalesce(F.sum(F.octet_length(quoted(c).cast("string"))), F.lit(0))
        else:
            size = F.count(quoted(c)) * F.lit(WIDTHS.get(types[c], 8))
        return {"bytes": size.cast("bigint")}

    return per_column(df, df.columns, measure)


def is_text(df: DataFrame, c: str) -> bool:
    t = df.schema[c].dataType
    return not (is_numeric(t) or is_datetime(t) or isinstance(t, T.BooleanType))


def size_class(df: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Row count, its class, and the advised sampling share above the large cut-off."""
    n = F.col("rows")
    return table_shape(df).select(
        "rows",
        F.when(n < limits.small_rows, "very_small")
        .when(n < limits.medium_rows, "small")
        .when(n < limits.large_rows, "medium")
        .otherwise("large")
        .alias("size_class"),
        (n > limits.large_rows).alias("sampling_advised"),
        F.when(n > limits.large_rows, F.round(F.lit(float(limits.large_rows)) / n, 3)).alias("sampling_share"),
    )


def hash_sample(df: DataFrame, id_cols: Sequence[str], size: int, salt: str = "sample") -> DataFrame:
    """Keep rows whose key hash falls below the share that gives about ``size`` rows."""
    n = df.count()
    if n <= size:
        return df
    cut = int(size / n * 2**52)
    return df.where(hash52(row_key(df, id_cols), salt) < F.lit(cut))


def duplicate_rows(df: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """(rows, duplicates): rows beyond the first of each group of equal rows; nulls compare equal.

    Digests are counted first, and whole rows are compared only where digests are equal.
    """
    repeated = drops.repeated_digests(df) if repeated is None else repeated
    groups = drops.sharing(df, repeated).groupBy(*[quoted(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.lit(df.count()).cast("bigint").alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def missing_shares(df: DataFrame, cols: Sequence[str] | None = None, limits: Thresholds = LIMITS) -> DataFrame:
    """Columns with missing cells, their share, and whether the share calls for a drop."""
    out = per_column(
        df, cols or df.columns,
        lambda c: {"missing": F.avg(F.when(quoted(c).isNull(), 1.0).otherwise(0.0))},
    )
    return out.where("missing > 0").withColumn("drop", F.col("missing") > limits.missing_drop)


def numeric_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Mean, interpolated median, sample deviation, min and max per numeric column."""
    cols = list(cols if cols is not None else numeric_columns(df))
    medians = quantiles(df, cols, [0.5])

    def measure(c: str) -> dict[str, Column]:
        x = quoted(c).cast("double")
        return {
            "n": F.count(x),
            "mean": F.avg(x),
            "median": F.lit(medians[c][0]).cast("double"),
            "std": F.stddev_samp(x),
            "min": F.min(x),
            "max": F.max(x),
        }

    return per_column(df, cols, measure).where("n > 0")


def cardinality(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct count, non-null count and the largest value count per column.

    Columns of one type family share a long form, so all of them cost one shuffle of
    already combined (column, value) counts; a hot value is one row per map task.
    """
    cols = list(cols or df.columns)
    parts = [
        long_form(df, members, family)
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("distinct"),
            F.sum("n").alias("present"),
            F.max("n").alias("top"),
        )
        for family, members in type_families(df, cols).items()
    ]
    return union_all(parts)


def quasi_constant(card: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    top_share = F.col("top") / F.col("present")
    return card.where(
        (F.col("distinct") <= 1) | ((F.col("distinct") == 2) & (top_share > limits.quasi_constant))
    ).select("column", "distinct", top_share.alias("top_share"))


def id_like(df: DataFrame, card: DataFrame) -> DataFrame:
    """Columns of text or 64-bit integers where every present value is different."""
    typed = [
        f.name for f in df.schema
        if isinstance(f.dataType, T.LongType) or is_text(df, f.name)
    ]
    return card.where(
        F.col("column").isin(typed) & (F.col("distinct") == F.col("present")) & (F.col("distinct") > 1)
    ).select("column", "distinct")


def logical_types(
    df: DataFrame, cols: Sequence[str] | None = None, *, order_key: str | None = None,
    limits: Thresholds = LIMITS,
) -> DataFrame:
    """boolean, datetime, numeric or categorical for every column.

    Text counts as datetime when most present values parse as a date, or, given
    ``order_key``, when the first present value in that order does.
    """
    cols = list(cols or df.columns)
    return per_column(df, cols, lambda c: type_measures(df, c, order_key, limits))


def type_measures(df: DataFrame, c: str, order_key: str | None = None, limits: Thresholds = LIMITS) -> dict[str, Column]:
    """The aggregates that decide one column's logical type."""

    def dated(c: str) -> Column:
        x = quoted(c).cast("string")
        looks = (F.length(x) > 8) & (x.contains("-") | x.contains("/"))
        return looks & quoted(c).try_cast("timestamp").isNotNull()

    t = df.schema[c].dataType
    x = quoted(c)
    if isinstance(t, T.BooleanType):
        two_valued = F.lit(True)
    elif is_datetime(t):
        two_valued = F.count(x) == 0
    elif is_numeric(t):
        two_valued = F.coalesce(F.bool_and((x == 0) | (x == 1)), F.lit(True))
    else:
        two_valued = F.coalesce(F.bool_and(x.cast("string").isin(BOOLEAN_TEXTS)), F.lit(True))
    if is_datetime(t):
        date_like = F.lit(True)
    elif isinstance(t, T.StringType) and order_key:
        first = F.min_by(dated(c), F.when(x.isNotNull(), quoted(order_key)))
        date_like = F.coalesce(first, F.lit(False))
    elif isinstance(t, T.StringType):
        share = F.avg(F.when(x.isNotNull(), dated(c).cast("double")))
        date_like = F.coalesce(share > limits.coerce_share, F.lit(False))
    else:
        date_like = F.lit(False)
    rest = "numeric" if is_numeric(t) else "categorical"
    return {
        "spark_type": F.lit(t.simpleString()),
        "logical_type": F.when(two_valued, "boolean").when(date_like, "datetime").otherwise(rest),
    }


def outlier_shares(
    df: DataFrame, cols: Sequence[str] | None = None, limits: Thresholds = LIMITS,
    quartiles: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Share of present values outside the 1.5 IQR fences, and its severity."""
    cols = list(cols if cols is not None else numeric_columns(df))
    if quartiles is None:
        quartiles = {c: tuple(q) for c, q in quantiles(df, cols, [0.25, 0.75]).items()}
    quartiles = {c: quartiles[c] for c in cols if quartiles[c][0] is not None}

    def measure(c: str) -> dict[str, Column]:
        q1, q3 = quartiles[c]
        x = quoted(c).cast("double")
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        return {
            "q1": F.lit(q1), "q3": F.lit(q3),
            "outlier_share": F.avg(F.when(x.isNotNull(), ((x < low) | (x > high)).cast("double"))),
        }

    out = per_column(df, list(quartiles), measure)
    return out.withColumn(
        "severity",
        F.when(F.col("outlier_share") > limits.outlier_significant, "significant")
        .when(F.col("outlier_share") > limits.outlier_listed, "moderate")
        .otherwise("none"),
    )


def skewness(df: DataFrame, cols: Sequence[str] | None = None, limits: Thresholds = LIMITS) -> DataFrame:
    """Population skewness and the transform it calls for."""
    cols = list(cols if cols is not None else numeric_columns(df))
    out = per_column(
        df, cols,
        lambda c: {"skew": F.skewness(quoted(c).cast("double")), "min": F.min(quoted(c).cast("double"))},
    )
    skewed = F.abs("skew") > limits.skewed
    return out.where(F.col("skew").isNotNull()).select(
        "column", "skew", skewed.alias("skewed"), skew_action(F.col("skew"), F.col("min"), limits).alias("action"),
    )


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """Type, missing share and distinct non-null count of the target."""
    t = quoted(target)
    return (
        df.groupBy(t.alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("value").alias("distinct"),
        )
        .select(
            F.lit(target).alias("target"),
            F.lit(df.schema[target].dataType.simpleString()).alias("spark_type"),
            "rows",
            (F.col("nulls") / F.col("rows")).alias("missing"),
            "distinct",
        )
    )


def class_shares(df: DataFrame, target: str, limits: Thresholds = LIMITS) -> DataFrame:
    """Share of every class over the non-null target; empty at 50 classes or more."""
    counts = df.where(quoted(target).isNotNull()).groupBy(
        quoted(target).cast("string").alias("class")
    ).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    return counts.where(classes < limits.class_profile_max).select(
        "class", "n", (F.col("n") / total).alias("share")
    )


def imbalance(shares: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Smallest class share, its severity and whether resampling is advised."""
    r = F.col("ratio")
    return shares.agg(F.min("share").alias("ratio")).where(r.isNotNull()).select(
        "ratio",
        (r < limits.imbalance).alias("imbalanced"),
        F.when(r < limits.imbalance_severe, "severe")
        .when(r < limits.imbalance, "moderate")
        .otherwise("balanced")
        .alias("severity"),
        (r < limits.imbalance).alias("resample_advised"),
    )


def first_pass(df: DataFrame, cols: Sequence[str], limits: Thresholds = LIMITS) -> DataFrame:
    """Everything one scan can tell about the columns: type, missing, moments, range."""

    def measure(c: str) -> dict[str, Column]:
        x = quoted(c).cast("double") if is_numeric(df.schema[c].dataType) else F.lit(None).cast("double")
        return {
            "rows": F.count(F.lit(1)),
            "missing": F.avg(F.when(quoted(c).isNull(), 1.0).otherwise(0.0)),
            **type_measures(df, c, limits=limits),
            "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "skew": F.skewness(x),
        }

    return per_column(df, list(cols), measure)


def skew_action(skew: Column, low: Column, limits: Thresholds = LIMITS) -> Column:
    return F.when((F.abs(skew) > limits.skewed) & (low >= 0), "log_transform").otherwise("none")


def column_profile(df: DataFrame, limits: Thresholds = LIMITS) -> DataFrame:
    """Everything known about each column in one table, one row per column.

    The parts are one row per column each, so the joins move only that many rows.
    """
    numeric = numeric_columns(df)
    out = first_pass(df, df.columns, limits).join(F.broadcast(cardinality(df)), "column", "left")
    if numeric:
        q = quantiles(df, numeric, [0.25, 0.5, 0.75])
        medians = df.sparkSession.createDataFrame([(c, q[c][1]) for c in numeric], "column string, median double")
        fences = outlier_shares(df, numeric, limits, {c: (q[c][0], q[c][2]) for c in numeric})
        out = out.join(F.broadcast(medians), "column", "left").join(
            F.broadcast(fences.select("column", "outlier_share", F.col("severity").alias("outliers"))), "column", "left"
        )
        action = F.when(F.col("skew").isNotNull(), skew_action(F.col("skew"), F.col("min"), limits))
        out = out.withColumn("action", action)
    return out.withColumn("distinct", F.coalesce("distinct", F.lit(0)))
