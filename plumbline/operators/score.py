"""Checking and scoring new rows; batch and streaming tables take the same path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted, sql_name

# Text and dates are left as they come; numbers and flags have to fit.
CAST_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


class SchemaMismatch(ValueError):
    def __init__(self, missing: Sequence[str], unexpected: Sequence[str]):
        self.missing, self.unexpected = sorted(missing), sorted(unexpected)
        parts = []
        if missing:
            parts.append(f"missing columns {self.missing}")
        if unexpected:
            parts.append(f"unexpected columns {self.unexpected}; send only the columns the model was trained on")
        super().__init__("; ".join(parts))


def check_columns(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Exactly the expected columns, in training order, after the kept ones."""
    missing = [c for c in [*keep, *expected] if c not in df.columns]
    unexpected = [c for c in df.columns if c not in expected and c not in keep]
    if missing or unexpected:
        raise SchemaMismatch(missing, unexpected)
    return df.select(*[quoted(c) for c in keep if c not in expected], *[quoted(c) for c in expected])


def fits(types: dict[str, str]) -> Column:
    """Does every present value read as its training type?"""
    ok = F.lit(True)
    for c, t in types.items():
        if t in CAST_TYPES:
            ok = ok & (quoted(c).isNull() | F.expr(f"try_cast({sql_name(c)} AS {t})").isNotNull())
    return ok


def coerce(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows cast to the training types, and the rows that cannot be."""
    good = df.where(fits(types)).select(*[
        F.expr(f"try_cast({sql_name(c)} AS {types[c]})").alias(c) if types.get(c) in CAST_TYPES else quoted(c)
        for c in df.columns
    ])
    return good, df.where(~fits(types))


def linear_score(df: DataFrame, cols: Sequence[str], weights: Sequence[float], intercept: float, name: str = "margin") -> DataFrame:
    """Score of a linear model from fixed coefficients."""
    total = F.lit(float(intercept))
    for c, w in zip(cols, weights):
        total = total + quoted(c).cast("double") * F.lit(float(w))
    return df.withColumn(name, total)


def labels_column(labels: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def binary_output(df: DataFrame, probability: Column | None, prediction: Column, labels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Prediction, probability of the second class, and the class names."""
    named = labels_column(labels)
    p = probability if probability is not None else F.lit(None).cast("double")
    return df.select(
        *[quoted(k) for k in keep], F.element_at(named, prediction.cast("int") + 1).alias("prediction"),
        p.alias("probability"), named.alias("class_labels"),
    )


def multiclass_output(df: DataFrame, probabilities: Column | None, prediction: Column, labels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Prediction and a map from class name to probability."""
    named = labels_column(labels)
    p = F.map_from_arrays(named, probabilities) if probabilities is not None else F.create_map().cast("map<string,double>")
    return df.select(
        *[quoted(k) for k in keep], F.element_at(named, prediction.cast("int") + 1).alias("prediction"),
        p.alias("probabilities"), named.alias("class_labels"),
    )


def regression_output(df: DataFrame, prediction: Column, keep: Sequence[str], log_target: bool = False) -> DataFrame:
    value = F.expm1(prediction) if log_target else prediction
    return df.select(
        *[quoted(k) for k in keep], value.cast("double").alias("prediction"), F.lit("regression").alias("prediction_type")
    )


def cluster_output(df: DataFrame, cluster: Column, keep: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(k) for k in keep], cluster.cast("int").alias("cluster"))


def model_output(predicted: DataFrame, problem: str, labels: Sequence[str] | None, keep: Sequence[str], log_target: bool = False) -> DataFrame:
    """The answer table of a fitted Spark model's ``transform``."""
    if problem == "clustering":
        return cluster_output(predicted, F.col("cluster"), keep)
    if problem == "regression":
        return regression_output(predicted, F.col("prediction"), keep, log_target)
    shares = vector_to_array("probability") if "probability" in predicted.columns else None
    if len(labels) == 2:
        return binary_output(predicted, shares[1] if shares is not None else None, F.col("prediction"), labels, keep)
    return multiclass_output(predicted, shares, F.col("prediction"), labels, keep)
