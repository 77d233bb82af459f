"""Every operator as a query over the given tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state the result, its check."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = plain(sql)
        return fn

    return add


def plain(text: str) -> str:
    """The same SQL with table names instead of placeholders."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def run_sql(spark: SparkSession, sf: str, text: str) -> DataFrame:
    """SQL over placeholders such as {orders}."""
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf, t) for t in used})


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Float sums depend on the order of rows; compare them to a few digits."""
    return df.select(
        *[F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    )


def load_all() -> None:
    from catalogue import cleaning, clustering, detection, evaluation, learning, profiling, scoring  # noqa: F401
