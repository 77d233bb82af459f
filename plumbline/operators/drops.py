"""Removing rows and columns, and arranging what stays."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import is_float, is_numeric, quoted, stored


#: So many repeated digests are sent to every task; more are joined by digest.
BROADCAST_ROWS = 100_000


def row_digest(df: DataFrame) -> list[Column]:
    """Two hashes of 64 bits of the whole row, equal for equal rows; a null is hashed as a sign of its own."""
    parts = []
    for f in df.schema:
        c = quoted(f.name)
        parts += [c.isNull(), c + F.lit(0.0) if is_float(f.dataType) else c]
    return [F.xxhash64(F.lit(salt), *parts).alias(f"row__{salt}") for salt in ("a", "b")]


def repeated_digests(df: DataFrame) -> DataFrame:
    """(row__a, row__b, n): digests of several rows, by one shuffle of 24 bytes a row."""
    counts = df.select(*row_digest(df)).groupBy("row__a", "row__b").agg(F.count(F.lit(1)).alias("n"))
    return stored(counts.where("n > 1"), "repeated")


def sharing(df: DataFrame, repeated: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``df`` whose digest is (``left_anti``: is not) one of those repeated."""
    few = repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = repeated.select("row__a", "row__b")
    joined = df.select("*", *row_digest(df)).join(F.broadcast(keys) if few else keys, ["row__a", "row__b"], how)
    return joined.drop("row__a", "row__b")


def drop_duplicates(df: DataFrame, id_cols: Sequence[str] = (), repeated: DataFrame | None = None) -> DataFrame:
    """Keep one of each group of equal rows; with ids, the row with the smallest id.

    Whole rows are compared only where their digests are equal; the others stay where they are. Where too many
    digests repeat to be sent to every task, whole rows are shuffled once instead. ``repeated`` saves the count of
    digests when it was made before.
    """
    values = [c for c in df.columns if c not in id_cols]
    if not id_cols:
        repeated = repeated_digests(df) if repeated is None else repeated
        if repeated.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            return df.dropDuplicates()
        return sharing(df, repeated, "left_anti").unionByName(sharing(df, repeated).dropDuplicates())
    first = F.min(F.struct(*[quoted(c) for c in id_cols])).alias("__id")
    return df.groupBy(*[quoted(c) for c in values]).agg(first).select(
        *[F.col("__id")[c].alias(c) if c in id_cols else quoted(c) for c in df.columns]
    )


def drop_listed(df: DataFrame, listed: Sequence[str]) -> DataFrame:
    """Drop the user's columns; unknown names only warn."""
    unknown = [c for c in listed if c not in df.columns]
    if unknown:
        warnings.warn(f"columns to drop are not in the table: {unknown}", stacklevel=2)
    return df.drop(*[c for c in listed if c in df.columns])


def drop_found(df: DataFrame, findings: DataFrame, target: str | None = None) -> DataFrame:
    """Drop every column the ledger condemns; the ledger has at most one row per column."""
    gone = [r["column"] for r in findings.select("column").distinct().collect() if r["column"] != target]
    return df.drop(*gone)


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(quoted(target))


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is known (neither null nor NaN)."""
    t = quoted(target)
    known = t.isNotNull()
    if dict(df.dtypes)[target] in ("float", "double"):
        known = known & ~F.isnan(t)
    return df.where(known)


def in_order(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in expected])


def by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and other columns by schema."""
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    return numeric, [c for c in df.columns if c not in numeric]
