"""Exact, repeatable splits: rows are ordered by a hash of their key, never by chance.

A cut is an order statistic of the hash inside a class. Cuts of all classes are found together, in a histogram of
(class, leading bits of the hash) that is refined where a cut falls, so the plan is the same for any number of classes.
A split is then a comparison of the row's own hash with the cuts of its class.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import hash52, quoted, row_key, scratch, stored
from plumbline.operators.ordering import skew_lookup

#: The hash has so many bits, and a level of the histogram looks at so many more.
HASH_BITS, LEVEL_BITS = 52, 13
#: Rows that may share a class and leading bits before the rest of the bits is looked at at once.
CELL_ROWS = 100_000
#: A table of at most so many rows is sent to every task.
BROADCAST_ROWS = 10_000


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def class_key(by: str | None) -> Column:
    """A text that is the same for equal values; null is a class of its own."""
    return F.lit("") if by is None else F.coalesce(F.concat(F.lit("="), quoted(by).cast("string")), F.lit(""))


def class_cuts(df: DataFrame, h: Column, by: str | None, places: Callable[[Column], Sequence[Column]]) -> DataFrame:
    """(key, n, cuts): rows of each class, and the hash of the row at each 1-based place of its n rows.

    ``places`` lists the places for a count of rows; -1 stands for the hash at place 0. A class sends one row for each
    cell it fills, so a hot one sends 2**13 a task at most.
    """
    rows = df.select(class_key(by).alias("key"), h.alias("h"))
    shift = HASH_BITS - LEVEL_BITS
    inside = Window.partitionBy("key").orderBy("cell")
    cells = rows.groupBy("key", F.shiftright("h", shift).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    counted = cells.withColumn("rows", F.sum("n").over(Window.partitionBy("key"))).withColumn("upto", F.sum("n").over(inside))
    wants = F.array(*[F.struct(F.lit(j).alias("j"), p.cast("bigint").alias("place")) for j, p in enumerate(places(F.col("rows")))])
    width = len(places(F.lit(0)))
    # The class's first cell is kept, hit or not, so one table tells the sizes and the cells to look into.
    first = F.row_number().over(inside) == 1
    level = stored(_hit(counted.withColumn("wants", wants).withColumn("first", first), ["rows", "first"], F.col("first")), "cells")
    sizes, hits = level.where("first").select("key", F.col("rows").alias("n")), level.where(F.size("wants") > 0)
    while shift:
        largest, some = hits.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
        finer = 0 if largest <= CELL_ROWS else max(0, shift - LEVEL_BITS)
        near = _small(hits.select("key", F.col("cell").alias("of"), "wants"), some)
        held = rows.withColumn("of", F.shiftright("h", shift)).join(near.select("key", "of"), ["key", "of"], "left_semi")
        cells = held.groupBy("key", "of", F.shiftright("h", finer).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        counted = cells.withColumn("upto", F.sum("n").over(Window.partitionBy("key", "of").orderBy("cell")))
        hits, shift = _hit(counted.join(near, ["key", "of"]), []), finer
        if shift:
            hits = stored(hits, "cells")
    found = hits.select("key", F.explode("wants").alias("w"), "cell").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("w.j", "cell"))).alias("at"))
    cuts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.element_at("at", j), F.lit(-1)))
    return sizes.join(found, "key", "left").select("key", "n", cuts.alias("cuts"))


def _hit(counted: DataFrame, more: Sequence[str], also: Column | None = None) -> DataFrame:
    """The cells in which a wanted place lies, with the places that remain to be gone within them."""
    before = F.col("upto") - F.col("n")
    here = F.filter("wants", lambda w: (w["place"] > before) & (w["place"] <= F.col("upto")))
    left = F.transform(here, lambda w: F.struct(w["j"].alias("j"), (w["place"] - before).alias("place")))
    kept = F.size("wants") > 0 if also is None else (F.size("wants") > 0) | also
    return counted.withColumn("wants", left).where(kept).select("key", "cell", "n", "wants", *more)


def _with_cuts(df: DataFrame, h: Column, by: str | None, places, use: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """``df`` with ``name``: ``use`` of the row's hash and the cuts of its class."""
    cuts = class_cuts(df, h, by, places)
    few = cuts.limit(BROADCAST_ROWS + 1).collect()
    if by is None:
        found = F.array(*[F.lit(c) for c in few[0]["cuts"]]) if few else F.array(F.lit(-1))
        return df.withColumn(name, use(h, found))
    key = f"{name}__class"
    kept = [c for c in df.columns if c != name]
    keyed = df.select(*[quoted(c) for c in kept], class_key(by).alias(key))
    if len(few) <= BROADCAST_ROWS:
        table = df.sparkSession.createDataFrame([(r["key"], r["cuts"]) for r in few], f"`{key}` string, `{name}__cuts` array<bigint>")
        joined = keyed.join(F.broadcast(table), key, "left")
    else:
        table = stored(cuts.select(F.col("key").alias(key), "n", F.col("cuts").alias(f"{name}__cuts")), "cuts")
        joined = skew_lookup(keyed, table.withColumn("total", F.lit(table.agg(F.sum("n")).first()[0])), [key], [f"{name}__cuts"])
    return joined.select(*[quoted(c) for c in kept], use(h, quoted(f"{name}__cuts")).alias(name))


def assign_test(
    df: DataFrame, id_cols: Sequence[str] = (), *, stratify: str | None = None,
    share: float = 0.2, salt: str = "split", name: str = "is_test",
) -> DataFrame:
    """Mark the ``round(share * n)`` rows with the smallest hash in every class."""
    h = hash52(row_key(df, id_cols), salt)
    places = lambda n: [F.floor(F.lit(share) * n + 0.5)]
    return _with_cuts(df, h, stratify, places, lambda h, cuts: F.coalesce(h <= cuts[0], F.lit(False)), name)


def assign_folds(
    df: DataFrame, id_cols: Sequence[str] = (), *, k: int = 5, stratify: str | None = None,
    salt: str = "fold", name: str = "fold",
) -> DataFrame:
    """Number k folds of equal size (in every class) in hash order."""
    h = hash52(row_key(df, id_cols), salt)
    places = lambda n: [F.floor(n * j / k) for j in range(1, k)] or [F.lit(0)]
    passed = lambda h, cuts: F.size(F.filter(cuts, lambda c: h > c)) if k > 1 else F.lit(0)
    return _with_cuts(df, h, stratify, places, passed, name)


def split(
    df: DataFrame, id_cols: Sequence[str] = (), *, stratify: str | None = None,
    share: float = 0.2, salt: str = "split",
) -> tuple[DataFrame, DataFrame]:
    marked = assign_test(df, id_cols, stratify=stratify, share=share, salt=salt, name="__test")
    return marked.where(~F.col("__test")).drop("__test"), marked.where("__test").drop("__test")


def split_stored(
    df: DataFrame, id_cols: Sequence[str] = (), *, stratify: str | None = None,
    share: float = 0.2, salt: str = "split",
) -> tuple[DataFrame, DataFrame]:
    """``split`` of rows that are marked once and written by side, so that a later scan opens one side's files and hashes no row.

    Columns without a type, which Parquet cannot hold, come back as they were. No column name is reserved.
    """
    side = "side"
    while side.lower() in {c.lower() for c in df.columns}:
        side += "_"
    marked = assign_test(df, id_cols, stratify=stratify, share=share, salt=salt, name=side).withColumn(side, quoted(side).cast("int"))
    typed = marked.select(*[quoted(f.name) for f in marked.schema if f.dataType != T.NullType()])
    path = scratch(df.sparkSession, "split")
    typed.write.partitionBy(side).parquet(path)
    both = df.sparkSession.read.schema(typed.schema).parquet(path)
    back = [F.lit(None).alias(f.name) if f.dataType == T.NullType() else quoted(f.name) for f in df.schema]
    fit, test = (both.where(quoted(side) == s).select(*back) for s in (0, 1))
    return fit, test
