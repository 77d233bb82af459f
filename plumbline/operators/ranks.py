"""Ranks by range partitions: rows meet sorted by value, and a small table of partitions does the rest.

Rows are dealt by ranges of (column, value, tie), so a value of any number of rows is spread over neighbouring
partitions. A task knows the ranks in its own partition. How many rows come before a partition, and how many rows
of its first and last value lie in its neighbours, is worked out from one row for each partition and column.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted, stored

#: Rows that a task sorts and holds as arrays, 24 bytes each.
TASK_ROWS = 1_000_000
#: A value's rows are cut into so many parts, between which a range may end.
TIES = 1024
FIRST, LAST = 1, 2


def in_ranges(long: DataFrame, value: str, carried: Sequence[str], parts: int) -> DataFrame:
    """(col, key, carried...) sorted by (col, value); adjacent rows have the same key if their values are equal."""
    dealt = long.repartitionByRange(parts, "col", value, "tie").sortWithinPartitions("col", value)
    return dealt.select("col", F.xxhash64(value).alias("key"), *carried)


class Places:
    """The rows of a partition by column: where each value's rows begin and end, and the mean place of each row."""

    def __init__(self, batches):
        whole = pa.Table.from_batches(batches)
        self.table = whole
        self.col = whole.column("col").to_numpy() if whole.num_rows else np.zeros(0, np.int32)
        key = whole.column("key").to_numpy() if whole.num_rows else np.zeros(0, np.int64)
        n = len(key)
        fresh_col, fresh = np.ones(n, bool), np.ones(n, bool)
        fresh_col[1:] = self.col[1:] != self.col[:-1]
        fresh[1:] = fresh_col[1:] | (key[1:] != key[:-1])
        self.starts = np.flatnonzero(fresh_col)
        self.stops = np.append(self.starts[1:], n)[: len(self.starts)]
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, n))
        group = np.cumsum(fresh) - 1
        base = np.repeat(self.starts, self.stops - self.starts)
        self.place = begin[group] - base + (size[group] + 1) / 2.0 if n else np.zeros(0)
        self.key = key
        # The first and the last value of a column may go on in the neighbouring partitions.
        ends = begin[group] + size[group] if n else begin
        self.border = np.where(begin[group] == base, FIRST, 0) | np.where(ends == np.repeat(self.stops, self.stops - self.starts), LAST, 0) if n else np.zeros(0, np.int64)


SUMS = ("n", "first_n", "last_n", "inner_n", "first_w", "last_w", "inner_w", "inner_l", "inner_ll", "inner_wl", "ww")
EDGES = "col int, pid int, first_key bigint, last_key bigint, " + ", ".join(f"{s} {'bigint' if s.endswith('_n') or s == 'n' else 'double'}" for s in SUMS)


def _edges(p: Places, pid: int, weight: np.ndarray) -> pa.RecordBatch:
    """One row for each column of a partition: its first and last value, and sums over the rows between them."""
    rows = []
    for a, b in zip(p.starts.tolist(), p.stops.tolist()):
        border, w, at = p.border[a:b], weight[a:b], p.place[a:b]
        first, last, inner = border & FIRST > 0, border == LAST, border == 0
        l, v = at[inner], w[inner]
        sums = (b - a, first.sum(), last.sum(), inner.sum(), w[first].sum(), w[last].sum(), v.sum(), l.sum(), (l * l).sum(), (l * v).sum(), (w * w).sum())
        rows.append((int(p.col[a]), pid, int(p.key[a]), int(p.key[b - 1]), *[s.item() if hasattr(s, "item") else s for s in sums]))
    columns = list(zip(*rows)) or [[]] * (4 + len(SUMS))
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.int64() if s.endswith("_n") or s == "n" else pa.float64() for s in SUMS]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["col", "pid", "first_key", "last_key", *SUMS])


def border_ranks(edges: DataFrame) -> DataFrame:
    """The edges with ``total`` rows of the column, ``before`` the partition, and first_rank and last_rank, over all partitions.

    One row for each partition and column, so it is small at any size of the table.
    """
    whole = Window.partitionBy("col")
    inside = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    placed = edges.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("total", F.sum("n").over(whole))
    first = F.struct(F.lit("first").alias("side"), F.col("first_key").alias("key"), F.col("before").alias("start"), F.col("first_n").alias("held"))
    last = F.struct(F.lit("last").alias("side"), F.col("last_key").alias("key"), (F.col("before") + F.col("n") - F.col("last_n")).alias("start"), F.col("last_n").alias("held"))
    sides = placed.select(F.struct(*placed.columns).alias("edge"), F.inline(F.array(first, last)))
    same = Window.partitionBy("edge.col", "key")
    ranks = sides.withColumn("rank", F.min("start").over(same) + (F.sum("held").over(same) + 1) / 2.0)
    rank = lambda side: F.max(F.when(F.col("side") == side, F.col("rank"))).alias(f"{side}_rank")
    return ranks.groupBy("edge").agg(rank("first"), rank("last")).select("edge.*", "first_rank", "last_rank")


def rank_correlation(df: DataFrame, values: Sequence[Column], target: Column) -> DataFrame:
    """(col, rows, rho): Spearman's rho of every value with the target, over rows where both are present, ties averaged.

    ``col`` numbers the values. Values are numbers; the target is anything that can be ordered, with any number of values. Two
    shuffles of (column, value): by value, which gives its rank, and by target, where the sums are made.
    """
    base = df.select(target.alias("y"), F.array(*[v.cast("double") for v in values]).alias("xs")).where("y is not null")
    tie = F.pmod(F.monotonically_increasing_id(), F.lit(TIES)).cast("int")
    long = base.withColumn("tie", tie).select("y", "tie", F.posexplode("xs").alias("col", "x")).where("x is not null")
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * len(values) // TASK_ROWS))

    def by_value(batches):
        from pyspark import TaskContext

        p = Places(list(batches) or [pa.RecordBatch.from_pylist([], schema=carried)])
        columns = [pa.array(np.full(len(p.key), TaskContext.get().partitionId(), np.int32)), pa.array(p.place), pa.array(p.border.astype(np.int32)), pa.array(p.key)]
        table = p.table.drop_columns(["key"])
        for name, column in zip(("pid", "place", "border", "key"), columns):
            table = table.append_column(name, column)
        yield from table.to_batches(max_chunksize=65_536)

    y_type = dict(base.dtypes)["y"]
    carried = pa.schema([("col", pa.int32()), ("key", pa.int64()), ("y", pa.string() if y_type == "string" else pa.float64()), ("tie", pa.int32())])
    ranked = in_ranges(long, "x", ["y", "tie"], parts).mapInArrow(by_value, f"col int, y {y_type}, tie int, pid int, place double, border int, key bigint")
    ranked = stored(ranked, "ranks")
    n = lambda cond: F.count(F.when(cond, 1))
    first, last = F.col("border").bitwiseAND(FIRST) > 0, F.col("border") == LAST
    edges = ranked.groupBy("col", "pid").agg(
        F.count(F.lit(1)).alias("n"), n(first).alias("first_n"), n(last).alias("last_n"), F.max(F.when(first, F.col("key"))).alias("first_key"),
        F.max(F.when(F.col("border").bitwiseAND(LAST) > 0, F.col("key"))).alias("last_key"),
    )
    small = stored(border_ranks(edges).select("col", "pid", "before", "first_rank", "last_rank", "total"), "borders")
    rank = F.when(first, F.col("first_rank")).when(last, F.col("last_rank")).otherwise(F.col("before") + F.col("place"))
    # As many rows as partitions and columns, so its size does not follow the table.
    weighed = ranked.join(F.broadcast(small), ["col", "pid"]).select("col", "y", "tie", (rank - (F.col("total") + 1) / 2.0).alias("w"))

    def by_target(batches):
        from pyspark import TaskContext

        rows = list(batches)
        if rows:
            p = Places(rows)
            yield _edges(p, TaskContext.get().partitionId(), p.table.column("w").to_numpy())

    sums = border_ranks(stored(in_ranges(weighed, "y", ["w"], parts).mapInArrow(by_target, EDGES), "sums"))
    mid = (F.col("total") + 1) / 2.0
    shift = F.col("before") - mid
    sxy = shift * F.col("inner_w") + F.col("inner_wl") + (F.col("first_rank") - mid) * F.col("first_w") + (F.col("last_rank") - mid) * F.col("last_w")
    syy = F.col("inner_n") * shift * shift + 2 * shift * F.col("inner_l") + F.col("inner_ll")
    for side in ("first", "last"):
        syy = syy + F.col(f"{side}_n") * F.pow(F.col(f"{side}_rank") - mid, F.lit(2.0))
    out = sums.groupBy("col").agg(F.sum("n").alias("rows"), F.sum(sxy).alias("sxy"), F.sum(syy).alias("syy"), F.sum("ww").alias("sxx"))
    return out.select("col", "rows", F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("rho"))


def spearman(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(column, rows, rho): Spearman correlation of every numeric column with the target, as ``rank_correlation``.

    A target of text is ranked as text. A column without a row of both is left out; a constant side gives null.
    """
    cols = [c for c in cols if c != target]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rows bigint, rho double")
    text = dict(df.dtypes)[target] in ("string", "date", "timestamp", "timestamp_ntz", "boolean")
    y = quoted(target).cast("string" if text else "double")
    out = rank_correlation(df, [quoted(c) for c in cols], y)
    return out.select(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("col") + 1).alias("column"), "rows", "rho")
