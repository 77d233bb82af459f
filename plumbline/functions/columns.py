"""Column helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextvars import ContextVar, copy_context
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark compiles an aggregate into one loop up to 100 buffer fields; a measure takes
# about two. A chunk reads its own columns only, so more chunks read no more data.
MEASURES = 40


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes null and decimals become doubles, so every statistic skips them alike."""
    out = []
    for f in df.schema:
        c = quoted(f.name)
        if is_float(f.dataType):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def per_column(
    df: DataFrame, cols: Sequence[str], measures: Callable[[str], dict[str, Column]]
) -> DataFrame:
    """One row per column from wide aggregates: single scans, no keyed shuffle."""
    frames = []
    per_chunk = max(1, MEASURES // len(measures(cols[0]))) if cols else 1
    for start in range(0, len(cols), per_chunk):
        structs = [
            F.struct(F.lit(c).alias("column"), *[e.alias(k) for k, e in measures(c).items()])
            for c in cols[start : start + per_chunk]
        ]
        frames.append(df.agg(F.array(*structs).alias("rows")).select(F.inline("rows")))
    return union_all(frames)


def long_form(df: DataFrame, cols: Sequence[str], dtype: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value) for the non-null cells of ``cols``."""
    wide = df.select(*[quoted(k) for k in keep], *[quoted(c).cast(dtype).alias(c) for c in cols])
    return wide.unpivot(list(keep), list(cols), "column", "value").where(F.col("value").isNotNull())


def type_families(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Columns grouped by the widest lossless type they can share in long form."""
    families: dict[str, list[str]] = {}
    for f in df.schema:
        if f.name not in cols:
            continue
        if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
            key = "bigint"
        elif is_float(f.dataType):
            key = "double"
        elif is_datetime(f.dataType):
            key = "timestamp"
        else:
            key = "string"
        families.setdefault(key, []).append(f.name)
    return families


def hash52(key: Column, salt: str = "") -> Column:
    """52-bit number from a key; exact in a double and the same on every engine."""
    text = key.cast("string")
    if salt:
        text = F.concat(F.lit(salt), text)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def row_key(df: DataFrame, id_cols: Sequence[str]) -> Column:
    """The caller's key, or the whole row when there is none."""
    cols = list(id_cols) or df.columns
    return F.to_json(F.struct(*[quoted(c) for c in cols])) if len(cols) > 1 or not id_cols else quoted(cols[0])


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_folder(spark) -> str:
    """The folder all executors share, as the session names it. Only a session with its
    driver and tasks in one process may leave it unset; it gets a folder of its own, once."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        folder = sc.getCheckpointDir()
    return folder


class Ledger:
    """The scratch paths given out while it is open, in its own thread; closing it removes what was written there.

    Tables that read from such a path must not be used after that.
    """

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Ledger:
        self.outer = LEDGER.set(self)
        return self

    def __exit__(self, failure, *_) -> None:
        """Stop listing; after a failure nobody is left to read the tables, so they go at once."""
        LEDGER.reset(self.outer)
        if failure is not None:
            self.close()

    def close(self) -> None:
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[-1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.paths.pop()


LEDGER: ContextVar[Ledger | None] = ContextVar("ledger", default=None)


def scratch(spark, name: str) -> str:
    """A fresh path for a table one step writes and the next reads."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    ledger = LEDGER.get()
    if ledger is not None:
        ledger.paths.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet in the shared folder, and read again from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(df: DataFrame, rows: int, per_task: int = 20_000) -> DataFrame:
    """Fewer, fuller partitions for a small table that many passes will read."""
    return df.repartition(max(1, -(-rows // per_task)))


def for_passes(df: DataFrame, rows: int) -> DataFrame:
    """A table for iterative fits: tasks of 20 000 rows, from 16 tasks on fuller ones up to 100 000, as a pass costs by the task too."""
    return compact(df, rows, max(20_000, min(100_000, -(-rows // 16))))


def side_by_side(spark, work: Sequence[Callable[[], Any]]) -> list[Any]:
    """What the functions return, each run in a thread of its own whose tables the open ledger lists as well."""
    with ThreadPoolExecutor(max(1, len(work))) as threads:
        running = [threads.submit(copy_context().run, inheritable_thread_target(spark)(fn)) for fn in work]
        return [r.result() for r in running]


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
