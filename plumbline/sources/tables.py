"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted


def read_table(
    spark: SparkSession, path: str, *, format: str | None = None,
    schema: str | T.StructType | None = None, sep: str = ",",
) -> DataFrame:
    """Read CSV with a header (types inferred unless a schema is given), parquet or JSON."""
    kind = format or ("csv" if path.rstrip("/").endswith(".csv") else "json" if path.rstrip("/").endswith(".json") else "parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "csv":
        # Quotes inside quoted text are doubled, as other CSV writers do.
        reader = reader.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
        reader = reader.option("multiLine", schema is not None)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return reader.format(kind).load(path)


def write_table(df: DataFrame, path: str, *, format: str = "parquet", sep: str = ",", mode: str = "overwrite") -> str:
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    writer.format(format).save(path)
    return path


def describe_input(df: DataFrame) -> DataFrame:
    """Rows and columns of an input; fails when there is nothing to learn from."""
    if not df.columns:
        raise ValueError("the input has no columns")
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def records_table(records: DataFrame | Sequence[dict], schema: str, spark: SparkSession | None = None, column: str = "value") -> DataFrame:
    """Records as a typed table: a list of dicts, or a column of JSON objects."""
    if isinstance(records, DataFrame):
        return records.select(F.from_json(quoted(column), schema).alias("r")).select("r.*")
    fields = T._parse_datatype_string(schema)
    rows = [tuple(r.get(f.name) for f in fields) for r in records]
    return spark.createDataFrame(rows, fields)
