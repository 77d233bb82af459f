"""The results of a run as tables, ready to be written or plotted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.train import Result


def report(result: Result, spark: SparkSession) -> dict[str, DataFrame]:
    """Every section of the report under its name."""
    a, d = result.audit, result.detection
    facts = [
        ("rows", str(a.rows)), ("columns", str(a.columns)), ("size_class", a.size_class), ("duplicates", str(a.duplicates)),
        ("target", a.target or ""), ("problem", d.problem), ("subtype", d.subtype or ""), ("confidence", d.confidence),
        ("method", d.method), ("model", result.model.meta["model_name"]),
        ("features_original", str(len(result.selection.original))), ("features_remaining", str(len(result.selection.kept))),
    ]
    out = {
        "summary": spark.createDataFrame(facts, "item string, value string"),
        "metrics": spark.createDataFrame(
            [(k, float(v)) for k, v in result.metrics.items() if v is not None], "metric string, value double"
        ),
        "signals": spark.createDataFrame(
            [(s, None if v is None else float(v), side, float(w)) for s, v, side, w in d.signals],
            "signal string, value double, vote string, weight double",
        ),
        "findings": a.findings,
        "dropped": result.selection.ledger(spark),
        "preparation": spark.createDataFrame(result.model.prepared.notes, "column string, step string"),
        "run_log": result.run_log(spark),
        "model_card": result.model.card(spark),
    }
    out.update(result.tables)
    return out


def write_report(result: Result, spark: SparkSession, path: str) -> list[str]:
    """Each section as a parquet table below ``path``."""
    tables = report(result, spark)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return sorted(tables)
