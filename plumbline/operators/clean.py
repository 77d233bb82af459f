"""Column repairs. Each returns SQL text, so a fitted plan can be saved and read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Thresholds
from plumbline.functions.columns import per_column, quoted, sql_text
from plumbline.operators.ordering import quantiles

LIMITS = Thresholds()


def coercible(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of all rows whose text reads as a number."""
    return per_column(
        df, cols, lambda c: {"share": F.avg(quoted(c).cast("string").try_cast("double").isNotNull().cast("double"))}
    )


def coerced(df: DataFrame, cols: Sequence[str], limits: Thresholds = LIMITS) -> list[str]:
    if not cols:
        return []
    return [r["column"] for r in coercible(df, cols).where(F.col("share") > limits.coerce_share).collect()]


def to_number(x: str) -> str:
    return f"try_cast({x} AS DOUBLE)"


def clip_bounds(df: DataFrame, cols: Sequence[str], limits: Thresholds = LIMITS) -> dict[str, list[float]]:
    return quantiles(df, cols, [limits.clip_low, limits.clip_high])


def clip(x: str, low: float, high: float) -> str:
    # least and greatest skip nulls, so a null has to be kept by hand.
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, {high!r}D), {low!r}D) END"


def log1p(x: str) -> str:
    return f"log1p({x})"


def common_values(df: DataFrame, cols: Sequence[str], limits: Thresholds = LIMITS) -> dict[str, list[str]]:
    """Values holding at least the rare share; at 1 % there are 100 at most."""
    if not cols:
        return {}
    wide = df.select(*[quoted(c).cast("string").alias(c) for c in cols])
    counts = wide.unpivot([], list(cols), "column", "value").where("value is not null").groupBy(
        "column", "value"
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("values"))
    kept = counts.join(F.broadcast(totals), "column").where(F.col("n") / F.col("total") >= limits.rare_share)
    out: dict[str, list[str]] = {c: [] for c in cols}
    sizes: dict[str, int] = {}
    for r in kept.select("column", "value", "values").collect():
        out[r["column"]].append(r["value"])
        sizes[r["column"]] = r["values"]
    # Columns without a rare value need no rule.
    return {c: sorted(v) for c, v in out.items() if sizes.get(c, -1) != len(v)}


def group_rare(x: str, common: Sequence[str]) -> str:
    if not common:
        return f"CASE WHEN {x} IS NOT NULL THEN '__other__' END"
    listed = ", ".join(sql_text(v) for v in common)
    return f"CASE WHEN {x} IS NULL OR {x} IN ({listed}) THEN {x} ELSE '__other__' END"


def boolean(x: str, dtype: str) -> str:
    if dtype == "string":
        return f"CASE WHEN {x} IN ('True', '1') THEN 1.0D WHEN {x} IN ('False', '0') THEN 0.0D END"
    return f"CAST(CAST({x} AS INT) AS DOUBLE)"


def date_parts(name: str, x: str) -> dict[str, str]:
    ts = f"try_cast({x} AS TIMESTAMP)"
    return {
        f"{name}_year": f"CAST(year({ts}) AS DOUBLE)",
        f"{name}_month": f"CAST(month({ts}) AS DOUBLE)",
        f"{name}_day": f"CAST(day({ts}) AS DOUBLE)",
        f"{name}_dow": f"CAST(weekday({ts}) AS DOUBLE)",
    }


def select_as(df: DataFrame, columns: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[quoted(k) for k in keep], *[F.expr(sql).alias(c) for c, sql in columns.items()])


def outlier_cell_share(df: DataFrame, cols: Sequence[str]) -> float:
    """Mean over columns of the share of cells outside the fences; nulls count as 0."""
    filled = df.select(*[F.coalesce(quoted(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    fences = {c: (q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0]))
              for c, q in quantiles(filled, cols, [0.25, 0.75]).items()}
    shares = per_column(
        filled, list(cols),
        lambda c: {"share": F.avg(((quoted(c) < fences[c][0]) | (quoted(c) > fences[c][1])).cast("double"))},
    )
    return shares.agg(F.avg("share")).first()[0]


def scaler_choice(outlier_share: float, limits: Thresholds = LIMITS) -> str:
    return "robust" if outlier_share > limits.robust_switch else "standard"


def fit_scaler(df: DataFrame, cols: Sequence[str], kind: str) -> dict[str, tuple[float, float, float]]:
    """(median for nulls, centre, divisor) per column, measured after imputation."""
    medians = {c: q[0] if q[0] is not None else 0.0 for c, q in quantiles(df, cols, [0.5]).items()}
    filled = df.select(*[F.coalesce(quoted(c).cast("double"), F.lit(medians[c])).alias(c) for c in cols])
    if kind == "robust":
        spread = {c: (q[1], q[2] - q[0]) for c, q in quantiles(filled, cols, [0.25, 0.5, 0.75]).items()}
    else:
        rows = per_column(
            filled, list(cols), lambda c: {"mean": F.avg(quoted(c)), "std": F.stddev_pop(quoted(c))}
        ).collect()
        spread = {r["column"]: (r["mean"], r["std"]) for r in rows}
    return {c: (medians[c], spread[c][0], spread[c][1] or 1.0) for c in cols}


def scale(x: str, params: tuple[float, float, float]) -> str:
    median, centre, divisor = params
    return f"(coalesce({x}, {median!r}D) - {centre!r}D) / {divisor!r}D"
