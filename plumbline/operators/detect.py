"""Is the target a class, a quantity, or absent? Evidence is voted on by weight."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import is_float, is_numeric, quoted
from plumbline.functions.normality import k2_pvalue, shapiro_pvalue
from plumbline.operators.ordering import bucketed

SHAPIRO_ROWS = 5000

EVIDENCE = (
    "target string, kind string, rows bigint, distinct bigint, entropy double, gap_variance double, "
    "integer_valued boolean, p_normal double, min double, max double, skew double"
)


def value_entropy(df: DataFrame, target: str) -> DataFrame:
    """Entropy (nats) of the value shares of a column."""
    counts = df.where(quoted(target).isNotNull()).groupBy(quoted(target)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("distinct"),
        (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("entropy"),
    )


def gap_variance(df: DataFrame, target: str) -> DataFrame:
    """Population variance of the gaps between neighbouring distinct values.

    Distinct values are ordered per equi-depth bucket; a gap that spans buckets comes
    from the bucket table (largest value of the last bucket before).
    """
    x = df.select(quoted(target).cast("double").alias("value")).where("value is not null")
    distinct = bucketed(x, ["value"]).select("value", F.col("value__b").alias("bucket")).distinct()
    inside = Window.partitionBy("bucket").orderBy("value")
    across = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = distinct.groupBy("bucket").agg(F.max("value").alias("top")).select(
        "bucket", F.max("top").over(across).alias("before")
    )
    gaps = (
        distinct.withColumn("prev", F.lag("value").over(inside))
        .join(F.broadcast(edges), "bucket")
        .select((F.col("value") - F.coalesce("prev", "before")).alias("gap"))
    )
    return gaps.agg(
        (F.count(F.lit(1))).alias("distinct"),
        F.coalesce(F.var_pop("gap"), F.lit(0.0)).alias("gap_variance"),
    )


def moments(df: DataFrame, target: str) -> DataFrame:
    """Count, moments, range, whole-number test and the K2 p-value of a numeric column."""
    x = quoted(target).cast("double")
    n, g1, g2 = F.count(x), F.skewness(x), F.kurtosis(x)
    out = df.agg(
        n.alias("rows"), g1.alias("skew"), g2.alias("kurtosis"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.coalesce(F.bool_and(x == F.floor(x)), F.lit(True)).alias("integer_valued"),
    )
    return out.withColumn(
        "p_normal",
        F.when((F.col("rows") >= 8) & F.col("skew").isNotNull(), k2_pvalue(F.col("rows"), F.col("skew"), F.col("kurtosis"))),
    )


def evidence(df: DataFrame, target: str, *, shapiro: bool = True) -> DataFrame:
    """One row of everything the vote looks at."""
    dtype = df.schema[target].dataType
    numeric = is_numeric(dtype)
    kind = "number" if is_float(dtype) else "integer" if numeric else "category"
    ent = value_entropy(df, target)
    base = ent.select(
        F.lit(target).alias("target"), F.lit(kind).alias("kind"),
        F.coalesce("rows", F.lit(0)).alias("rows"), "distinct", F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
    )
    if not numeric:
        return base.select(
            "*", F.lit(0.0).alias("gap_variance"), F.lit(False).alias("integer_valued"),
            F.lit(0.0).alias("p_normal"), *[F.lit(None).cast("double").alias(c) for c in ("min", "max", "skew")],
        )
    m = moments(df, target).first()
    gap = gap_variance(df, target).first()["gap_variance"]
    p = m["p_normal"]
    if m["rows"] < 3:
        p = 0.0
    elif m["rows"] <= SHAPIRO_ROWS:
        # The test is defined for at most 5000 values, so the collected list is bounded.
        values = [r[0] for r in df.select(quoted(target).cast("double")).where(quoted(target).isNotNull()).collect()]
        p = shapiro_pvalue(values) if shapiro else 0.0
    return base.select(
        "*", F.lit(gap).cast("double").alias("gap_variance"), F.lit(m["integer_valued"]).alias("integer_valued"),
        F.lit(p).cast("double").alias("p_normal"), F.lit(m["min"]).cast("double").alias("min"),
        F.lit(m["max"]).cast("double").alias("max"), F.lit(m["skew"]).cast("double").alias("skew"),
    )


def votes(ev: DataFrame) -> DataFrame:
    """(target, signal, value, vote, weight): every signal that takes a side."""
    e, g, d = F.col("entropy"), F.col("gap_variance"), F.col("distinct")
    numeric = F.col("kind") != "category"
    spaced = numeric & (d > 2)

    def signal(name, value, *sides):
        choice = F.when(F.lit(False), F.struct(F.lit("").alias("vote"), F.lit(0.0).alias("weight")))
        for cond, vote, weight in sides:
            choice = choice.when(cond, F.struct(F.lit(vote).alias("vote"), F.lit(weight).alias("weight")))
        return F.struct(F.lit(name).alias("signal"), value.cast("double").alias("value"), choice.alias("side"))

    c, r = "classification", "regression"
    # The weight of each piece of evidence.
    rows = F.array(
        signal("entropy", e, ((e > 0) & (e < 1.0), c, 2.0), (e > 2.5, r, 2.0)),
        signal("normality", F.col("p_normal"), (numeric & (F.col("p_normal") > 0.05), r, 2.5)),
        signal("gap_variance", g, (spaced & (g < 0.1), c, 1.0), (spaced & (g > 5.0), r, 1.0)),
        signal(
            "type", F.lit(None), (~numeric, c, 3.0),
            ((F.col("kind") == "number") & ~F.col("integer_valued"), r, 3.0),
        ),
        signal("distinct", d, (d <= 2, c, 4.0), (d <= 5, c, 2.5), ((d > 50) & numeric, r, 2.0)),
    )
    return (
        ev.select("target", F.inline(rows))
        .where(F.col("side").isNotNull())
        .select("target", "signal", "value", "side.vote", "side.weight")
    )


def decide(ev: DataFrame, on_ambiguous: str = "classification") -> DataFrame:
    """Scores, decision, confidence and subtype from one evidence row."""
    score = votes(ev).groupBy("target").pivot("vote", ["classification", "regression"]).agg(F.sum("weight"))
    x = ev.join(F.broadcast(score), "target", "left")
    cs = F.coalesce(F.col("classification"), F.lit(0.0))
    rs = F.coalesce(F.col("regression"), F.lit(0.0))
    d = F.col("distinct")
    whole = (F.col("kind") == "integer") | F.col("integer_valued")
    unclear = (F.col("kind") != "category") & whole & (d > 5) & (d <= 100)
    asked = unclear | (cs == rs)
    problem = F.when(asked, F.lit(on_ambiguous)).when(cs > rs, "classification").otherwise("regression")
    top = F.greatest(cs, rs) / (cs + rs)
    x = x.select(
        "*", cs.alias("class_score"), rs.alias("value_score"), asked.alias("ambiguous"), problem.alias("problem"),
        F.when(asked, "high").when(cs + rs <= 0, "low").when(top >= 0.75, "high").when(top >= 0.6, "medium")
        .otherwise("low").alias("confidence"),
    )
    return x.select(
        "target", "problem", "confidence", "ambiguous", "class_score", "value_score", "distinct",
        subtype(F.col("problem")).alias("subtype"),
    )


def subtype(problem):
    d, lo, hi = F.col("distinct"), F.col("min"), F.col("max")
    return (
        F.when(
            problem == "classification",
            F.when(d == 2, "binary").when((d >= 3) & (d <= 15), "multiclass").otherwise("many_class"),
        )
        .when(lo.isNull() | hi.isNull(), "standard")
        .when((lo >= 0) & (hi <= 1), "probability")
        .when(lo >= 0, "bounded_positive")
        .otherwise("unbounded")
    )


def log_target(ev: DataFrame) -> DataFrame:
    """A strongly skewed, non-negative quantity is learned on the log scale."""
    return ev.select(
        "target", "skew", ((F.col("kind") != "category") & (F.abs("skew") > 1.0) & (F.col("min") >= 0)).alias("log_target")
    )


def sanity(ev: DataFrame, problem: str) -> DataFrame:
    """Warnings about a choice the target speaks against."""
    d = F.col("distinct")
    text = (
        F.when((F.lit(problem) == "regression") & (d <= 2), "regression on a target of two values or fewer")
        .when(
            (F.lit(problem) == "classification") & (F.col("kind") == "number") & (d > 50),
            "classification on a real-valued target with more than 50 values",
        )
    )
    return ev.select("target", F.lit(problem).alias("problem"), "distinct", text.alias("warning")).where(
        F.col("warning").isNotNull()
    )


def feature_mix(types: DataFrame) -> DataFrame:
    """A weak vote from the share of numeric features; not part of the default decision."""
    share = F.avg(F.when(F.col("logical_type") == "numeric", 1.0).otherwise(0.0))
    return (
        types.where(F.col("logical_type").isin("numeric", "categorical"))
        .agg(share.alias("numeric_share"))
        .select(
            "numeric_share",
            F.when(F.col("numeric_share") > 0.75, "regression").when(F.col("numeric_share") < 0.25, "classification")
            .otherwise("neutral").alias("vote"),
            F.when((F.col("numeric_share") > 0.75) | (F.col("numeric_share") < 0.25), 0.5).otherwise(0.0).alias("weight"),
        )
    )


@dataclass
class Detection:
    problem: str
    confidence: str
    subtype: str | None = None
    classes: int = 0
    log_target: bool = False
    method: str = "inferred"
    warnings: list[str] = field(default_factory=list)
    signals: list[tuple[str, float | None, str, float]] = field(default_factory=list)


def detect(
    df: DataFrame, target: str | None, force: str | None = None, on_ambiguous: str = "classification"
) -> Detection:
    """Decide the problem type; ``force`` overrides, no target means clustering."""
    if force is not None and force not in ("classification", "regression", "clustering"):
        raise ValueError(f"unknown problem type {force!r}")
    if force == "clustering" or (force is None and target is None):
        return Detection(
            "clustering", "high", method="user" if force else "inferred",
            signals=[] if force else [("target_column", None, "clustering", 5.0)],
        )
    if target is None:
        raise ValueError(f"{force} needs a target column")
    ev = materialised_evidence(df, target)
    row = decide(ev, force or on_ambiguous).first()
    facts = ev.first()
    problem = force or row["problem"]
    sub = ev.select(subtype(F.lit(problem)).alias("s")).first()["s"]
    if force == "classification" and facts["distinct"] != 2:
        sub = "multiclass" if facts["distinct"] <= 15 else "many_class"
    return Detection(
        problem=problem,
        confidence="high" if force else row["confidence"],
        subtype=sub,
        classes=facts["distinct"] if problem == "classification" else 0,
        log_target=problem == "regression" and log_target(ev).first()["log_target"],
        method="user" if force else "caller_choice" if row["ambiguous"] else "inferred",
        warnings=[r["warning"] for r in sanity(ev, problem).collect()],
        signals=[tuple(r)[1:] for r in votes(ev).collect()],
    )


def materialised_evidence(df: DataFrame, target: str) -> DataFrame:
    """The evidence row as a one-row table, so the vote does not rescan the data."""
    ev = evidence(df, target)
    schema = T._parse_datatype_string(EVIDENCE)
    return df.sparkSession.createDataFrame([tuple(ev.select(*schema.names).first())], schema)
