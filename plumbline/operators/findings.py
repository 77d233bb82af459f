"""The audit as a ledger of findings and the columns they condemn."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Thresholds
from plumbline.functions.columns import union_all
from plumbline.operators import association, audit
from plumbline.operators.ordering import quantiles

LIMITS = Thresholds()

# A later check overwrites an earlier reason.
PRIORITY = {"missing": 1, "quasi_constant": 2, "id_like": 3, "leakage": 4}


@dataclass
class Audit:
    """What later steps need from a profile; only per-column facts, never rows."""

    rows: int
    columns: int
    size_class: str
    duplicates: int
    target: str | None
    target_type: str | None
    target_distinct: int
    class_shares: dict[str, float]
    imbalance_ratio: float | None
    imbalance_severity: str | None
    types: dict[str, str]
    missing: dict[str, float]
    stats: dict[str, dict[str, float]]
    quasi_constant: list[str]
    id_like: list[str]
    high_cardinality: list[str]
    outliers: dict[str, tuple[float, str]]
    skewed: dict[str, tuple[float, str]]
    pairs: list[tuple[str, str, float]]
    leakage: dict[str, tuple[float, str]]
    drops: dict[str, str]
    findings: DataFrame | None = field(default=None, repr=False)

    @property
    def imbalanced(self) -> bool:
        return self.imbalance_severity in ("severe", "moderate")

    def of_type(self, kind: str) -> list[str]:
        return [c for c, t in self.types.items() if t == kind]


def drop_ledger(findings: DataFrame, user_drops: list[str] | None = None) -> DataFrame:
    """One reason per column: the check that ran last wins; the user's drops leave the list."""
    order = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    out = findings.where(F.col("kind").isin(list(PRIORITY))).groupBy("column").agg(
        F.max_by("kind", order[F.col("kind")]).alias("reason")
    )
    return out.where(~F.col("column").isin(user_drops)) if user_drops else out


def structural_findings(df: DataFrame, target: str | None = None, limits: Thresholds = LIMITS) -> DataFrame:
    """(column, kind, value) rows for missing, quasi-constant and id-like columns.

    A quasi-constant column is not checked further, as in a pass that stops there.
    """
    features = [c for c in df.columns if c != target]
    card = audit.cardinality(df, features)
    gone = audit.quasi_constant(card, limits).select(
        "column", F.lit("quasi_constant").alias("kind"), F.col("top_share").alias("value")
    )
    miss = audit.missing_shares(df, features, limits).where("drop").select(
        "column", F.lit("missing").alias("kind"), F.col("missing").alias("value")
    )
    ids = audit.id_like(df, card).select(
        "column", F.lit("id_like").alias("kind"), F.col("distinct").cast("double").alias("value")
    )
    return union_all([miss, gone, ids])


def _size_class(n: int, limits: Thresholds) -> str:
    bounds = ((limits.small_rows, "very_small"), (limits.medium_rows, "small"), (limits.large_rows, "medium"))
    return next((name for top, name in bounds if n < top), "large")


def run_audit(
    df: DataFrame,
    target: str | None = None,
    *,
    drop: list[str] | None = None,
    id_cols: list[str] | None = None,
    sample: bool = False,
    normalise_mi: str = "target_entropy",
    limits: Thresholds = LIMITS,
    duplicates: int | None = None,
) -> Audit:
    """Profile a table; ``duplicates`` saves counting them where that was done. Association runs on all rows unless ``sample`` asks for the bounded sample."""
    if target is not None and target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    features = [c for c in df.columns if c != target]
    facts = {r["column"]: r for r in audit.first_pass(df, features, limits).collect()}
    n = next(iter(facts.values()))["rows"] if facts else df.count()
    types = {c: r["logical_type"] for c, r in facts.items()}
    numeric = [c for c in features if types[c] == "numeric"]
    card = {r["column"]: r for r in audit.cardinality(df, features).collect()}
    missing = {c: r["missing"] for c, r in facts.items() if r["missing"] > 0}

    quasi, ids, high = [], [], []
    kinds: list[tuple[str, str, float]] = [
        (c, "missing", m) for c, m in missing.items() if m > limits.missing_drop
    ]
    wide_types = dict(df.dtypes)
    for c in features:
        if c not in card:
            continue
        r = card[c]
        if r["distinct"] <= 1 or (r["distinct"] == 2 and r["top"] / r["present"] > limits.quasi_constant):
            quasi.append(c)
            kinds.append((c, "quasi_constant", r["top"] / r["present"]))
        elif r["distinct"] == r["present"] and (wide_types[c] == "bigint" or audit.is_text(df, c)):
            ids.append(c)
            kinds.append((c, "id_like", float(r["distinct"])))
        elif types[c] == "categorical" and r["distinct"] > limits.high_cardinality:
            high.append(c)
            kinds.append((c, "high_cardinality", float(r["distinct"])))

    present = [c for c in numeric if c in card]
    q = quantiles(df, present, [0.25, 0.5, 0.75])
    stats = {
        c: {"median": q[c][1], **{k: facts[c][k] for k in ("mean", "std", "min", "max")}} for c in present
    }
    checked = [c for c in present if c not in quasi and c not in ids]
    outliers, skewed = {}, {}
    if checked:
        fences = {c: (q[c][0], q[c][2]) for c in checked}
        for r in audit.outlier_shares(df, checked, limits, fences).where("severity <> 'none'").collect():
            outliers[r["column"]] = (r["outlier_share"], r["severity"])
            kinds.append((r["column"], "outliers", r["outlier_share"]))
        for c in checked:
            skew = facts[c]["skew"]
            if skew is not None and abs(skew) > limits.skewed:
                skewed[c] = (skew, "log_transform" if facts[c]["min"] >= 0 else "none")
                kinds.append((c, "skewed", skew))

    condemned = {c for c, k, _ in kinds if k in PRIORITY}
    pool = [c for c in numeric if c not in condemned]
    part = audit.hash_sample(df, id_cols or [], limits.profile_sample) if sample else df
    pairs = [
        (r["later"], r["earlier"], r["r"])
        for r in association.pearson_pairs(part, pool, limits.correlation).collect()
    ]
    leaks: dict[str, tuple[float, str]] = {}
    shares: dict[str, float] = {}
    ratio = severity = target_type = None
    target_distinct = 0
    if target is not None:
        t = audit.target_profile(df, target).first()
        target_type, target_distinct = t["spark_type"], t["distinct"]
        if target_distinct < limits.class_profile_max:
            shares = {r["class"]: r["share"] for r in audit.class_shares(df, target, limits).collect()}
            if shares:
                ratio = min(shares.values())
                severity = (
                    "severe" if ratio < limits.imbalance_severe
                    else "moderate" if ratio < limits.imbalance else "balanced"
                )
        found = []
        if pool and target_distinct > 1:
            found.append(association.leakage(association.spearman(part, pool, target), "rho", "spearman", limits))
        cats = [c for c in features if types[c] == "categorical" and c not in condemned]
        if cats and 1 < target_distinct < limits.class_profile_max:
            scores = association.mutual_information(part, cats, target, normalise_mi)
            found.append(association.leakage(scores, "score", "mutual_info", limits))
        for f in found:
            for r in f.collect():
                leaks[r["column"]] = (r["score"], r["signal"])
                kinds.append((r["column"], "leakage", r["score"]))

    drops: dict[str, str] = {}
    for kind in PRIORITY:
        drops.update({c: kind for c, k, _ in kinds if k == kind})
    for c in drop or []:
        drops.pop(c, None)
    ledger = df.sparkSession.createDataFrame(
        [(c, k, float(v)) for c, k, v in kinds], "column string, kind string, value double"
    )
    return Audit(
        rows=n, columns=len(df.columns), size_class=_size_class(n, limits),
        duplicates=audit.duplicate_rows(df).first()["duplicates"] if duplicates is None else duplicates,
        target=target, target_type=target_type, target_distinct=target_distinct,
        class_shares=shares, imbalance_ratio=ratio, imbalance_severity=severity,
        types=types, missing=missing, stats=stats, quasi_constant=quasi, id_like=ids,
        high_cardinality=high, outliers=outliers, skewed=skewed, pairs=pairs,
        leakage=leaks, drops=drops, findings=ledger,
    )
