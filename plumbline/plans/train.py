"""One raw table to a scored, explained and saved model."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.functions.columns import Ledger, for_passes, materialise, normalise, quoted, union_all
from plumbline.operators import attribution, audit as auditing, cluster, cluster_metrics, drops, metrics
from plumbline.operators.detect import Detection, detect
from plumbline.operators.findings import Audit, run_audit
from plumbline.operators.limits import limitations
from plumbline.operators.prepare import prepare
from plumbline.operators.resample import oversample
from plumbline.operators.search import Facts, Study, build, cross_validate, search
from plumbline.operators.select import PROBE_ROUNDS, Selection, check_selection, eliminate, select_features
from plumbline.operators.split import assign_folds, split_stored
from plumbline.sources.artifacts import FittedModel, timestamp

TREES = ("lightgbm", "xgboost", "random_forest")


class StepFailed(RuntimeError):
    def __init__(self, step: str, cause: Exception):
        self.step = step
        super().__init__(f"step {step!r} failed: {cause}")


@dataclass
class Result:
    audit: Audit
    detection: Detection
    selection: Selection
    model: FittedModel
    study: Study | None
    clustering: cluster.Clustering | None
    metrics: dict[str, float | None]
    tables: dict[str, DataFrame]
    log: list[tuple[str, float, str, str | None]] = field(default_factory=list)
    ledger: Ledger | None = None

    def __enter__(self) -> Result:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Remove the run's scratch tables, once the report is written and the model saved; both may still read them."""
        if self.ledger is not None:
            self.ledger.close()

    def run_log(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.log, "step string, seconds double, status string, error string")


class Steps:
    """Runs named steps in order; a failure names its step and ends the run."""

    def __init__(self) -> None:
        self.log: list[tuple[str, float, str, str | None]] = []

    def run(self, name: str, fn: Callable[[], Any]) -> Any:
        start = time.time()
        try:
            out = fn()
        except Exception as e:
            self.log.append((name, time.time() - start, "failed", str(e)[:500]))
            raise StepFailed(name, e) from e
        self.log.append((name, time.time() - start, "done", None))
        return out


def train(df: DataFrame, settings: Settings, *, check: bool = True) -> Result:
    """Deduplicate, detect, split, audit, prepare, select, search, evaluate.

    The held-out rows are set aside first; everything is fitted on the rest. The run's scratch tables are
    removed when it fails, and else when its result is closed.
    """
    with Ledger(df.sparkSession) as ledger:
        result = _train(df, settings, check)
    result.ledger = ledger
    return result


def _train(df: DataFrame, settings: Settings, check: bool) -> Result:
    spark = df.sparkSession
    steps = Steps()
    target = None if settings.unsupervised else settings.target
    settings = Settings(**{**settings.__dict__, "target": target})
    rounds = PROBE_ROUNDS if settings.max_iter is None else min(PROBE_ROUNDS, settings.max_iter)
    copies = 0

    def load() -> DataFrame:
        nonlocal copies
        if target is not None and target not in df.columns:
            raise ValueError(f"target column {target!r} is not in the table")
        out = normalise(drops.drop_listed(df, [c for c in settings.drop if c != target]))
        if target is not None:
            out = drops.with_target(out, target)
        if out.isEmpty():
            raise ValueError("the table has no rows to learn from")
        repeated = drops.repeated_digests(out)
        copies = auditing.duplicate_rows(out, repeated).first()["duplicates"]
        if copies:
            out = materialise(drops.drop_duplicates(out, repeated=repeated))
        return out

    table = steps.run("load", load)
    found: Detection = steps.run("detect", lambda: detect(table, target, settings.problem, settings.on_ambiguous))
    if found.problem == "clustering":
        target = None
        settings.target = None
    parts = steps.run("split", lambda: _split(table, found, settings))
    fit_on = parts[0]
    profile: Audit = steps.run(
        # The report counts the copies of the raw table, which are gone from the training rows.
        "audit", lambda: run_audit(fit_on, target, drop=settings.drop, id_cols=settings.id_cols, limits=settings.thresholds, duplicates=copies)
    )
    plan, matrix = steps.run("prepare", lambda: prepare(fit_on, profile, found, settings))
    matrix = materialise(matrix)
    chosen: Selection = steps.run(
        "select",
        lambda: select_features(
            matrix, plan.outputs, found.problem, found.classes, leaks=list(profile.leakage), constants=profile.quasi_constant,
            pairs=profile.pairs, seed=settings.seed, trees=rounds, limits=settings.thresholds,
        ),
    )
    if found.problem == "clustering":
        return _finish_clustering(spark, steps, settings, profile, found, plan, chosen, matrix)

    if settings.smote and found.problem == "classification" and profile.imbalanced:
        matrix = steps.run("resample", lambda: materialise(oversample(matrix, plan.outputs, "label", seed=settings.seed)))
    stratify = "label" if found.problem == "classification" else None
    folded = materialise(assign_folds(matrix, k=5, stratify=stratify, salt=f"cv{settings.seed}"))
    if settings.rfe:
        chosen.kept, _ = steps.run("eliminate", lambda: _eliminate(folded, chosen, found, settings, rounds))
    if check and len(chosen.original) > len(chosen.kept):
        steps.run("check_selection", lambda: _check(folded, chosen, found, settings))
    study: Study = steps.run(
        "search",
        lambda: search(
            folded, chosen.kept, found.problem, found.classes, settings, size_class=profile.size_class,
            imbalanced=profile.imbalanced,
        ),
    )
    fitted = FittedModel(plan, chosen.kept, study.model, "supervised", {"problem": found.problem})
    scored = fitted.predict(parts[1], [target])
    scored = materialise(
        scored.withColumn("label", _truth(plan, target)).drop("features", *[c for c in scored.columns if c.startswith("__rff")])
    )
    evaluate = _evaluate_classes if found.problem == "classification" else _evaluate_values
    numbers, tables = steps.run("evaluate", lambda: evaluate(scored, plan, chosen, profile))
    if settings.shap:
        tables["importance"] = steps.run("attribute", lambda: importance(study, scored, chosen.kept, found))
    tables["trials"] = study.trials
    return _result(spark, steps, profile, found, chosen, fitted, study, None, numbers, tables, study.model_name, study.n_trials)


def _truth(plan, target):
    # Scores are compared on the scale of the data, also when the model learned logs.
    return quoted(target).cast("double") if plan.log_target else plan.label()


def _split(table: DataFrame, found: Detection, settings: Settings) -> tuple[DataFrame, DataFrame | None]:
    if found.problem == "clustering":
        return table, None
    stratify = settings.target if found.problem == "classification" else None
    salt = f"split{settings.seed}"
    share = settings.thresholds.test_share
    if stratify and table.groupBy(quoted(stratify)).count().where("count < 2").limit(1).count():
        stratify = None
    return split_stored(table, settings.id_cols, stratify=stratify, share=share, salt=salt)


def _thirds(folded: DataFrame, found: Detection, settings: Settings) -> DataFrame:
    """The training matrix in three equal folds."""
    stratify = "label" if found.problem == "classification" else None
    return materialise(assign_folds(folded.drop("fold"), k=3, stratify=stratify, salt=f"check{settings.seed}"))


def _check(folded: DataFrame, chosen: Selection, found: Detection, settings: Settings) -> None:
    """Cross-validate the probe on all and on kept features; a drop becomes a note."""
    three = _thirds(folded, found, settings)
    scores = [_probe_score(three, cols, found, settings, 3) for cols in (chosen.original, chosen.kept)]
    if found.problem == "regression":
        scores = [-s for s in scores]
    warning = check_selection(scores[0], scores[1], found.problem)
    chosen.notes.append(("validation", warning or f"stable: {scores[0]:.4f} -> {scores[1]:.4f}"))


def _probe_score(folded: DataFrame, cols: list[str], found: Detection, settings: Settings, folds: int) -> float:
    facts = Facts(found.problem, 0, found.classes, 1.0, False, settings.seed)
    model = "random_forest" if found.classes > 2 else "lightgbm"
    params = {"n": 30.0 if settings.max_iter is None else min(30.0, float(settings.max_iter)), "lr": 0.1, "leaves": 31.0, "min_child": 20.0, "depth": 5.0, "min": 2.0}
    data = for_passes(folded.select(*[quoted(c) for c in cols], "label", "fold"), folded.count()).cache()
    scores = cross_validate(data, build(model, params, cols, facts), found.problem, folds)
    data.unpersist()
    return sum(scores) / len(scores)


def _eliminate(folded, chosen: Selection, found: Detection, settings: Settings, rounds: int):
    three = _thirds(folded, found, settings)
    return eliminate(
        folded, chosen.kept, found.problem, found.classes,
        lambda cols: _probe_score(three, cols, found, settings, 3), seed=settings.seed, trees=rounds,
    )


def _evaluate_classes(scored: DataFrame, plan, chosen: Selection, profile: Audit):
    labels = plan.labels
    names = F.array(*[F.lit(x) for x in labels])
    known = scored.where(F.col("label").isNotNull())
    named = known.select(
        F.element_at(names, F.col("label").cast("int") + 1).alias("label"),
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("prediction"),
    )
    matrix = materialise(metrics.cells(named))
    report = metrics.class_report(matrix)
    row = metrics.averages(report).first().asDict()
    numbers: dict[str, float | None] = {k: float(v) for k, v in row.items()}
    per = "probability" if "probability" in scored.columns else "rawPrediction" if "rawPrediction" in scored.columns else None
    if per is not None:
        shares = known.select("label", vector_to_array(per).alias("p"))
        wide = shares.select("label", *[F.col("p")[i].alias(f"p{i}") for i in range(len(labels))])
        if len(labels) == 2:
            numbers["roc_auc"] = metrics.roc_auc(wide.withColumn("pos", F.col("label") == 1), "pos", "p1").first()["roc_auc"]
        else:
            each = metrics.roc_auc_per_class(wide, "label", {float(i): f"p{i}" for i in range(len(labels))})
            numbers["roc_auc"] = metrics.weighted_auc(each).first()["roc_auc_weighted"]
    return numbers, {
        "confusion": metrics.grid(matrix), "class_report": report,
        "insights": metrics.confusion_insights(matrix, profile.imbalanced),
    }


def _evaluate_values(scored: DataFrame, plan, chosen: Selection, profile: Audit):
    fitted = F.expm1("prediction") if plan.log_target else F.col("prediction")
    known = scored.where(F.col("label").isNotNull()).select("label", fitted.alias("prediction"))
    numbers = metrics.regression_scores(known, "label", "prediction", len(chosen.kept)).first().asDict()
    spread = metrics.heteroscedasticity(known, "label", "prediction").first()
    numbers["heteroscedastic"] = float(bool(spread and spread["heteroscedastic"]))
    return numbers, {"residuals": metrics.residuals(known, "label", "prediction")}


def importance(study: Study, scored: DataFrame, cols: list[str], found: Detection) -> DataFrame:
    """Mean absolute attribution per feature, by the method that fits the model."""
    last = study.model.stages[-1]
    if study.model_name in TREES:
        models = last.models if isinstance(last, OneVsRestModel) else [last]
        parts = [attribution.tree_importance(m, scored, cols) for m in models]
        return metrics.ranking(union_all(parts).groupBy("feature").agg(F.avg("importance").alias("importance")))
    if study.model_name == "ridge":
        weights = [list(last.coefficients)]
    elif study.model_name == "logistic_regression":
        rows = last.coefficientMatrix.toArray().tolist()
        weights = rows
    else:
        return metrics.ranking(_kernel_importance(study.model, scored, cols, found))
    parts = [attribution.mean_absolute(attribution.linear(scored, cols, w), cols) for w in weights]
    return metrics.ranking(union_all(parts).groupBy("feature").agg(F.avg("importance").alias("importance")))


def _kernel_importance(model: PipelineModel, scored: DataFrame, cols: list[str], found: Detection) -> DataFrame:
    keyed = scored.select(*[quoted(c) for c in cols]).withColumn("__key", F.monotonically_increasing_id())

    def score(table: DataFrame) -> DataFrame:
        out = model.transform(table)
        if found.problem == "regression" or "rawPrediction" not in out.columns:
            return out.withColumn("score", F.col("prediction"))
        margins = vector_to_array("rawPrediction")
        return out.withColumn("score", margins[1] if found.classes == 2 else margins)

    # The key is generated, so fix it before two samples are drawn from the table.
    return attribution.sampled_importance(attribution.sampled(score, materialise(keyed), cols, "__key"))


def _finish_clustering(spark, steps, settings, profile, found, plan, chosen, matrix) -> Result:
    cols = chosen.kept
    data = matrix.select(*[quoted(c) for c in cols])
    won: cluster.Clustering = steps.run("search", lambda: cluster.discover(data, cols, k=settings.k, seed=settings.seed))

    def evaluate():
        labelled = materialise(won.labelled)
        count = cluster_metrics.cluster_count(labelled).first()
        numbers = {
            "clusters": float(count["clusters"]), "noise": float(count["noise"]), "silhouette": cluster_metrics.silhouette(labelled, cols).first()["silhouette"],
            "silhouette_squared": won.silhouette,
            "davies_bouldin": cluster_metrics.davies_bouldin(labelled, cols).first()["davies_bouldin"] if count["clusters"] > 1 else None,
        }
        points, shown = cluster_metrics.pca_points(labelled, cols, ["cluster"])
        numbers["pca_share"] = shown
        notes = [("segments", f"{count['clusters']} clusters")]
        if shown < 0.5:
            notes.append(("projection", f"two dimensions show only {shown * 100:.1f}% of the variance"))
        return numbers, {
            "cluster_profiles": cluster_metrics.profiles(labelled, cols), "points": points, "labelled": labelled,
            "curve": cluster.elbow(won.curve), "candidates": won.candidates,
            "insights": spark.createDataFrame(notes, "finding string, detail string"),
        }

    numbers, tables = steps.run("evaluate", evaluate)
    fitted = FittedModel(plan, cols, won.model, won.kind, {"problem": "clustering"})
    return _result(spark, steps, profile, found, chosen, fitted, None, won, numbers, tables, won.name, None)


def _result(spark, steps, profile, found, chosen, fitted, study, clustering, numbers, tables, name, trials) -> Result:
    tables["limitations"] = limitations(
        spark, rows=profile.rows, problem=found.problem, imbalance_ratio=profile.imbalance_ratio,
        high_cardinality=len(profile.high_cardinality), datetimes=len(profile.of_type("datetime")), model=name,
        dropped=len(chosen.original) - len(chosen.kept), trials=trials,
    )
    fitted.meta.update(
        model_name=name, trained_at=timestamp(), metrics={k: v for k, v in numbers.items()},
        limitations=[r["detail"] for r in tables["limitations"].collect()],
    )
    return Result(profile, found, chosen, fitted, study, clustering, numbers, tables, steps.log)
