"""Random search over models and settings, cross-validated, pruned and timed."""

from __future__ import annotations

import math
import random
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from itertools import count, takewhile
from statistics import median
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.functions.columns import for_passes, quoted, sql_name

# Name, low, high and scale of every setting.
SPACES: dict[str, list[tuple[str, float, float, str]]] = {
    "lightgbm": [("lr", 1e-3, 0.1, "log"), ("n", 50, 500, "int"), ("leaves", 20, 100, "int"), ("min_child", 10, 50, "int")],
    "xgboost": [("lr", 1e-3, 0.1, "log"), ("depth", 3, 9, "int"), ("n", 50, 500, "int"), ("sub", 0.5, 1.0, "real"), ("col", 0.5, 1.0, "real")],
    "random_forest": [("n", 50, 300, "int"), ("depth", 3, 15, "int"), ("min", 2, 10, "int")],
    "logistic_regression": [("c", 1e-4, 10.0, "log")],
    "ridge": [("alpha", 1e-3, 10.0, "log")],
    "svc": [("c", 1e-3, 10.0, "log")],
    "svr": [("c", 1e-3, 10.0, "log")],
}
# Narrower upper bounds for very small tables.
NARROW = {("lightgbm", "n"): 200, ("lightgbm", "leaves"): 31, ("xgboost", "n"): 200, ("xgboost", "depth"): 4}
KERNEL = ("svc", "svr")
LINEAR = ("logistic_regression", "ridge")
FOURIER = 64
STARTUP_TRIALS = 5


def model_pool(problem: str) -> list[str]:
    pool = ["lightgbm", "xgboost", "random_forest"]
    pool += ["logistic_regression"] if problem == "classification" else ["ridge"]
    return pool + (["svc"] if problem == "classification" else ["svr"])


def space(model: str, size_class: str = "medium") -> list[tuple[str, float, float, str]]:
    narrow = size_class == "very_small"
    return [(n, lo, NARROW.get((model, n), hi) if narrow else hi, s) for n, lo, hi, s in SPACES[model]]


def draw(model: str, rng: random.Random, size_class: str = "medium", max_iter: int | None = None) -> dict[str, float]:
    """Settings as they will be fitted; ``max_iter`` bounds the rounds or trees, ``n``."""
    out: dict[str, float] = {}
    for name, lo, hi, scale in space(model, size_class):
        if scale == "log":
            out[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
        elif scale == "int":
            out[name] = float(rng.randint(int(lo), int(hi)))
        else:
            out[name] = rng.uniform(lo, hi)
    if max_iter is not None and "n" in out:
        out["n"] = min(out["n"], float(max_iter))
    return out


def class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): the smaller of two classes weighs majority / minority."""
    counts = df.groupBy(quoted(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n")).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", F.when(classes == 2, top / F.col("n")).otherwise(F.lit(1.0)))


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    w = F.lit(1.0)
    for r in class_weight(df, label).collect():
        w = F.when(quoted(label) == F.lit(r["label"]), F.lit(float(r["weight"]))).otherwise(w)
    return df.withColumn("weight", w)


def _fourier(cols: Sequence[str], seed: int) -> tuple[SQLTransformer, list[str]]:
    """Random Fourier features of the RBF kernel with gamma = 1 / number of columns."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 / len(cols)), (FOURIER, len(cols)))
    b = rng.uniform(0, 2 * math.pi, FOURIER)
    names = [f"__rff{i}" for i in range(FOURIER)]
    scale = math.sqrt(2.0 / FOURIER)
    exprs = [
        f"{scale!r}D * cos({b[i]:.12f}D + " + " + ".join(f"({w[i, j]:.12f}D) * {sql_name(c)}" for j, c in enumerate(cols)) + f") AS {n}"
        for i, n in enumerate(names)
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__"), names


@dataclass
class Facts:
    """What a model factory needs to know about the training table."""

    problem: str
    rows: int
    classes: int
    label_std: float
    weighted: bool
    seed: int


def build(model: str, params: dict[str, float], cols: Sequence[str], facts: Facts) -> Pipeline:
    """An unfitted pipeline from prepared columns to predictions."""
    stages: list[Any] = []
    used = list(cols)
    if model in KERNEL:
        stage, used = _fourier(cols, facts.seed)
        stages.append(stage)
    stages.append(VectorAssembler(inputCols=used, outputCol="features"))
    stages.append(FACTORIES[model](params, facts))
    return Pipeline(stages=stages)


def _common(facts: Facts) -> dict[str, Any]:
    return {"featuresCol": "features", "labelCol": "label", **({"weightCol": "weight"} if facts.weighted else {})}


def _boosted(params, facts: Facts, depth: int, extra: dict[str, Any]):
    args = {
        **_common(facts), "maxIter": int(params["n"]), "stepSize": params["lr"],
        "maxDepth": depth, "seed": facts.seed, **extra,
    }
    if facts.problem == "regression":
        return GBTRegressor(**args)
    if facts.classes == 2:
        return GBTClassifier(**args)
    args.pop("weightCol", None)
    return OneVsRest(classifier=GBTClassifier(**args), featuresCol="features", labelCol="label")


def _lightgbm(p, facts):
    return _boosted(p, facts, max(1, math.ceil(math.log2(p["leaves"]))), {"minInstancesPerNode": int(p["min_child"])})


def _xgboost(p, facts):
    return _boosted(
        p, facts, int(p["depth"]), {"subsamplingRate": p["sub"], "featureSubsetStrategy": str(round(min(p["col"], 0.9999), 4))}
    )


def _forest(p, facts):
    kind = RandomForestRegressor if facts.problem == "regression" else RandomForestClassifier
    return kind(
        **_common(facts), numTrees=int(p["n"]), maxDepth=int(p["depth"]),
        minInstancesPerNode=max(1, int(p["min"]) // 2), seed=facts.seed,
    )


def _logistic(p, facts):
    return LogisticRegression(
        **_common(facts), regParam=1.0 / (p["c"] * facts.rows), elasticNetParam=0.0, standardization=False, maxIter=1000,
    )


def _ridge(p, facts):
    # Spark divides the penalty by the label's deviation, so it is multiplied back.
    return LinearRegression(
        featuresCol="features", labelCol="label", regParam=p["alpha"] / facts.rows * facts.label_std,
        elasticNetParam=0.0, standardization=False, solver="normal",
    )


def _svc(p, facts):
    base = LinearSVC(**_common(facts), regParam=1.0 / (p["c"] * facts.rows), maxIter=100)
    if facts.classes == 2:
        return base
    base = LinearSVC(featuresCol="features", labelCol="label", regParam=1.0 / (p["c"] * facts.rows), maxIter=100)
    return OneVsRest(classifier=base, featuresCol="features", labelCol="label")


def _svr(p, facts):
    return LinearRegression(
        featuresCol="features", labelCol="label", loss="huber", regParam=1.0 / (p["c"] * facts.rows),
        elasticNetParam=0.0, maxIter=100,
    )


# The extension point: one entry adds a model.
FACTORIES: dict[str, Callable[[dict[str, float], Facts], Any]] = {
    "lightgbm": _lightgbm, "xgboost": _xgboost, "random_forest": _forest, "logistic_regression": _logistic,
    "ridge": _ridge, "svc": _svc, "svr": _svr,
}


def fold_score(predicted: DataFrame, problem: str) -> float:
    """Weighted F1, or RMSE with the sign turned so that larger is better."""
    if problem == "classification":
        return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1").evaluate(predicted)
    return -RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="rmse").evaluate(predicted)


class Jobs:
    """Functions that run Spark jobs side by side in threads, each under a tag by which its jobs are cancelled.

    With ``spark.scheduler.mode`` FAIR, every tag is a pool of its own. A cancelled function may be between two jobs, so
    its tag is cancelled again at every look until the function has ended.
    """

    LOOK_S = 0.2

    def __init__(self, spark: SparkSession, workers: int):
        self.spark, self.context = spark, spark.sparkContext
        self.threads = ThreadPoolExecutor(workers)
        self.waiting: dict[Future, tuple[str, Any]] = {}
        self.cancelled: set[str] = set()

    def submit(self, tag: str, what: Any, fn: Callable[[], Any]) -> None:
        def run():
            self.context.addJobTag(tag)
            self.context.setLocalProperty("spark.scheduler.pool", tag)
            try:
                return None if tag in self.cancelled else fn()
            finally:
                self.context.removeJobTag(tag)
                self.context.setLocalProperty("spark.scheduler.pool", None)

        self.waiting[self.threads.submit(inheritable_thread_target(run))] = tag, what

    def cancel(self, tag: str) -> None:
        self.cancelled.add(tag)
        if any(t == tag for t, _ in self.waiting.values()):
            self.context.cancelJobsWithTag(tag)

    def ended(self) -> list[tuple[Any, Any, Exception | None]]:
        """(what, result, error) of what ended since, after at most one look; cancelled work is left out."""
        done, _ = wait(self.waiting, timeout=self.LOOK_S, return_when=FIRST_COMPLETED)
        for tag in {t for f, (t, _) in self.waiting.items() if f not in done and t in self.cancelled}:
            self.context.cancelJobsWithTag(tag)
        out = []
        for future in done:
            tag, what = self.waiting.pop(future)
            if tag not in self.cancelled:
                error = future.exception()
                out.append((what, None if error else future.result(), error))
        return out

    def __enter__(self) -> Jobs:
        return self

    def __exit__(self, *_) -> None:
        for tag in {t for t, _ in self.waiting.values()}:
            self.cancel(tag)
        while self.waiting:
            self.ended()
        self.threads.shutdown()


def _fold(data: DataFrame, pipeline: Pipeline, problem: str, i: int) -> float:
    model = pipeline.fit(data.where(F.col("fold") != i))
    return float(fold_score(model.transform(data.where(F.col("fold") == i)), problem))


def _leading(scores: dict[int, float]) -> list[float]:
    """Scores of the folds from the first on, up to one that has not ended."""
    return [scores[i] for i in takewhile(scores.__contains__, count())]


def cross_validate(
    data: DataFrame, pipeline: Pipeline, problem: str, folds: int, stop: Callable[[list[float]], bool] = lambda s: False
) -> list[float]:
    """Score per fold of a table with a ``fold`` column, the folds side by side.

    ``stop`` sees the scores in the order of the folds and may end them early, as though one came after the other.
    """
    scores: dict[int, float] = {}
    seen, tag = 0, f"folds-{uuid.uuid4().hex}"
    with Jobs(data.sparkSession, folds) as jobs:
        for i in range(folds):
            jobs.submit(tag, i, lambda i=i: _fold(data, pipeline.copy(), problem, i))
        while jobs.waiting:
            for i, score, error in jobs.ended():
                if error is not None:
                    raise error
                scores[i] = score
            while seen < len(_leading(scores)):
                seen += 1
                if stop(_leading(scores)[:seen]):
                    return _leading(scores)[:seen]
    return _leading(scores)


def running(scores: Sequence[float]) -> list[float]:
    return [sum(scores[: i + 1]) / (i + 1) for i in range(len(scores))]


def behind(scores: Sequence[float], completed: Sequence[Sequence[float]], startup: int = STARTUP_TRIALS) -> bool:
    """Is the best running mean so far below the median of completed trials at this fold?"""
    if len(completed) < startup:
        return False
    at = len(scores) - 1
    peers = [running(c)[at] for c in completed if len(c) > at]
    return bool(peers) and max(running(scores)) < median(peers)


def pruned_at(completed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(trial, fold): the first fold at which each candidate falls behind.

    Both tables are logs of trials, (trial, fold, score) with one row per fold of a trial.
    """
    def logged(df: DataFrame) -> dict[Any, list[tuple[Any, float]]]:
        rows = df.groupBy("trial").agg(F.sort_array(F.collect_list(F.struct("fold", "score"))).alias("folds")).collect()
        return {r["trial"]: [tuple(f) for f in r["folds"]] for r in rows}

    done = [[score for _, score in folds] for folds in logged(completed).values()]
    found = []
    for trial, folds in logged(candidates).items():
        scores = [score for _, score in folds]
        cut = next((i for i in range(len(scores)) if behind(scores[: i + 1], done)), None)
        if cut is not None:
            found.append((trial, folds[cut][0]))
    return candidates.sparkSession.createDataFrame(found, candidates.select("trial", "fold").schema)


TRIALS = (
    "trial int, model string, params map<string,double>, fold_scores array<double>, score double, "
    "state string, seconds double, best boolean"
)


@dataclass
class Study:
    model_name: str
    params: dict[str, float]
    score: float
    model: PipelineModel
    trials: DataFrame
    n_trials: int


@dataclass
class Trial:
    """A trial under way: its scores by fold, and how it ended."""

    number: int
    model: str
    params: dict[str, float]
    tag: str
    began: float | None = None
    scores: dict[int, float] = field(default_factory=dict)
    seen: int = 0
    state: str | None = None
    seconds: float = 0.0
    fitted: PipelineModel | None = None

    @property
    def score(self) -> float | None:
        return sum(self.scores.values()) / len(self.scores) if self.scores else None

    def row(self, best: bool) -> tuple:
        folds = [self.scores.get(i) for i in range(max(self.scores, default=-1) + 1)]
        return self.number, self.model, self.params, folds, None if self.state.startswith("failed") else self.score, self.state, self.seconds, best


ALL_ROWS = -1


def search(
    train: DataFrame, cols: Sequence[str], problem: str, classes: int, settings: Settings, *,
    size_class: str = "medium", imbalanced: bool = False, folds: int = 5,
) -> Study:
    """Try random settings until the time or trial budget is spent; the best is fitted on all rows.

    ``train`` has the feature columns, ``label`` and ``fold``. It is cached for the search.

    ``settings.trials_at_once`` trials run side by side, and all folds of each. A trial whose folds beat all trials fitted so far
    is fitted on all rows right away, and is complete when that is done, so nothing is left to fit
    when the budget ends. Trials end as ``complete``, ``pruned``, ``failed: why`` or ``timed_out``: the jobs of those that
    run when the budget ends are cancelled, and the log keeps the folds that had ended (null: had not). The first trials are
    drawn together, and a linear one among them runs before the others, by itself for up to half the budget, so that a trial is
    complete early. Where
    no trial is complete when the budget ends, a linear one that was drawn goes on; else one more of a linear model is run to its end, or,
    without one in the pool or with ``settings.max_trials`` drawn, the trial that is furthest goes on. With that bound, the log
    also lists drawn trials that the budget left no time for. Settings are drawn in the order of the trials; which trials a
    trial is pruned against hangs on which had ended.
    """
    start = time.monotonic()
    spark = train.sparkSession
    weighted = imbalanced and problem == "classification" and classes == 2
    data = with_weights(train) if weighted else train
    data = data.select(*[quoted(c) for c in cols], "label", "fold", *(["weight"] if weighted else []))
    rows, spread = data.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    facts = Facts(problem, rows, classes, spread or 1.0, weighted, settings.seed)
    pool = settings.models or model_pool(problem)
    unknown = [m for m in pool if m not in FACTORIES]
    if unknown:
        raise ValueError(f"unknown models {unknown}; known are {sorted(FACTORIES)}")
    data = for_passes(data, rows).cache()
    data.count()
    rng = random.Random(settings.seed)
    name = f"search-{uuid.uuid4().hex[:8]}"
    trials: list[Trial] = []
    finished: list[list[float]] = []
    best: Trial | None = None
    deadline, expired = start + settings.time_budget, False

    def end(trial: Trial, state: str) -> None:
        trial.state, trial.seconds = state, 0.0 if trial.began is None else time.monotonic() - trial.began
        jobs.cancel(trial.tag)

    def plan(model: str) -> Trial:
        trials.append(Trial(len(trials), model, draw(model, rng, size_class, settings.max_iter), f"{name}-{len(trials)}"))
        return trials[-1]

    def begin(trial: Trial) -> None:
        trial.began = time.monotonic()
        try:
            pipelines = [build(trial.model, trial.params, cols, facts) for _ in range(folds)]
        except Exception as e:  # noqa: BLE001 - one failing trial must not end the search
            return end(trial, f"failed: {type(e).__name__}: {str(e)[:300]}")
        for i, pipeline in enumerate(pipelines):
            jobs.submit(trial.tag, (trial, i), lambda i=i, p=pipeline: _fold(data, p, problem, i))

    def complete(trial: Trial) -> None:
        nonlocal best
        if trial.fitted is not None and (best is None or trial.score > best.score):
            best = trial
        finished.append([trial.scores[i] for i in range(folds)])
        end(trial, "complete")

    def take(trial: Trial, i: int, result: Any, error: Exception | None) -> None:
        if trial.state is not None:
            return
        if error is not None:
            return end(trial, f"failed: {type(error).__name__}: {str(error)[:300]}")
        if i == ALL_ROWS:
            trial.fitted = result
            return complete(trial)
        trial.scores[i] = result
        while trial.seen < min(len(_leading(trial.scores)), folds - 1):
            trial.seen += 1
            if behind(_leading(trial.scores)[: trial.seen], finished):
                trial.scores = dict(enumerate(_leading(trial.scores)[: trial.seen]))
                return end(trial, "pruned")
        if len(trial.scores) == folds:
            if best is not None and trial.score <= best.score:
                return complete(trial)
            jobs.submit(trial.tag, (trial, ALL_ROWS), lambda: build(trial.model, trial.params, cols, facts).fit(data))

    at_once = max(1, settings.trials_at_once)

    def bounded() -> bool:
        return settings.max_trials is not None and len(trials) >= settings.max_trials

    while len(trials) < at_once and not bounded():
        plan(rng.choice(pool))
    first = next((t for t in trials if t.model in LINEAR), None)

    def furthest(options: Sequence[Trial]) -> Trial | None:
        return max(options, key=lambda t: (t.began is not None, len(t.scores), -t.number), default=None)

    with Jobs(spark, at_once * (folds + 1)) as jobs:
        while True:
            left = [t for t in trials if t.state is None]
            running_now = [t for t in left if t.began is not None]
            if time.monotonic() > deadline and not expired:
                expired = True
                quick = [m for m in pool if m in LINEAR]
                # Without a complete trial, one that was drawn goes on alone, or a linear model begins.
                stay = None
                if best is None:
                    stay = furthest([t for t in left if t.model in LINEAR])
                    if stay is None:
                        stay = plan(quick[0]) if quick and not bounded() else furthest(left)
                for t in left:
                    if t is not stay:
                        end(t, "timed_out")
                if stay is not None and stay.began is None:
                    begin(stay)
                continue
            if not expired and len(running_now) < at_once:
                alone = first is not None and first.state is None and time.monotonic() < start + settings.time_budget / 2
                waiting = [t for t in left if t.began is None and (t is first or not alone)]
                if not waiting and not alone and not bounded():
                    waiting = [plan(rng.choice(pool))]
                if waiting:
                    begin(waiting[0])
                    continue
            if not running_now:
                break
            for (trial, i), result, error in jobs.ended():
                take(trial, i, result, error)
    begun = [t for t in trials if t.began is not None]
    data.unpersist()
    if best is None:
        raise RuntimeError(f"the search completed no successful trial; the last one {begun[-1].state}")
    log = spark.createDataFrame([t.row(t is best) for t in (begun if settings.max_trials is None else trials)], TRIALS)
    return Study(best.model, best.params, best.score, best.fitted, log, len(begun))
