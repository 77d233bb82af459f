"""The search beside its clock: concurrent folds, cancelled fits, and what the log says about them."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.operators import search


@pytest.fixture(scope="module")
def folded(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1), i % 5) for i in range(600)]
    return spark.createDataFrame([(a, b, float(a + 0.5 * b + rng.gauss(0, 0.3) > 0), f) for a, b, f in rows], "a double, b double, label double, fold int").cache()


def active(spark):
    tracker = spark.sparkContext.statusTracker()
    return list(tracker.getActiveJobsIds())


def slow(params, facts):
    """500 rounds of depth 6: far more than the seconds given."""
    return search.FACTORIES["lightgbm"]({"n": 500.0, "lr": 0.01, "leaves": 64.0, "min_child": 10.0}, facts)


def test_a_running_fit_is_cancelled_when_the_budget_ends(spark, folded, monkeypatch):
    monkeypatch.setitem(search.FACTORIES, "slow", slow)
    monkeypatch.setitem(search.SPACES, "slow", [])
    start = time.time()
    study = search.search(folded, ["a", "b"], "classification", 2, Settings(time_budget=12, models=["slow", "logistic_regression"], seed=3))
    assert time.time() - start < 22
    log = study.trials.collect()
    cut = [r for r in log if r["state"] == "timed_out"]
    assert {r["model"] for r in cut} >= {"slow"} and all(r["seconds"] < 15 and len(r["fold_scores"]) <= 5 for r in cut)
    done = [r for r in log if r["state"] == "complete"]
    assert study.score == max(r["score"] for r in done) and [r["trial"] for r in log if r["best"]] == [next(r["trial"] for r in done if r["score"] == study.score)]
    assert study.model_name == "logistic_regression" and study.model.transform(folded).count() == 600
    time.sleep(1)
    assert not active(spark)


def test_without_a_complete_trial_a_linear_one_is_run(folded, monkeypatch):
    monkeypatch.setitem(search.FACTORIES, "slow", slow)
    monkeypatch.setitem(search.SPACES, "slow", [])
    monkeypatch.setattr(search.random.Random, "choice", lambda self, pool: "slow")
    study = search.search(folded, ["a", "b"], "classification", 2, Settings(time_budget=2, models=["slow", "logistic_regression"]))
    log = study.trials.orderBy("trial").collect()
    assert [r["state"] for r in log] == ["timed_out"] * 3 + ["complete"] and study.model_name == "logistic_regression"


def test_without_a_linear_model_the_furthest_trial_ends(folded):
    study = search.search(folded, ["a", "b"], "classification", 2, Settings(time_budget=0.01, models=["svc"]))
    assert [r["state"] for r in study.trials.collect()] == ["complete"]


def test_folds_are_pruned_in_their_order(folded, monkeypatch):
    given = iter([0.9, 0.2, 0.8, 0.7, 0.6])
    monkeypatch.setattr(search, "_fold", lambda data, pipeline, problem, i: time.sleep(0.4 * (5 - i) / 5) or [0.9, 0.2, 0.8, 0.7, 0.6][i])
    seen = []
    pipeline = search.build("logistic_regression", {"c": 1.0}, ["a", "b"], search.Facts("classification", 600, 2, 1.0, False, 1))
    assert search.cross_validate(folded, pipeline, "classification", 5, lambda s: seen.append(list(s)) or len(s) == 2) == [0.9, 0.2]
    assert seen == [[0.9], [0.9, 0.2]] and next(given) == 0.9
    assert search.cross_validate(folded, pipeline, "classification", 5) == [0.9, 0.2, 0.8, 0.7, 0.6]


def test_a_trial_behind_the_median_is_pruned(folded, monkeypatch):
    monkeypatch.setattr(search, "_fold", lambda data, pipeline, problem, i: float(pipeline.getStages()[-1].getRegParam() > 1e-2) * 0.5 + 0.1 * i)
    settings = Settings(max_trials=20, trials_at_once=1, models=["logistic_regression"])
    study = search.search(folded, ["a", "b"], "classification", 2, settings)
    log = study.trials.orderBy("trial").collect()
    cut = [r for r in log if r["state"] == "pruned"]
    assert cut and all(len(r["fold_scores"]) < 5 for r in cut) and all(r["trial"] >= search.STARTUP_TRIALS for r in cut)
    assert {r["state"] for r in log} == {"complete", "pruned"} and len(log) == 20
    assert sum(r["best"] for r in log) == 1


def test_same_settings_for_any_number_at_once(folded):
    def drawn(at_once):
        study = search.search(folded, ["a", "b"], "classification", 2, Settings(max_trials=4, trials_at_once=at_once, models=["logistic_regression", "svc"]))
        return [(r["model"], dict(r["params"])) for r in study.trials.orderBy("trial").collect()], study.score

    one, many = drawn(1), drawn(4)
    assert one[0] == many[0] and one[1] == pytest.approx(many[1])


def test_a_failing_fold_ends_its_trial_only(folded, monkeypatch):
    fold = search._fold

    def sometimes(data, pipeline, problem, i):
        if i == 3 and pipeline.getStages()[-1].getRegParam() > 1e-2:
            raise ValueError("no such fold")
        return fold(data, pipeline, problem, i)

    monkeypatch.setattr(search, "_fold", sometimes)
    study = search.search(folded, ["a", "b"], "classification", 2, Settings(max_trials=6, models=["logistic_regression"]))
    states = {r["state"] for r in study.trials.collect()}
    assert "failed: ValueError: no such fold" in states and "complete" in states
    assert study.trials.where(F.col("best")).count() == 1


def test_the_bound_on_trials_holds_when_the_budget_ends(folded, monkeypatch):
    monkeypatch.setitem(search.FACTORIES, "slow", slow)
    monkeypatch.setitem(search.SPACES, "slow", [])
    drawn = iter(["slow", "logistic_regression", "slow"])
    monkeypatch.setattr(search.random.Random, "choice", lambda self, pool: next(drawn))
    study = search.search(folded, ["a", "b"], "classification", 2, Settings(max_trials=3, time_budget=0.01, models=["slow", "logistic_regression"]))
    assert [(r["state"], r["best"]) for r in study.trials.orderBy("trial").collect()] == [("timed_out", False), ("complete", True), ("timed_out", False)]
    assert study.n_trials == 1


def test_a_linear_trial_runs_before_the_others(folded, monkeypatch):
    began, fold = [], search._fold
    monkeypatch.setattr(search, "_fold", lambda data, pipeline, problem, i: began.append(type(pipeline.getStages()[-1]).__name__) or fold(data, pipeline, problem, i))
    models = iter(["random_forest", "logistic_regression", "random_forest"])
    monkeypatch.setattr(search.random.Random, "choice", lambda self, pool: next(models))
    study = search.search(folded, ["a", "b"], "classification", 2, Settings(max_trials=3, max_iter=3, models=["random_forest", "logistic_regression"]))
    assert began == ["LogisticRegression"] * 5 + ["RandomForestClassifier"] * 10
    assert [r["model"] for r in study.trials.orderBy("trial").collect()] == ["random_forest", "logistic_regression", "random_forest"]
