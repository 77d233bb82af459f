"""Synthetic tables, each with one property the steps have to notice."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.operators import cluster, select
from plumbline.operators.detect import detect
from plumbline.operators.findings import run_audit
from plumbline.operators.prepare import Prepared
from plumbline.operators.select import NothingLeft, select_features
from plumbline.plans.report import report, write_report
from plumbline.plans.train import StepFailed, train
from plumbline.sources.artifacts import FittedModel

N = 600


def features(n=N, d=4, seed=42):
    return pd.DataFrame(np.random.default_rng(seed).normal(0, 1, (n, d)), columns=[f"f{i}" for i in range(d)])


def classes(k=2, share=None, n=N, d=4):
    x = features(n, d)
    z = x.f0 + 0.7 * x.f1
    if k == 2:
        x["target"] = (z > np.quantile(z, 1 - (share or 0.5))).astype("int64")
    else:
        x["target"] = pd.qcut(z, k, labels=False).astype("int64")
    return x


def facts(spark, pdf, target="target", **k):
    df = spark.createDataFrame(pdf)
    return df, run_audit(df, target, **k), detect(df, target)


def chosen(df, a, d, cols=None, trees=5):
    base = df.withColumn("label", F.col("target").cast("double"))
    cols = cols or [c for c in df.columns if c != "target"]
    return select_features(base, cols, d.problem, d.classes, leaks=list(a.leakage), constants=a.quasi_constant, pairs=a.pairs, trees=trees)


def test_binary(spark):
    _, a, d = facts(spark, classes(share=0.16))
    assert (d.problem, d.subtype, a.imbalance_severity, a.size_class) == ("classification", "binary", "balanced", "small")


def test_multiclass_and_many_classes(spark):
    _, _, d = facts(spark, classes(4))
    assert (d.problem, d.subtype, d.classes) == ("classification", "multiclass", 4)
    _, _, d = facts(spark, classes(20))
    assert (d.problem, d.subtype, d.method) == ("classification", "many_class", "caller_choice")


def test_severe_imbalance(spark):
    _, a, _ = facts(spark, classes(share=0.03))
    assert a.imbalance_severity == "severe" and a.imbalanced


def test_very_small_and_large(spark):
    _, a, _ = facts(spark, classes(n=250))
    assert a.size_class == "very_small"
    big = spark.range(100_000).select((F.col("id") % 7).cast("double").alias("f"), (F.col("id") % 2).alias("target"))
    assert run_audit(big, "target").size_class == "large"


def given(spark, name, *columns):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").selectExpr(*columns)


def test_price_and_price_with_tax_are_not_both_kept(spark):
    lines = given(spark, "lineitem", "CAST(l_extendedprice AS DOUBLE) AS price", "CAST(l_extendedprice * (1 + l_tax) AS DOUBLE) AS gross", "CAST(l_discount * 100 AS DOUBLE) AS discount", "CAST(l_extendedprice > 30000 AS BIGINT) AS target")
    a, d = run_audit(lines, "target"), detect(lines, "target")
    assert [(p[0], p[1]) for p in a.pairs] == [("gross", "price")]
    assert len({"gross", "price"} & set(chosen(lines, a, d).kept)) == 1


def test_constant_column(spark):
    x = classes()
    x["constant"] = 1
    df, a, d = facts(spark, x)
    assert a.drops == {"constant": "quasi_constant"}
    assert "constant" in chosen(df, a, d).dropped["quasi_constant"]


def test_weak_features(spark):
    x = classes()
    x["target"] = (x.f0 > 0).astype("int64")
    df, a, d = facts(spark, x)
    s = chosen(df, a, d, trees=3)
    assert s.importance["f0"][0] > 20 * max(s.importance[c][0] for c in ("f1", "f2", "f3"))


def test_a_monotone_function_of_the_target_leaks(spark):
    lines = given(spark, "lineitem", "CAST(l_discount * 100 AS DOUBLE) AS discount", "CAST(l_tax * 100 AS DOUBLE) AS tax", "sqrt(CAST(l_extendedprice AS DOUBLE)) AS root", "CAST(l_extendedprice AS DOUBLE) AS target")
    a, d = run_audit(lines, "target"), detect(lines, "target")
    assert a.drops == {"root": "leakage"} and d.problem == "regression"
    assert "root" in chosen(lines, a, d).dropped["leakage"]


def test_nothing_is_left_of_flat_columns(spark):
    parts = given(spark, "part", "p_size * 0 AS flat", "p_partkey % 7 * 1e-4D AS tiny", "CAST(p_size > 25 AS BIGINT) AS target")
    a, d = run_audit(parts, "target"), detect(parts, "target")
    with pytest.raises(NothingLeft, match="100% of features"):
        chosen(parts, a, d)


def test_no_probe_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(select, "probe", lambda *a: 1 / 0)
    df, a, d = facts(spark, classes())
    with pytest.warns(UserWarning, match="division by zero"), pytest.raises(RuntimeError, match="no probe could be fitted"):
        chosen(df, a, d)


def test_trial_log_and_report_tell_what_was_done(spark):
    x = classes(n=300).rename(columns={"f0": "prediction", "f1": "cluster"})
    df = spark.createDataFrame(pd.concat([x, x.iloc[:30]]))
    run = train(df, Settings(target="target", max_trials=1, max_iter=7, models=["random_forest"], shap=False), check=False)
    assert run.study.trials.first()["params"]["n"] == run.study.model.stages[-1].getNumTrees == 7
    assert report(run, spark)["summary"].where("item = 'duplicates'").first()["value"] == "30"


def test_single_feature_needs_no_importance(spark):
    df, a, d = facts(spark, classes()[["f0", "target"]])
    s = chosen(df, a, d)
    assert s.kept == ["f0"] and s.importance == {}


def test_missing_target_is_named(spark):
    with pytest.raises(StepFailed, match="'price' is not in the table"):
        train(spark.createDataFrame(features()), Settings(target="price"))


def test_user_drop_leaves_the_candidates(spark):
    x = classes()
    x["constant"] = 1
    _, a, _ = facts(spark, x, drop=["constant"])
    assert a.drops == {}


@pytest.fixture(scope="module")
def classifier(spark):
    x = classes(share=0.08, n=700)
    x["city"] = np.where(x.f1 > 0, "oslo", np.where(x.f2 > 0, "rome", "odd"))
    x["many"] = [f"m{i % 30}" for i in range(len(x))]
    x["when"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(x)) % 400, unit="D")
    x["text_number"] = np.where(np.arange(len(x)) % 40 == 0, "n/a", x.f3.round(3).astype(str))
    x.loc[::13, "f0"] = np.nan
    x["target"] = np.where(x.target == 1, "yes", "no")
    x["id"] = np.arange(len(x))
    df = spark.createDataFrame(pd.concat([x, x.head(5)]))
    run = train(df, Settings(target="target", id_cols=["id"], max_trials=1, max_iter=3, models=["logistic_regression"]))
    return df, run


def test_classification_run(spark, classifier, tmp_path):
    df, run = classifier
    assert run.detection.problem == "classification" and run.audit.imbalance_severity == "moderate"
    assert run.metrics["roc_auc"] > 0.8 and run.metrics["rows"] == 140
    steps = [s for s, *_ in run.log]
    assert steps[:5] == ["load", "detect", "split", "audit", "prepare"] and "resample" in steps
    tables = report(run, spark)
    assert {"metrics", "confusion", "trials", "limitations", "importance", "run_log", "model_card"} <= set(tables)
    assert set(write_report(run, spark, str(tmp_path / "report"))) == set(tables)


def test_scoring_contract(spark, classifier, tmp_path):
    df, run = classifier
    path = run.model.save(str(tmp_path / "model"), spark)
    model = FittedModel.load(path, spark)
    rows = df.select("id", *model.expected)
    assert "f0" in model.expected and "city" in model.expected
    out = model.score(rows, ["id"])
    assert out.count() == 705 and set(out.columns) == {"id", "prediction", "probability", "class_labels"}
    assert out.first()["class_labels"] == ["no", "yes"]
    assert model.score(rows.limit(0), ["id"]).count() == 0
    many = rows.unionByName(rows)
    assert model.score(many, ["id"]).count() == 1410
    with pytest.raises(ValueError, match="missing columns \\['f1'\\]"):
        model.score(rows.drop("f1"), ["id"])
    with pytest.raises(ValueError, match="unexpected columns \\['extra'\\]"):
        model.score(rows.withColumn("extra", F.lit(1)), ["id"])
    texts = rows.select("id", *[F.when(F.col("id") == 3, "bad").otherwise(F.col(c).cast("string")).alias(c) if c == "f1" else F.col(c) for c in model.expected])
    good, rejects = model.score_with_rejects(texts, ["id"])
    assert {r["id"] for r in rejects.collect()} == {3} and good.where("id = 3").isEmpty()
    unseen = rows.where("id = 10").withColumn("city", F.lit("paris")).withColumn("many", F.lit(None).cast("string"))
    assert 0 <= model.score(unseen, ["id"]).first()["probability"] <= 1
    assert model.card(spark).first()["model_name"] == "logistic_regression"


def test_skewed_target_is_scored_on_its_own_scale(spark):
    x = features(500)
    x["target"] = np.exp(1.0 + 0.8 * x.f0 + 0.7 * x.f1)
    run = train(spark.createDataFrame(x), Settings(target="target", max_trials=1, max_iter=3, models=["ridge"]))
    assert run.detection.log_target and run.model.prepared.log_target
    assert run.metrics["r2"] > 0.8
    out = run.model.score(spark.createDataFrame(x[["f0", "f1", "f2", "f3"]]))
    assert out.agg(F.min("prediction")).first()[0] > -1


def test_heteroscedastic_target(spark):
    rng = np.random.default_rng(3)
    x = features(900)
    x["f0"] = x.f0.abs()
    x["target"] = 3 * x.f0 + 2 * x.f0 * rng.normal(0, 1, 900)
    run = train(spark.createDataFrame(x), Settings(target="target", problem="regression", max_trials=1, models=["ridge"], max_iter=3))
    assert run.metrics["heteroscedastic"] == 1.0


def test_clustering_run(spark, tmp_path):
    rng = np.random.default_rng(9)
    pts = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in [(0, 0), (5, 5), (0, 6), (6, 0)]])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(240), "a": pts[:, 0], "b": pts[:, 1]}))
    run = train(df, Settings(id_cols=["id"]))
    assert run.detection.problem == "clustering" and run.metrics["clusters"] == 4
    assert run.metrics["silhouette"] > 0.8
    assert {"cluster_profiles", "points", "curve", "candidates"} <= set(run.tables)
    if run.model.kind != "density":
        model = FittedModel.load(run.model.save(str(tmp_path / "m"), spark), spark)
        assert model.score(df, ["id"]).groupBy("cluster").count().count() == 4
    run.model.kind = "density"
    with pytest.raises(ValueError, match="cannot label new rows"):
        run.model.score(df, ["id"])


def test_a_k_means_model_is_saved_with_its_centres(spark, tmp_path):
    rng = np.random.default_rng(9)
    pts = np.concatenate([rng.normal(c, 0.4, (60, 2)) for c in [(0, 0), (5, 5), (0, 6), (6, 0)]])
    df = spark.createDataFrame(pd.DataFrame({"a": pts[:, 0], "b": pts[:, 1]}))
    plan = Prepared([("a", "double"), ("b", "double")], {"a": "a", "b": "b"}, {"a": "a", "b": "b"})
    fit = cluster.fit_kmeans(df, ["a", "b"], 4)
    fitted = FittedModel(plan, ["a", "b"], fit, "kmeans", {"problem": "clustering"})
    want = {(r["a"], r["cluster"]) for r in fit.transform(df).collect()}
    model = FittedModel.load(fitted.save(str(tmp_path / "m"), spark), spark)
    assert {(r["a"], r["cluster"]) for r in model.predict(df).collect()} == want
