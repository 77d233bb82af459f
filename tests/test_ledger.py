"""Scratch tables: who removes them, and the stored split."""

import os

import pytest

from plumbline.config import Settings
from plumbline.functions.columns import Ledger, scratch, shared_folder, stored
from plumbline.operators.split import split, split_stored
from plumbline.plans.train import StepFailed, train


def held(spark) -> set[str]:
    return set(os.listdir(shared_folder(spark).removeprefix("file:")))


def test_a_ledger_removes_what_was_written_while_it_was_open(spark):
    kept = stored(spark.range(3), "kept")
    before = held(spark)
    with Ledger(spark) as outer:
        stored(spark.range(4), "outer")
        with Ledger(spark) as inner:
            stored(spark.range(5), "inner")
            scratch(spark, "never written")
        assert len(inner.paths) == 2 and len(outer.paths) == 1
        inner.close()
        assert {n.split("-")[0] for n in held(spark) - before} == {"outer"}
    outer.close()
    outer.close()
    assert held(spark) == before and kept.count() == 3
    with pytest.raises(KeyError), Ledger(spark):
        stored(spark.range(6), "failed")
        raise KeyError
    assert held(spark) == before


def test_the_stored_split_is_the_split(spark):
    df = spark.range(900).selectExpr("id", "CAST(id % 3 AS STRING) AS `a b.c`", "id % 5 AS side", "CASE WHEN id % 7 > 0 THEN id END AS SIDE_", "NULL AS empty")
    with Ledger(spark) as ledger:
        for args in ({}, {"stratify": "a b.c"}):
            for want, got in zip(split(df, ["id"], **args), split_stored(df, ["id"], **args)):
                assert got.schema.simpleString() == want.schema.simpleString()
                columns = ["id", "`a b.c`", "side", "SIDE_", "empty"]
                assert set(map(tuple, got.select(*columns).collect())) == set(map(tuple, want.select(*columns).collect())) and got.count() == want.count()
        whole = split_stored(df.drop("id"))[1]
        plan = whole._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull" in plan and "md5" not in plan
        assert [f.count() for f in split_stored(df.limit(0), ["id"])] == [0, 0]
    ledger.close()


def test_a_run_that_fails_leaves_no_scratch_table_and_one_that_ends_gives_them_back(spark, monkeypatch):
    df = spark.range(300).selectExpr("id", "CAST(id % 17 AS DOUBLE) AS a", "CAST(id % 5 AS DOUBLE) AS b", "CASE WHEN id % 17 > 8 THEN 'yes' ELSE 'no' END AS target")
    settings = Settings(target="target", id_cols=["id"], max_trials=1, max_iter=3, models=["logistic_regression"], shap=False)
    tables = lambda: {n for n in held(spark) if not n.count("-") == 4}  # noqa: E731  (a checkpoint's folder is named by a plain UUID)
    before = tables()
    with train(df, settings, check=False) as run:
        assert any(n.startswith("split-") for n in tables() - before)
        assert run.tables["class_report"].count() > 0
    assert tables() == before
    monkeypatch.setattr("plumbline.plans.train.run_audit", lambda *a, **k: 1 / 0)
    with pytest.raises(StepFailed, match="audit"):
        train(df, settings, check=False)
    assert tables() == before
