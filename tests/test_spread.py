"""Fits of trees read rows in tasks of a bounded number, however few files hold them."""

from threading import Barrier

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogue import learning
from plumbline.functions.columns import for_passes
from plumbline.operators import select
from plumbline.operators.attribution import tree_importance
from plumbline.operators.cluster import assemble


def test_one_file_of_parts_becomes_several_tasks(spark, tmp_path):
    rows = spark.range(50_000).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"), (F.col("id") % 997 + 900.0).alias("p_retailprice"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    data = learning._spread(spark, str(tmp_path), ["size", "price", "noise"])
    sizes = [r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= 20_000


def test_iterative_fits_read_fuller_tasks_where_there_are_many(spark):
    tasks = [for_passes(spark.range(10), n).rdd.getNumPartitions() for n in (0, 20_001, 300_000, 1_200_000, 7_200_000)]
    assert tasks == [1, 2, 15, 16, 72]


def test_probes_of_a_consensus_are_fitted_side_by_side(spark, monkeypatch):
    together, whole = Barrier(3), select.probe

    def probe(*args):
        together.wait(timeout=20)
        return whole(*args)

    monkeypatch.setattr(select, "probe", probe)
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 20 > 9).cast("double").alias("label"))
    found = {r["feature"]: r["importance"] for r in select.consensus_importance(df, ["a", "b"], "classification", trees=2).collect()}
    assert found["a"] > found["b"]


def wide(spark, rows=3000):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(0, 10, (rows, 3)), 1)
    x[:, 1] = np.abs(np.round(x[:, 1] / 4))
    y = np.round(x[:, 0] * 2 + x[:, 1] ** 2 + rng.normal(0, 3, rows), 2)
    return spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double").repartition(3).cache()


@pytest.mark.parametrize("problem", ["classification", "regression"])
def test_probes_of_cells_are_those_of_all_rows(spark, problem):
    df = wide(spark)
    df = df.withColumn("label", F.col("y") if problem == "regression" else (F.col("y") > 10).cast("double"))
    cols = ["a", "b", "c"]
    got = {r["feature"]: r["importance"] for r in select.consensus_importance(df, cols, problem, trees=8, seeds=(0,)).collect()}
    data = assemble(df, cols)
    plain = tree_importance(select.probe(problem, 2, 42, 8).fit(data), data, cols).collect()
    assert got == pytest.approx({r["feature"]: r["importance"] for r in plain}, rel=1e-6)


@pytest.mark.parametrize("problem", ["classification", "regression"])
def test_probes_read_no_more_rows_where_the_table_repeats(spark, monkeypatch, problem):
    sizes, whole = [], select.tree_importance
    monkeypatch.setattr(select, "tree_importance", lambda model, data, *rest: sizes.append(data.count()) or whole(model, data, *rest))
    for rows in (20_000, 80_000):
        i = F.col("id")
        df = spark.range(rows).select((i % 50).cast("double").alias("a"), (i % 7).cast("double").alias("b"), (i % 50 > 20 + i % 7).cast("double").alias("label"))
        select.consensus_importance(df, ["a", "b"], problem, trees=2, seeds=(0,))
    assert max(sizes) <= 350 * 2


def test_a_probe_refuses_nulls(spark):
    df = wide(spark, 50).withColumn("label", F.col("y")).withColumn("c", F.when(F.col("a") > 0, F.col("c")))
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        select.consensus_importance(df, ["a", "b", "c"], "regression", trees=2, seeds=(0,))


def probed(monkeypatch):
    """Rows that probes are explained on, as a list that grows."""
    sizes, whole = [], select.tree_importance
    monkeypatch.setattr(select, "tree_importance", lambda model, data, *rest: sizes.append(data.count()) or whole(model, data, *rest))
    return sizes


def repeated(spark, rows):
    i = F.col("id")
    return spark.range(rows).select((i % 50).cast("double").alias("a"), (i % 7).cast("double").alias("b"), (i % 50 > 20 + i % 7).cast("double").alias("label"))


def test_selection_fits_its_probes_to_cells(spark, monkeypatch):
    sizes = probed(monkeypatch)
    found = select.select_features(repeated(spark, 20_000), ["a", "b"], "classification", 2, trees=2)
    assert len(sizes) == 3 and max(sizes) <= 350 * 2
    assert found.kept[0] == "a"


def test_elimination_fits_its_probes_to_cells(spark, monkeypatch):
    sizes = probed(monkeypatch)
    kept, history = select.eliminate(repeated(spark, 20_000), ["a", "b"], "classification", 2, len, trees=2)
    assert len(sizes) == 1 and max(sizes) <= 350 * 2
    assert kept == ["a", "b"] and history == [(2, 2), (1, 1)]
