"""Exact order statistics and ranks, with hot values, nulls and tiny sketches."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import association, ordering, ranks, split
from plumbline.operators.split import assign_folds, assign_test


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(2.0, 10.0, 6000), 2)
    x[:2500] = 7.0
    y = np.where(rng.random(6000) < 0.4, 1.0, np.round(x + rng.normal(0, 9, 6000), 1))
    pdf = pd.DataFrame({"id": range(6000), "x": x, "y": y})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("id") % 50 != 0, F.col("x")))
    return df.repartition(7), pdf.assign(x=pdf.x.where(pdf.id % 50 != 0))


@pytest.mark.parametrize("accuracy,span_rows", [(60, 100_000), (60, 40), (60, 1), (1000, 5), (100_000, 100_000)])
def test_quantiles_match_numpy_beyond_the_sketch(skewed, monkeypatch, accuracy, span_rows):
    df, pdf = skewed
    monkeypatch.setattr(ordering, "SPAN_ROWS", span_rows)
    probs = [0.0, 0.01, 0.25, 0.5, 0.777, 0.99, 1.0]
    got = ordering.quantiles(df, ["x", "y"], probs, accuracy=accuracy)
    for c in ("x", "y"):
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), probs), atol=1e-9)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_narrowed_brackets_around_hot_values(spark, monkeypatch, seed):
    rng = np.random.default_rng(seed)
    v = np.concatenate([np.full(3000, 5.0), np.full(2500, 5.5), rng.normal(5.2, 1e-3, 900), 10.0 ** rng.uniform(-300, 300, 600), [-1e308, np.inf]])
    df = spark.createDataFrame(pd.DataFrame({"v": rng.permutation(v)})).repartition(6)
    monkeypatch.setattr(ordering, "SPAN_ROWS", 7)
    want = np.sort(v)
    places = [0, 1, 299, *rng.integers(0, len(v), 12).tolist(), 3300, 3301, 3310, len(v) - 1]
    got = ordering.order_statistics(df, {"v": F.col("v")}, {"v": places}, accuracy=100)["v"]
    assert [got[1][k] for k in places] == [want[k] for k in places]


def test_quantiles_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(None, 4.0)], "a double, b double")
    assert ordering.quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [4.0]}


def test_positions(skewed):
    df, pdf = skewed
    want = np.sort(pdf.y)
    got = ordering.order_statistics(df, {"y": F.col("y")}, {"y": [0, 17, 5999]}, accuracy=80)["y"]
    assert got[0] == 6000
    assert [got[1][k] for k in (0, 17, 5999)] == [want[0], want[17], want[5999]]


def test_ranks_average_ties(skewed):
    df, pdf = skewed
    long = ordering.bucketed(df.select(F.col("y").alias("value")), ["value"], 8).select(
        F.lit("y").alias("column"), "value", F.col("value__b").alias("bucket")
    )
    got = {r["value"]: r["avg_rank"] for r in ordering.ranked(long, ["column"]).collect()}
    want = dict(zip(pdf.y, pdf.y.rank()))
    assert got == want


def test_bucket_numbers_follow_the_rows(skewed, monkeypatch):
    df, pdf = skewed
    want = pdf[["x", "y"]].dropna().rank().corr().iloc[0, 1]
    monkeypatch.setattr(ordering, "BUCKET_ROWS", 60)
    assert ordering.bucketed(df, ["x"]).select("x__b").distinct().count() > 30
    monkeypatch.setattr(ordering, "FEW_BUCKETS", 4)
    monkeypatch.setattr(ordering, "MAX_BUCKETS", 32)
    assert 8 < ordering.bucketed(df, ["x"]).select("x__b").distinct().count() <= 33
    assert abs(association.spearman(df, ["x"], "y").first()["rho"] - want) < 1e-9


def test_spearman_with_hot_values_equals_pandas(skewed, monkeypatch):
    df, pdf = skewed
    want = pdf[["x", "y"]].dropna().rank().corr().iloc[0, 1]
    for rows in (1_000_000, 100):
        monkeypatch.setattr(ranks, "TASK_ROWS", rows)
        row = association.spearman(df, ["x"], "y").first()
        assert row["rows"] == pdf.x.notna().sum()
        assert abs(row["rho"] - want) < 1e-9


def test_constant_column_has_no_rank_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(30)], "a double, b double")
    assert association.spearman(df, ["a"], "b").first()["rho"] is None
    assert association.spearman(df.where("a > 5"), ["a"], "b").count() == 0


def test_spearman_ranks_any_number_of_texts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"x": np.round(rng.normal(0, 1, 15_000), 1), "z": rng.normal(0, 1, 15_000)})
    pdf["t"] = ["k%d" % (3 * v + n) for v, n in zip(pdf.x * 100, rng.integers(0, 12_000, 15_000))]
    pdf.loc[::9, "t"] = None
    monkeypatch.setattr(ranks, "TASK_ROWS", 700)
    got = {r["column"]: r for r in association.spearman(spark.createDataFrame(pdf).repartition(5), ["x", "z"], "t").collect()}
    known = pdf.dropna()
    for c in ("x", "z"):
        assert got[c]["rows"] == len(known) and abs(got[c]["rho"] - known[c].rank().corr(known.t.rank())) < 1e-9


def test_skew_lookup_keeps_every_row(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int")
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m")).withColumn("total", F.lit(900))
    got = ordering.skew_lookup(df.unionByName(spark.createDataFrame([("none", -1), (None, -2)], df.schema)), table, ["k"], ["m"])
    out = {r["i"]: r["m"] for r in got.collect()}
    assert len(out) == 902 and out[-1] is None and out[-2] is None
    assert out[1] == 899 and out[3] == 3


def test_split_and_folds_are_exact_per_class(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b") for i in range(103)], "id long, c string")
    n = {(r["c"], r["is_test"]): r["count"] for r in assign_test(df, ["id"], stratify="c").groupBy("c", "is_test").count().collect()}
    assert n == {("a", True): 14, ("a", False): 56, ("b", True): 7, ("b", False): 26}
    folds = assign_folds(df, ["id"], k=5, stratify="c").groupBy("c", "fold").count().collect()
    assert {r["count"] for r in folds if r["c"] == "a"} == {14}
    assert sorted(r["count"] for r in folds if r["c"] == "b") == [6, 6, 7, 7, 7]
    again = assign_folds(df.repartition(5), ["id"], k=5, stratify="c")
    assert again.join(assign_folds(df, ["id"], k=5, stratify="c").withColumnRenamed("fold", "f2"), "id").where("fold <> f2").isEmpty()


def test_copies_of_a_row_stay_on_one_side(spark):
    df = spark.createDataFrame([(i % 20, "x") for i in range(200)], "v int, c string")
    sides = assign_test(df).groupBy("v").agg(F.count_distinct("is_test").alias("n")).collect()
    assert all(r["n"] == 1 for r in sides)


@pytest.mark.parametrize("cell_rows,broadcast_rows,bits", [(100_000, 10_000, 13), (3, 10_000, 13), (2, 50, 5)])
def test_splits_of_any_number_of_classes(spark, monkeypatch, cell_rows, broadcast_rows, bits):
    monkeypatch.setattr(split, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(split, "BROADCAST_ROWS", broadcast_rows)
    monkeypatch.setattr(split, "LEVEL_BITS", bits)
    rng = np.random.default_rng(2)
    kinds = [None, "hot", *[f"c{i}" for i in range(3000)]]
    pdf = pd.DataFrame({"id": range(9000), "c": [kinds[int(k)] for k in np.where(rng.random(9000) < 0.35, rng.integers(0, 2, 9000), rng.integers(0, 3002, 9000))]})
    pdf["h"] = [int(hashlib.md5(f"split{i}".encode()).hexdigest()[:13], 16) for i in pdf.id]
    pdf["f"] = [int(hashlib.md5(f"fold{i}".encode()).hexdigest()[:13], 16) for i in pdf.id]
    df = spark.createDataFrame(pdf[["id", "c"]]).repartition(5)
    groups = pdf.c.fillna("none")
    n = groups.map(groups.value_counts())
    want = dict(zip(pdf.id, pdf.groupby(groups).h.rank() <= np.floor(0.2 * n + 0.5)))
    assert {r["id"]: r["is_test"] for r in assign_test(df, ["id"], stratify="c").collect()} == want
    place = pdf.groupby(groups).f.rank()
    folds = sum((place > np.floor(n * j / 4)).astype(int) for j in range(1, 4))
    got = assign_folds(df.withColumn("fold", F.lit("old")), ["id"], k=4, stratify="c")
    assert got.columns == ["id", "c", "fold"] and {r["id"]: r["fold"] for r in got.collect()} == dict(zip(pdf.id, folds))


def test_splits_of_nothing_and_without_classes(spark):
    empty = spark.createDataFrame([], "id bigint, c string")
    for by in (None, "c"):
        assert assign_test(empty, ["id"], stratify=by).count() == assign_folds(empty, ["id"], stratify=by).count() == 0
    df = spark.range(103).selectExpr("id", "CAST(NULL AS STRING) AS c")
    for by in (None, "c"):
        assert assign_test(df, ["id"], stratify=by).where("is_test").count() == 21
        assert sorted(r["count"] for r in assign_folds(df, ["id"], stratify=by).groupBy("fold").count().collect()) == [20, 20, 21, 21, 21]
