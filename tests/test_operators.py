"""Hand-computed tables: nulls, NaN, ties, constants, unseen values."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.functions.columns import normalise
from plumbline.functions.normality import shapiro_pvalue
from plumbline.operators import association, attribution, audit, clean, detect, drops, encode, findings, limits, metrics, search, select
from plumbline.operators.cluster import assemble


def test_nan_counts_as_missing(spark):
    df = normalise(spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "a double"))
    assert audit.missing_shares(df).first()["missing"] == 0.5
    row = audit.numeric_stats(df).first()
    assert (row["n"], row["mean"], row["median"], row["max"]) == (2, 2.0, 2.0, 3.0)


def test_duplicates_by_digest_compare_whole_rows(spark, monkeypatch):
    rows = [(None, "a", 0.0), ("a", None, -0.0), ("a", None, 0.0), (None, "a", float("nan")), (None, "a", float("nan")), ("b", "c", 1.0), (None, None, None)]
    df = spark.createDataFrame(rows * 2 + [("d", "e", 2.0)], "x string, y string, z double")
    for most in (100_000, 1):
        monkeypatch.setattr(drops, "BROADCAST_ROWS", most)
        assert tuple(audit.duplicate_rows(df).first()) == (15, 9)
        assert sorted(map(str, drops.drop_duplicates(df).collect())) == sorted(map(str, df.distinct().collect()))
    # Strangers under one digest are not taken for copies.
    monkeypatch.setattr(drops, "row_digest", lambda df: [F.lit(1).alias("row__a"), F.lit(2).alias("row__b")])
    assert audit.duplicate_rows(df).first()["duplicates"] == 9 and drops.drop_duplicates(df).count() == 6


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, None), (2, "x")], "a int, b string")
    assert audit.duplicate_rows(df).first()["duplicates"] == 1
    assert drops.drop_duplicates(df).count() == 3


def test_logical_types(spark):
    df = spark.createDataFrame(
        [(1, "True", None, "2024-01-02 10:00", 1.5, "ab"), (0, "False", None, "2024-03-04", 2.0, "cd-efghijk")],
        "flag int, word string, empty string, day string, num double, text string",
    )
    got = {r["column"]: r["logical_type"] for r in audit.logical_types(df).collect()}
    assert got == {"flag": "boolean", "word": "boolean", "empty": "boolean", "day": "datetime", "num": "numeric", "text": "categorical"}


def test_quasi_constant_and_id_like(spark):
    rows = [(i, 1, "a" if i else "b", f"n{i}", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, one int, mostly string, name string, num double")
    card = audit.cardinality(df)
    assert {r["column"] for r in audit.quasi_constant(card).collect()} == {"one", "mostly"}
    # A double column is never an id, however distinct.
    assert {r["column"] for r in audit.id_like(df, card).collect()} == {"id", "name"}


def test_ledger_keeps_the_last_reason(spark):
    f = spark.createDataFrame(
        [("a", "missing", 0.95), ("a", "quasi_constant", 1.0), ("b", "id_like", 9.0), ("b", "leakage", 0.99), ("c", "skewed", 2.0)],
        "column string, kind string, value double",
    )
    assert {r["column"]: r["reason"] for r in findings.drop_ledger(f).collect()} == {"a": "quasi_constant", "b": "leakage"}
    assert {r["column"] for r in findings.drop_ledger(f, ["b"]).collect()} == {"a"}


def test_unknown_drop_warns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.warns(UserWarning, match="nope"):
        assert drops.drop_listed(df, ["a", "nope"]).columns == ["b"]


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.5,), (9.0,)], "a double")
    got = [r["a"] for r in clean.select_as(df, {"a": clean.clip("a", 0.0, 1.0)}).collect()]
    assert got == [None, 0.0, 0.5, 1.0]


def test_rare_values_and_all_rare(spark):
    rows = [("a",)] * 150 + [("b",)] * 149 + [("c",)] + [(None,)]
    df = spark.createDataFrame(rows, "k string")
    keep = clean.common_values(df, ["k"])["k"]
    got = {r["k"] for r in clean.select_as(df, {"k": clean.group_rare("k", keep)}).collect()}
    assert got == {"a", "b", "__other__", None}
    many = spark.createDataFrame([(f"v{i}",) for i in range(300)], "k string")
    keep = clean.common_values(many, ["k"])
    assert keep == {"k": []}
    assert clean.select_as(many, {"k": clean.group_rare("k", [])}).distinct().count() == 1
    assert clean.common_values(df.where("k in ('a', 'b')"), ["k"]) == {}


def test_encoders_on_unseen_values_and_quotes(spark):
    df = spark.createDataFrame([("it's",), ("b\\c",), (None,), ("new",)], "k string")
    values = sorted(["it's", "b\\c", "missing"])
    hot = clean.select_as(df, encode.onehot("k", "k", values[:2], "it's")).collect()
    assert [sum(r) for r in hot] == [1.0, 1.0, 1.0, 0.0]
    codes = [r[0] for r in clean.select_as(df, {"k": encode.ordinal("k", values)}).collect()]
    assert codes == [values.index("it's"), values.index("b\\c"), values.index("missing"), -1.0]


def test_mode_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), ("a", None)], "k string, e string")
    assert encode.most_frequent(df, ["k", "e"]) == {"k": "a", "e": None}


def test_target_codes_of_a_hot_category(spark, monkeypatch):
    rng = np.random.default_rng(5)
    keys = ["hot" if i % 3 else f"k{i % 90}" for i in range(900)]
    ys = rng.normal(1e6, 1.0, 900)
    df = spark.createDataFrame([(k, float(y)) for k, y in zip(keys, ys)], "k string, y double")
    def shrunk(y, mean, var):
        lam = len(y) * var / (len(y) * var + y.var())
        return lam * y.mean() + (1 - lam) * mean
    monkeypatch.setattr(encode, "BROADCAST_ROWS", 0)
    codes = encode.fit_target_codes(df, "k", ["y"], ["c"])
    got = {r["k"]: r["c"] for r in codes.apply(df.select("k"), "k").distinct().collect()}
    for k in set(keys):
        y = ys[[i for i, x in enumerate(keys) if x == k]]
        assert got[k] == pytest.approx(shrunk(y, ys.mean(), ys.var()), rel=1e-9)


def test_cross_fitting_a_category_of_one_fold(spark):
    rows = [("a", 1.0, 0), ("a", 3.0, 1), ("only", 9.0, 0), ("a", 5.0, 1)]
    df = spark.createDataFrame(rows, "k string, y double, fold int")
    out = {(r["k"], r["y"]): r["c"] for r in encode.cross_fitted(df, "k", ["y"], ["c"], "fold").collect()}
    # Without fold 0 the category is unseen, so it gets the mean of the other rows.
    assert out["only", 9.0] == 4.0 and out["a", 1.0] == 4.0


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i), None if i % 2 else 2.0) for i in range(20)], "a double, b double, c double")
    pairs = {(r["later"], r["earlier"]): r["r"] for r in association.pearson_pairs(df, ["a", "b", "c"]).collect()}
    assert pairs == {("b", "a"): None, ("c", "a"): None, ("c", "b"): None}


def test_many_columns_use_one_matrix(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (200, 16))
    x[:, 5] = x[:, 2] * 2 + 0.01 * x[:, 5]
    x[:, 9] = 1.0
    names = [f"c{i}" for i in range(16)]
    df = spark.createDataFrame([[None if i == 3 and j % 9 == 0 else float(v) for i, v in enumerate(r)] for j, r in enumerate(x)], ", ".join(f"{n} double" for n in names))
    got = {(r["later"], r["earlier"]): r["r"] for r in association.pearson_pairs(df, names).collect()}
    assert len(got) == 120 and got["c9", "c1"] is None
    assert got["c5", "c2"] == pytest.approx(abs(np.corrcoef(x[:, 2], x[:, 5])[0, 1]))
    keep = np.arange(200) % 9 != 0
    assert got["c3", "c1"] == pytest.approx(abs(np.corrcoef(x[keep, 1], x[keep, 3])[0, 1]))


def test_constant_target_gives_the_mean(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "k string, y double")
    codes = encode.fit_target_codes(df, "k", ["y"], ["c"])
    assert [r["c"] for r in codes.apply(df.select("k"), "k").collect()] == [2.0, 2.0]


def test_shapiro_against_published_values():
    x1 = [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66]
    x2 = [1.36, 1.14, 2.92, 2.55, 1.46, 1.06, 5.27, -1.11, 3.48, 1.10, 0.88, -0.51, 1.46, 0.52, 6.20, 1.69, 0.08, 3.67, 2.81, 3.49]
    assert shapiro_pvalue(x1) == pytest.approx(0.04209, abs=2e-4)
    assert shapiro_pvalue(x2) == pytest.approx(0.52460, abs=2e-3)


def test_normal_samples_are_found_normal(spark):
    rng = np.random.default_rng(11)
    for n in (800, 9000):
        df = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, n)], "y double")
        assert detect.evidence(df, "y").first()["p_normal"] > 0.05
        skewed = df.select(F.exp("y").alias("y"))
        assert detect.evidence(skewed, "y").first()["p_normal"] < 0.001


def test_detection_anchors(spark):
    sf = "/root/testdata/sf0.01"
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    d = detect.detect(li, "l_quantity")
    assert (d.problem, d.method, d.confidence) == ("classification", "caller_choice", "high")
    assert detect.detect(li, "l_quantity", on_ambiguous="regression").problem == "regression"
    assert detect.detect(li, None).problem == "clustering"
    with pytest.raises(ValueError):
        detect.detect(li, "l_quantity", force="ranking")
    forced = detect.detect(li, "l_linestatus", force="regression")
    assert forced.warnings and forced.method == "user"


def test_gap_variance_across_buckets(spark):
    rng = np.random.default_rng(2)
    v = np.unique(np.round(rng.exponential(50, 4000), 2))
    df = spark.createDataFrame([(float(x),) for x in np.concatenate([v, v[:500]])], "y double")
    row = detect.gap_variance(df, "y").first()
    assert row["distinct"] == len(v)
    assert row["gap_variance"] == pytest.approx(np.diff(v).var(), rel=1e-9)


def brute_shapley(tree, x, d):
    """All coalitions of one tree given as nested (feature, cut, share_left, left, right) or a value."""
    def value(node, s):
        if not isinstance(node, tuple):
            return node
        f, cut, share, left, right = node
        if f in s:
            return value(left if x[f] <= cut else right, s)
        return share * value(left, s) + (1 - share) * value(right, s)
    phi = np.zeros(d)
    for j in range(d):
        rest = [i for i in range(d) if i != j]
        for r in range(d):
            for s in itertools.combinations(rest, r):
                w = math.factorial(r) * math.factorial(d - r - 1) / math.factorial(d)
                phi[j] += w * (value(tree, {*s, j}) - value(tree, set(s)))
    return phi


def test_tree_attribution_equals_all_coalitions(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 3))
    y = np.where(x[:, 0] > 0, x[:, 1] * 2, x[:, 2]) + (x[:, 0] > 1)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)]
    cols = ["a", "b", "c"]
    data = assemble(spark.createDataFrame(rows, "a double, b double, c double, label double"), cols)
    model = DecisionTreeRegressor(maxDepth=4, seed=1).fit(data)
    phi, base = attribution.tree(model, data, cols, cols)
    def nested(node):
        if node.subtreeDepth() == 0:
            return node.prediction()
        split = node.split()
        l, r = node.leftChild(), node.rightChild()
        n = l.impurityStats().count() + r.impurityStats().count()
        return (split.featureIndex(), split.threshold(), l.impurityStats().count() / n, nested(l), nested(r))
    tree = nested(model._java_obj.rootNode())
    for r in phi.limit(25).collect():
        assert np.allclose(r["phi"], brute_shapley(tree, np.array([r["a"], r["b"], r["c"]]), 3), atol=1e-9)


def test_shares_of_a_leaf_are_those_of_all_coalitions():
    rng = np.random.default_rng(8)
    for m in range(1, 8):
        reach, met = rng.uniform(0.01, 1, m), rng.integers(0, 2, m) > 0
        worth = lambda s: np.prod([met[i] if i in s else reach[i] for i in range(m)])
        for j, got in enumerate(attribution.shares(reach, met)):
            others = [i for i in range(m) if i != j]
            want = sum(
                math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (worth({*s, j}) - worth(set(s)))
                for k in range(m) for s in itertools.combinations(others, k)
            )
            assert got == pytest.approx(want, abs=1e-12)


def test_tables_of_conditions_give_what_single_rows_give():
    """Paths of 1 to 13 conditions, several outputs, bounds that are met exactly, NaN, more leaves than a block holds."""
    rng = np.random.default_rng(9)
    leaves = []
    for m in [*range(1, 14)] * 3 + [2] * 1500:
        low = rng.integers(-3, 1, m).astype(float)
        leaves.append(attribution.Leaf(rng.normal(size=2), sorted(rng.choice(15, m, replace=False).tolist()), low, low + rng.integers(1, 4, m), rng.uniform(0.05, 1, m)))
    blocks = attribution.blocks_of(leaves)
    assert sum(len(b.features) for b in blocks) == len(leaves) and max(b.features.size for b in blocks) <= attribution.COLUMNS
    x = rng.integers(-4, 5, (1100, 15)).astype(float)
    x[5, 3] = np.nan
    together = attribution.explain_batch(blocks, x, 2)
    for i in [0, 5, 511, 512, 1099]:
        assert np.allclose(together[i], attribution.explain_batch(blocks, x[i : i + 1], 2)[0], atol=1e-11)
    # What the conditions add up to: the leaf's value where all are met, less its mean.
    met = lambda b, r: ((r[b.features] > b.low) & (r[b.features] <= b.high)).all(axis=1)
    for i in [0, 7, 900]:
        want = sum(((met(b, x[i]) - b.reach.prod(axis=1))[:, None] * b.value).sum(axis=0) for b in blocks)
        assert np.allclose(together[i].sum(axis=1), want, atol=1e-9)


def test_sampled_attribution_is_near_exact_for_an_additive_model(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (150, 2)))], "id long, a double, b double")
    phi = attribution.sampled(lambda t: t.withColumn("score", 3 * F.col("a") - F.col("b")), df, ["a", "b"], "id", orders=150)
    row = phi.join(df, phi.key == df.id).groupBy("feature").agg(F.corr("phi", F.when(F.col("feature") == "a", F.col("a")).otherwise(-F.col("b"))).alias("r")).collect()
    assert len(row) == 2 and all(r["r"] > 0.99 for r in row)


def test_walks_are_joined_by_key_however_small_their_files(spark, capsys):
    df = spark.range(60).select("id", F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    attribution.walked(lambda t: t.withColumn("score", F.col("a")), df, ["a", "b"], "id", orders=2).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin [place#" in plan and "BroadcastHashJoin [place#" not in plan


def test_sampled_attribution_walks_all_rows_unless_asked(spark):
    df = spark.range(450).selectExpr("id", "CAST(id AS DOUBLE) AS a", "CAST(id % 7 AS DOUBLE) AS b")
    score = lambda t: t.withColumn("score", F.col("a") + F.col("b"))
    phi = attribution.sampled(score, df, ["a", "b"], "id", orders=2)
    assert phi.select("key").distinct().count() == 450 and phi.count() == 900
    assert attribution.sampled(score, df, ["a", "b"], "id", rows=30, background=10, orders=2).select("key").distinct().count() == 30


def test_walks_add_up_for_every_output_and_key(spark):
    df = spark.range(40).selectExpr("id", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 3 AS DOUBLE) AS b", "id * id AS c")
    score = lambda t: t.withColumn("score", F.array(F.col("a") * F.col("b"), F.col("c") - F.col("a"), F.lit(2.0)))
    found = attribution.walked(score, df, ["a", "b", "c"], "id", orders=7).collect()
    want = {r["id"]: r["score"] for r in score(df).collect()}
    for i in range(40):
        for o in range(3):
            own = [r for r in found if (r["key"], r["output"]) == (i, o)]
            assert {r["feature"] for r in own} == {"a", "b", "c", None} and len(own) == 4
            assert sum(r["phi"] for r in own) == pytest.approx(want[i][o])
    assert attribution.sampled(score, df.limit(0), ["a", "b", "c"], "id").count() == 0


def test_labels_of_any_number_get_codes_in_their_order(spark, monkeypatch):
    df = spark.range(9000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', pmod(xxhash64(id), 4000)) END AS t")
    rows = {r["id"]: r["t"] for r in df.collect()}
    code = {n: i for i, n in enumerate(sorted({t for t in rows.values() if t is not None}))}
    assert len(code) > 2000
    for most in (100_000, 10):
        monkeypatch.setattr(encode, "BROADCAST_ROWS", most)
        assert {r["id"]: r["t"] for r in encode.label_encode(df, "t").collect()} == {i: code.get(t) for i, t in rows.items()}


def test_pruning_waits_for_five_trials():
    done = [[0.8, 0.8, 0.8]] * 5
    assert not search.behind([0.1], done[:4])
    assert search.behind([0.7], done) and not search.behind([0.85], done)
    # The best running mean counts, not the latest.
    assert not search.behind([0.9, 0.1], done)


def test_spaces_narrow_for_very_small_tables():
    wide = {n: hi for n, _, hi, _ in search.space("lightgbm")}
    narrow = {n: hi for n, _, hi, _ in search.space("lightgbm", "very_small")}
    assert (wide["n"], wide["leaves"]) == (500, 100) and (narrow["n"], narrow["leaves"]) == (200, 31)
    assert "svc" in search.model_pool("classification") and "svr" in search.model_pool("regression")


def test_every_trial_failing_is_an_error(spark, monkeypatch):
    def broken(params, facts):
        raise RuntimeError("cannot be built")

    monkeypatch.setitem(search.FACTORIES, "ridge", broken)
    df = spark.createDataFrame([(float(i), 0.0, i % 5) for i in range(50)], "a double, label double, fold int")
    with pytest.raises(RuntimeError, match="no successful trial"):
        search.search(df, ["a"], "regression", 0, Settings(max_trials=2, models=["ridge"]))
    with pytest.raises(ValueError, match="unknown models"):
        search.search(df, ["a"], "regression", 0, Settings(max_trials=1, models=["oracle"]))


def test_selection_notes():
    assert select.check_selection(0.9, 0.87, "classification") and not select.check_selection(0.9, 0.89, "classification")
    assert select.check_selection(1.0, 1.06, "regression") and not select.check_selection(1.0, 1.04, "regression")


def test_auc_without_both_classes_is_null(spark):
    df = spark.createDataFrame([(True, 0.2), (True, 0.9)], "p boolean, s double")
    assert metrics.roc_auc(df, "p", "s").first()["roc_auc"] is None
    tied = spark.createDataFrame([(True, 0.5), (False, 0.5)], "p boolean, s double")
    assert metrics.roc_auc(tied, "p", "s").first()["roc_auc"] == 0.5


def test_reports_of_any_number_of_labels(spark):
    df = spark.range(60_000).selectExpr("concat('k', id % 20000) AS label", "CASE WHEN id % 4 = 0 THEN concat('k', id % 30000) WHEN id % 91 = 0 THEN NULL ELSE concat('k', id % 20000) END AS prediction")
    pdf = df.toPandas().dropna()
    found = {r["class"]: r for r in metrics.class_report(metrics.cells(df)).collect()}
    support, predicted = pdf.label.value_counts(), pdf.prediction.value_counts()
    hits = pdf[pdf.label == pdf.prediction].label.value_counts()
    assert set(found) == set(support.index) | set(predicted.index) and len(found) > 22_000
    for c in [*list(found)[::501], "k20000", "k0"]:
        r, h = found[c], hits.get(c, 0)
        assert r["support"] == support.get(c, 0) and r["precision"] == pytest.approx(h / predicted[c] if c in predicted else 0) and r["recall"] == pytest.approx(h / support[c] if c in support else 0)
    assert metrics.confusion(df).count() == metrics.cells(df).count()
    small = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "b"), (None, "a")], "label string, prediction string")
    assert sorted(map(tuple, metrics.confusion(small).collect())) == [(x, y, int((x, y) in {("a", "b"), ("a", "c"), ("b", "b")})) for x in "abc" for y in "abc"]


def test_perfect_fit_and_adjustment(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0)], "y double, p double")
    row = metrics.regression_scores(df, "y", "p", 2).first()
    assert row["r2"] == 1.0 and row["rmse"] == 0.0 and row["adj_r2"] is None


def test_limitations_by_size(spark):
    def codes(**k):
        return {r["code"] for r in limits.limitations(spark, **k).collect()}
    assert "very_small" in codes(rows=499, problem="regression", trials=50)
    assert codes(rows=1999, problem="regression", trials=50) == {"small"}
    assert codes(rows=2000, problem="regression", trials=50) == set()
    assert codes(rows=9000, problem="clustering") == {"clustering"}


def test_boosted_attribution_adds_up_for_deep_trees(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (500, 4))
    df = spark.createDataFrame([(*map(float, r), float(r[0] * r[1] + np.sin(3 * r[2]))) for r in x], "a double, b double, c double, d double, label double")
    cols = ["a", "b", "c", "d"]
    data = assemble(df, cols)
    model = GBTRegressor(maxIter=3, maxDepth=9, seed=1).fit(data)
    phi, base = attribution.tree(model, model.transform(data), cols, ["prediction"])
    gap = phi.select(F.max(F.abs(F.aggregate("phi", F.lit(float(base[0])), lambda s, v: s + v) - F.col("prediction")))).first()[0]
    assert gap < 1e-9
