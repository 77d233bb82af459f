"""Selection, search, attribution and whole training runs."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from catalogue import query, rounded, run_sql, table
from plumbline.config import Settings
from plumbline.functions.columns import compact, for_passes
from plumbline.operators import association, attribution, metrics, search, select, split
from plumbline.operators.cluster import assemble
from plumbline.plans.report import report
from plumbline.plans.train import train

PARTS = """SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice / 100 AS price, p_retailprice / 100 + p_size / 1000.0 AS twin,
  CAST(p_partkey % 7 AS DOUBLE) AS noise, 0.001 * p_size AS flat, CASE WHEN p_retailprice + p_size * 3 < 1000 THEN 1.0 ELSE 0.0 END AS label FROM {part}"""
COLS = ["size", "price", "twin", "noise", "flat"]


def parts(spark, sf):
    return run_sql(spark, sf, PARTS).withColumn("label", F.col("label").cast("double")).withColumn("flat", F.col("flat").cast("double")).withColumn("twin", F.col("twin").cast("double"))


@query("select_variance", f"WITH x AS ({PARTS}) " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(var_pop({c}), 6) AS variance, var_pop({c}) > 0.01 AS kept FROM x""" for c in COLS))
def _(spark, sf):
    return rounded(select.variances(parts(spark, sf), COLS))


IMPORTANCE = " UNION ALL ".join(f"SELECT '{c}' AS feature, abs(corr({c}, label)) AS importance FROM x" for c in COLS[:4])


def _importance(df):
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.abs(F.corr(c, "label")).alias("importance")) for c in COLS[:4]])
    return df.agg(rows.alias("r")).select(F.inline("r"))


@query("select_correlated", f"""WITH x AS ({PARTS}), i AS ({IMPORTANCE}),
p AS (SELECT 'twin' AS later, 'price' AS earlier FROM x HAVING abs(corr(price, twin)) > 0.95)
SELECT CASE WHEN coalesce(a.importance, 0) < coalesce(b.importance, 0) THEN later ELSE earlier END AS "column" FROM p LEFT JOIN i a ON a.feature = later LEFT JOIN i b ON b.feature = earlier""")
def _(spark, sf):
    df = parts(spark, sf)
    return select.weaker_of_pairs(association.pearson_pairs(df, COLS[:4], above=0.95), _importance(df))


@query("select_correlated_unscored", f"""WITH x AS ({PARTS}) SELECT 'price' AS "column" FROM x HAVING abs(corr(price, twin)) > 0.95""")
def _(spark, sf):
    # Without scores every pair is a tie, and the earlier column goes.
    df = parts(spark, sf)
    return select.weaker_of_pairs(association.pearson_pairs(df, COLS[:4], above=0.95), _importance(df).where("importance < 0"))


@query("select_weak", f"""WITH x AS ({PARTS}), i AS (SELECT feature, power(importance, 4) AS importance FROM ({IMPORTANCE}) r) SELECT feature AS "column" FROM i WHERE importance < 0.01 * (SELECT max(importance) FROM i)""")
def _(spark, sf):
    return select.weak_features(_importance(parts(spark, sf)).withColumn("importance", F.pow("importance", 4)))


@query("select_leaks", f"SELECT p_partkey, size, noise FROM ({PARTS}) x")
def _(spark, sf):
    df = parts(spark, sf)
    rho = association.spearman(df, ["size", "noise", "twin"], "price")
    leaks = [r["column"] for r in association.leakage(rho, "rho", "spearman").collect()]
    return df.select("p_partkey", *select.drop_leaks(["size", "noise", "twin"], leaks))


@query("consensus_importance")
def _(spark, sf):
    return rounded(select.consensus_importance(parts(spark, sf), ["size", "price", "noise"], "classification", 2))


@query("select_features")
def _(spark, sf):
    df = parts(spark, sf)
    pairs = [tuple(r) for r in association.pearson_pairs(df, COLS[:4], above=0.95).collect()]
    return select.select_features(df, COLS, "classification", 2, pairs=pairs).ledger(spark)


@query("recursive_elimination")
def _(spark, sf):
    folded = split.assign_folds(parts(spark, sf), ["p_partkey"], k=3, stratify="label")
    n = folded.count()
    df = for_passes(folded, n).cache()
    facts = search.Facts("classification", n, 2, 1.0, False, 42)

    def score(cols):
        return sum(search.cross_validate(df, search.build("logistic_regression", {"c": 1.0}, cols, facts), "classification", 3)) / 3

    kept, history = select.eliminate(df, ["size", "price", "noise"], "classification", 2, score)
    df.unpersist()
    return rounded(spark.createDataFrame([(n, float(s), len(kept)) for n, s in history], "features int, score double, kept int"))


@query("selection_check", f"""SELECT CASE WHEN kept < full_score - 0.02 THEN 'selection reduced F1 by more than 0.02' ELSE 'stable' END AS note FROM (
SELECT avg(CASE WHEN (price + size * 0.03 < 10) = (label = 1) THEN 1.0 ELSE 0.0 END) AS full_score, avg(CASE WHEN (price < 9.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS kept FROM ({PARTS}) x) s""")
def _(spark, sf):
    df = parts(spark, sf)
    full = F.avg(((F.col("price") + F.col("size") * 0.03 < 10) == (F.col("label") == 1)).cast("double"))
    kept = F.avg(((F.col("price") < 9.5) == (F.col("label") == 1)).cast("double"))
    a, b = df.agg(full, kept).first()
    return spark.createDataFrame([(select.check_selection(a, b, "classification") or "stable",)], "note string")


@query("class_weights", """WITH c AS (SELECT toxic, count(*) AS n FROM {labels} GROUP BY toxic) SELECT toxic AS label, n, round(CAST((SELECT max(n) FROM c) AS DOUBLE) / n, 6) AS weight FROM c""")
def _(spark, sf):
    return rounded(search.class_weight(table(spark, sf, "labels"), "toxic"))


TRIALS = "SELECT p_brand AS trial, CAST(p_partkey % 5 AS INTEGER) AS fold, avg(p_size) AS score FROM {part} GROUP BY 1, 2"


@query("pruned_trials", f"""WITH t AS ({TRIALS}), m AS (SELECT trial, fold, avg(score) OVER (PARTITION BY trial ORDER BY fold) AS mean FROM t),
bar AS (SELECT fold, median(mean) AS bar FROM m WHERE trial < 'Brand#2' GROUP BY fold),
b AS (SELECT trial, fold, max(mean) OVER (PARTITION BY trial ORDER BY fold) AS best FROM m WHERE trial >= 'Brand#2')
SELECT trial, min(b.fold) AS fold FROM b JOIN bar USING (fold) WHERE best < bar GROUP BY trial""")
def _(spark, sf):
    t = run_sql(spark, sf, TRIALS)
    return search.pruned_at(t.where("trial < 'Brand#2'"), t.where("trial >= 'Brand#2'"))


@query("ridge_weights", f"""WITH x AS ({PARTS}), s AS (SELECT count(*) * covar_pop(size, size) + 5 AS aa, count(*) * covar_pop(noise, noise) + 5 AS bb, count(*) * covar_pop(size, noise) AS ab,
count(*) * covar_pop(size, price) AS ay, count(*) * covar_pop(noise, price) AS yb FROM x)
SELECT 'size' AS feature, round((ay * bb - yb * ab) / (aa * bb - ab * ab), 6) + 0.0 AS weight FROM s UNION ALL SELECT 'noise', round((yb * aa - ay * ab) / (aa * bb - ab * ab), 6) + 0.0 FROM s""")
def _(spark, sf):
    df = parts(spark, sf).withColumn("label", F.col("price"))
    n, sd = df.agg(F.count(F.lit(1)), F.stddev_pop("label")).first()
    facts = search.Facts("regression", n, 0, sd, False, 42)
    model = search.build("ridge", {"alpha": 5.0}, ["size", "noise"], facts).fit(df).stages[-1]
    return rounded(spark.createDataFrame(list(zip(["size", "noise"], [float(w) for w in model.coefficients])), "feature string, weight double"))


def _folded(spark, sf):
    return split.assign_folds(parts(spark, sf), ["p_partkey"], k=5, stratify="label")


@query("cross_validation")
def _(spark, sf):
    df = _folded(spark, sf).cache()
    facts = search.Facts("classification", df.count(), 2, 1.0, False, 42)
    rows = []
    for name, params in (("logistic_regression", {"c": 1.0}), ("random_forest", {"n": 10.0, "depth": 4.0, "min": 2.0})):
        scores = search.cross_validate(df, search.build(name, params, ["size", "price", "noise"], facts), "classification", 5)
        rows += [(name, i, float(s)) for i, s in enumerate(scores)]
    df.unpersist()
    return rounded(spark.createDataFrame(rows, "model string, fold int, score double"))


def _study(study, df, budget, scores, predicted):
    """What must hold of any search: counts of what is wrong in its log, and the rows its model predicts."""
    best = study.trials.where("state = 'complete'").agg(F.max("score")).first()[0]
    wrong = lambda ok: F.count(F.when(~F.coalesce(ok, F.lit(False)), 1))
    state, some = F.col("state"), F.exists("fold_scores", lambda s: s.isNull())
    mean = F.abs(F.aggregate("fold_scores", F.lit(0.0), lambda a, b: a + b) / F.size("fold_scores") - F.col("score")) < 1e-9
    counts = study.trials.agg(
        F.count(F.lit(1)).alias("trials"), F.count(F.when(F.col("best"), 1)).alias("best"),
        wrong(F.col("best") == ((state == "complete") & (F.col("score") == best))).alias("wrong_best"),
        wrong(state.isin("complete", "pruned", "timed_out")).alias("failed"),
        wrong(F.when(state == "complete", (F.size("fold_scores") == 5) & ~some & mean).otherwise(F.size("fold_scores") <= 5)).alias("wrong_folds"),
        wrong(F.forall("fold_scores", lambda s: s.isNull() | scores(s))).alias("strange_scores"),
        wrong(F.col("seconds") < budget + 10).alias("late"),
    )
    rows = study.model.transform(df).agg(F.count(F.when(predicted(F.col("prediction")), 1)).alias("predicted"))
    return counts.unpivot([], counts.columns, "property", "n").union(rows.unpivot([], ["predicted"], "property", "n"))


STUDY = " UNION ALL ".join(f"SELECT '{p}' AS property, CAST({n} AS BIGINT) AS n" for p, n in {"trials": 3, "best": 1, "wrong_best": 0, "failed": 0, "wrong_folds": 0, "strange_scores": 0, "late": 0}.items()) + " UNION ALL SELECT 'predicted', count(*) FROM part"


@query("search_classification", STUDY)
def _(spark, sf):
    """Drawn settings in full, on all rows, within 60 seconds and the grace to cancel what runs."""
    df = _folded(spark, sf)
    study = search.search(
        df, ["size", "price", "noise"], "classification", 2,
        Settings(max_trials=3, time_budget=60, models=["logistic_regression", "random_forest", "lightgbm"]),
    )
    return _study(study, df, 60, lambda s: s.between(0, 1), lambda p: p.isin(0.0, 1.0))


@query("search_regression", STUDY)
def _(spark, sf):
    df = split.assign_folds(parts(spark, sf).withColumn("label", F.col("price") * F.col("size")), ["p_partkey"], k=5)
    study = search.search(
        df, ["size", "price", "noise"], "regression", 0, Settings(max_trials=3, time_budget=60, models=["ridge", "xgboost", "random_forest"])
    )
    return _study(study, df, 60, lambda s: s <= 0, lambda p: p.isNotNull())


def _spread(spark, sf, cols):
    """The parts as features, in tasks of a bounded number of rows: a file may be one task, which would hold all rows of a tree's fit."""
    df = parts(spark, sf)
    return assemble(compact(df, df.count()), cols)


@query("attribution_tree")
def _(spark, sf):
    cols = ["size", "price", "noise"]
    data = _spread(spark, sf, cols)
    model = GBTClassifier(maxIter=5, maxDepth=4, seed=1).fit(data)
    return metrics.ranking(attribution.tree_importance(model, data, cols))


@query("attribution_tree_adds_up", "SELECT 'boosted' AS model, count(*) AS rows, CAST(0 AS DOUBLE) AS gap FROM {part} UNION ALL SELECT 'forest', count(*), CAST(0 AS DOUBLE) FROM {part} UNION ALL SELECT 'values', count(*), CAST(0 AS DOUBLE) FROM {part}")
def _(spark, sf):
    """Attributions plus the mean equal the score of every row."""
    cols = ["size", "price", "noise"]
    data = _spread(spark, sf, cols)
    out = []
    for name, model in (
        ("boosted", GBTClassifier(maxIter=5, maxDepth=4, seed=1).fit(data)),
        ("forest", RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(data)),
        ("values", GBTRegressor(maxIter=5, maxDepth=4, seed=1, labelCol="price").fit(data)),
    ):
        scored = model.transform(data)
        if name == "boosted":
            score, output = vector_to_array("rawPrediction")[1], 0
        elif name == "forest":
            score, output = vector_to_array("probability")[1], 1
        else:
            score, output = F.col("prediction"), 0
        phi, base = attribution.tree(model, scored.select("*", score.alias("score")), cols, ["score"])
        part = F.slice("phi", output * len(cols) + 1, len(cols))
        total = F.aggregate(part, F.lit(float(base[output])), lambda s, v: s + v)
        out.append(phi.agg(F.count(F.lit(1)).alias("rows"), F.round(F.max(F.abs(total - F.col("score"))), 6).alias("gap")).select(F.lit(name).alias("model"), "rows", "gap"))
    return out[0].union(out[1]).union(out[2])


@query("attribution_one_row")
def _(spark, sf):
    cols = ["size", "price", "noise"]
    data = _spread(spark, sf, cols)
    model = GBTClassifier(maxIter=5, maxDepth=4, seed=1).fit(data)
    largest = data.agg(F.max("p_partkey")).scalar()
    phi, _ = attribution.tree(model, data.where(F.col("p_partkey") == largest), cols)
    return rounded(attribution.explain_row(phi, cols))


@query("attribution_sampled")
def _(spark, sf):
    cols = ["size", "price", "noise"]
    df = parts(spark, sf)
    n = df.count()
    model = search.build("svc", {"c": 1.0}, cols, search.Facts("classification", n, 2, 1.0, False, 42)).fit(compact(df, n, 100_000))

    def score(t):
        return model.transform(t).withColumn("score", vector_to_array("rawPrediction")[1])

    return metrics.ranking(attribution.sampled_importance(attribution.sampled(score, df, cols, "p_partkey")))


@query("attribution_sampled_adds_up", "SELECT count(*) AS rows, CAST(0 AS DOUBLE) AS gap FROM {part}")
def _(spark, sf):
    """Attributions plus the mean score of the background rows equal the score of every row."""
    cols = ["size", "price", "noise"]
    df = parts(spark, sf)
    n = df.count()
    model = search.build("svc", {"c": 1.0}, cols, search.Facts("classification", n, 2, 1.0, False, 42)).fit(compact(df, n, 100_000))

    def score(t):
        return model.transform(t).withColumn("score", vector_to_array("rawPrediction")[1])

    totals = attribution.walked(score, df, cols, "p_partkey").groupBy("key").agg(F.sum("phi").alias("total"))
    both = score(compact(df.select(*cols, "p_partkey"), n)).join(totals.hint("merge"), F.col("p_partkey") == F.col("key"))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.round(F.max(F.abs(F.col("total") - F.col("score"))), 6).alias("gap"))


@query("train_classification")
def _(spark, sf):
    df = run_sql(spark, sf, "SELECT p_partkey, p_brand, p_type, p_size, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice END AS price, CASE WHEN p_retailprice + p_size * 3 < 1000 THEN 'yes' ELSE 'no' END AS cheap FROM {part}")
    run = train(df, Settings(target="cheap", id_cols=["p_partkey"], max_trials=2, models=["logistic_regression", "random_forest"]))
    return rounded(run.tables["class_report"])


@query("train_regression")
def _(spark, sf):
    df = run_sql(spark, sf, "SELECT p_partkey, p_brand, p_type, p_size, p_size * 10 + p_retailprice AS cost FROM {part}")
    run = train(df, Settings(target="cost", id_cols=["p_partkey"], max_trials=2, models=["ridge", "random_forest"]))
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in run.metrics.items() if v is not None], "metric string, value double"))


@query("train_clustering")
def _(spark, sf):
    run = train(table(spark, sf, "customer").drop("c_name"), Settings(id_cols=["c_custkey"]))
    return rounded(run.tables["cluster_profiles"])


@query(
    "report_summary",
    """WITH t AS (SELECT CASE WHEN p_retailprice + p_size * 3 < 1000 THEN 'yes' ELSE 'no' END AS cheap, p_partkey FROM {part}),
    classes AS (SELECT cheap, count(*) AS n FROM t GROUP BY cheap)
    SELECT 'rows' AS item, CAST(CAST(sum(n - floor(0.2 * n + 0.5)) AS BIGINT) AS VARCHAR) AS value FROM classes
    UNION ALL SELECT 'duplicates', CAST(count(*) AS VARCHAR) FROM t WHERE p_partkey % 10 = 0
    UNION ALL SELECT 'problem', 'classification'
    UNION ALL SELECT 'target', 'cheap'
    UNION ALL SELECT 'model', 'logistic_regression'""",
)
def _(spark, sf):
    """The head of a run's report: training rows left of the table without its copies, and the copies found."""
    rows = "SELECT p_partkey, p_brand, p_size, p_retailprice, CASE WHEN p_retailprice + p_size * 3 < 1000 THEN 'yes' ELSE 'no' END AS cheap FROM {part}"
    df = run_sql(spark, sf, f"{rows} UNION ALL {rows} WHERE p_partkey % 10 = 0")
    run = train(df, Settings(target="cheap", id_cols=["p_partkey"], max_trials=1, models=["logistic_regression"], shap=False), check=False)
    return report(run, spark)["summary"].where("item IN ('rows', 'duplicates', 'problem', 'target', 'model')")
