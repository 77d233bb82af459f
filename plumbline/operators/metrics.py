"""Scores of classifiers and regressors from (label, prediction, score) tables."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.operators.association import spearman
from plumbline.operators.ordering import bucketed, cumulate


#: A grid is drawn for at most so many labels; of more, the cells that are not empty.
GRID_LABELS = 500


def cells(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n) for the pairs that occur, of rows with both; there may be any number of labels."""
    both = df.select(quoted(label).alias("actual"), quoted(prediction).alias("predicted")).where("actual is not null and predicted is not null")
    return both.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n) over the full grid of labels seen on either side."""
    return grid(cells(df, label, prediction))


def grid(counts: DataFrame) -> DataFrame:
    """The cells of a plot with their zeros, as long as there are few enough labels to draw."""
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    some = [r["label"] for r in labels.limit(GRID_LABELS + 1).collect()]
    if len(some) > GRID_LABELS:
        return counts
    every = F.array(*[F.lit(x) for x in sorted(some)]) if some else F.array().cast(f"array<{dict(counts.dtypes)['actual']}>")
    one = counts.sparkSession.range(1).select(F.explode(every).alias("actual")).select("actual", F.explode(every).alias("predicted"))
    return one.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from cells or from a grid; 0 where a ratio has no base.

    Both sides are summed by class and met by a full outer join, so the work follows the cells that occur.
    """
    hits = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = matrix.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(hits).alias("hits"))
    cols = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    both = rows.join(cols, "class", "full").na.fill(0, ["support", "hits", "predicted"])
    p = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    return both.select(
        "class", p.alias("precision"), r.alias("recall"),
        F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), "support", "hits",
    )


def averages(report: DataFrame) -> DataFrame:
    """Accuracy plus macro and support-weighted averages, one row."""
    w = F.sum("support")
    weighted = [
        (F.sum(F.col(m) * F.col("support")) / w).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")
    ]
    macro = [F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")]
    return report.agg((F.sum("hits") / w).alias("accuracy"), *macro, *weighted, w.alias("rows"))


def confusion_insights(matrix: DataFrame, imbalanced: bool = False) -> DataFrame:
    """(finding, subject, value): worst class, false alarms and threshold advice."""
    missed = F.when(F.col("support") > 0, (F.col("support") - F.col("hits")) / F.col("support")).otherwise(0.0)
    rows = class_report(matrix).select(F.col("class").alias("actual"), missed.alias("rate"))
    worst = rows.agg(
        F.min_by(F.struct("actual", "rate"), F.struct(-F.col("rate"), F.col("actual"))).alias("w"),
        F.count(F.lit(1)).alias("classes"),
        F.min_by("rate", F.col("actual")).alias("alarm"),
    )
    binary = F.col("classes") == 2
    items = [
        F.struct(F.lit("worst_class").alias("finding"), F.col("w.actual").cast("string").alias("subject"), F.col("w.rate").alias("value")),
        F.when(binary, F.struct(F.lit("false_positive_rate").alias("finding"), F.lit("negatives").alias("subject"), F.col("alarm").alias("value"))),
        F.when(
            binary & (F.col("w.rate") > 0.3),
            F.struct(F.lit("lower_the_threshold").alias("finding"), F.col("w.actual").cast("string").alias("subject"), F.col("w.rate").alias("value")),
        ),
    ]
    if imbalanced:
        items.append(F.struct(F.lit("imbalanced_training").alias("finding"), F.lit("minority").alias("subject"), F.lit(None).cast("double").alias("value")))
    return worst.select(F.inline(F.array_compact(F.array(*items))))


def unit_scores(df: DataFrame, raw: str, name: str = "score") -> DataFrame:
    """Decision values stretched to 0..1 over the table."""
    lo, hi = df.agg(F.min(quoted(raw)), F.max(quoted(raw))).first()
    return df.withColumn(name, (quoted(raw) - F.lit(lo)) / (F.lit(hi) - F.lit(lo) + F.lit(1e-10)))


def roc_auc(df: DataFrame, positive: str, score: str) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when a side is empty.

    Scores are counted per distinct value, so each value is one row however often it occurs.
    """
    x = df.select(quoted(score).cast("double").alias("value"), quoted(positive).cast("int").alias("pos"))
    counts = bucketed(x, ["value"]).groupBy(F.col("value__b").alias("bucket"), "value").agg(
        F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg")
    ).withColumn("g", F.lit(1))
    ordered = cumulate(counts, ["g"], ["neg"])
    pos, neg = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ordered.agg(
        pos.alias("positives"), neg.alias("negatives"),
        F.when((pos > 0) & (neg > 0), area / (pos.cast("double") * neg)).alias("roc_auc"),
    )


def roc_auc_per_class(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """One-versus-rest area per class. ``scores`` maps a class to its score column.

    All classes are ranked in one long form, so the number of classes adds no stages.
    """
    classes = list(scores)
    wide = df.select(quoted(label).alias("label"), *[quoted(c).cast("double").alias(f"s{i}") for i, c in enumerate(scores.values())])
    wide = bucketed(wide, [f"s{i}" for i in range(len(classes))])
    cells = F.array(*[
        F.struct(
            F.lit(i).alias("g"), F.col(f"s{i}").alias("value"), F.col(f"s{i}__b").alias("bucket"),
            (F.col("label") == F.lit(c)).cast("int").alias("pos"),
        )
        for i, c in enumerate(classes)
    ])
    counts = wide.select(F.explode(cells).alias("c")).select("c.*").groupBy("g", "bucket", "value").agg(
        F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg")
    )
    names = F.array(*[F.lit(c) for c in classes])
    pos, neg = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return cumulate(counts, ["g"], ["neg"]).groupBy("g").agg(
        pos.alias("support"),
        F.when((pos > 0) & (neg > 0), area / (pos.cast("double") * neg)).alias("roc_auc"),
    ).select(F.element_at(names, F.col("g") + 1).alias("class"), "support", "roc_auc")


def weighted_auc(per_class: DataFrame) -> DataFrame:
    """Support-weighted mean of the class areas; null when any class has none."""
    missing = F.max(F.col("roc_auc").isNull().cast("int"))
    return per_class.agg(
        F.when(missing == 0, F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")).alias("roc_auc_weighted")
    )


def residuals(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.withColumn("residual", quoted(label) - quoted(prediction))


def regression_scores(df: DataFrame, label: str, prediction: str, n_features: int) -> DataFrame:
    """RMSE, MAE, R2, adjusted R2 and MAPE (percent), one row from one scan."""
    y, p = quoted(label).cast("double"), quoted(prediction).cast("double")
    e = y - p
    base = F.when(y == 0, F.lit(1e-10)).otherwise(y)
    out = df.agg(
        F.count(y).alias("rows"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
        (F.avg(F.abs(e / base)) * 100).alias("mape"),
    )
    n = F.col("rows")
    adjusted = 1 - F.try_divide((1 - F.col("r2")) * (n - 1), n - n_features - 1)
    return out.withColumn("adj_r2", F.when(n > n_features + 1, adjusted))


def heteroscedasticity(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Does the error grow with the prediction? Spearman of prediction and |residual|."""
    x = df.select(
        quoted(prediction).cast("double").alias("fitted"),
        F.abs(quoted(label).cast("double") - quoted(prediction)).alias("spread"),
    )
    rho = F.col("rho")
    t = rho * F.sqrt((F.col("rows") - 2) / F.greatest(1 - rho * rho, F.lit(1e-300)))
    out = spearman(x, ["fitted"], "spread").select("rows", "rho", t.alias("t"))
    # The flag needs |rho| > 0.3, and then p < 0.05 is a bound on t that depends on rows only.
    return out.withColumn("heteroscedastic", (F.abs("rho") > 0.3) & (F.abs("t") > critical_t(F.col("rows") - 2)))


def critical_t(dof):
    """Two-sided 5 % point of Student's t by its expansion around the normal point."""
    z = NormalDist().inv_cdf(0.975)
    d = F.greatest(dof.cast("double"), F.lit(1.0))
    return (
        F.lit(z) + (z**3 + z) / (4 * d) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * d * d)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * d * d * d)
    )


def ranking(importance: DataFrame) -> DataFrame:
    """Features by mean absolute attribution, five decimals, largest first."""
    return importance.select("feature", F.round("importance", 5).alias("importance")).orderBy(
        F.desc("importance"), "feature"
    )
