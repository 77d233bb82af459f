"""Quality of texts: n-gram indicators scaled by class log-count ratios, weighed by a linear model of
hinge loss that dual coordinate descent fits, and put on the scale of a probability.

Features are words, pairs of words, and runs of one to three word patterns (letters, capitals,
digits and signs, and whether the word repeats the one before), hashed into a fixed number of
places. Counts by class cover all labelled rows; the weights are fitted to a bounded sample of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import picked, stored
from plumbline.llm.words import SPACED, Powers, grams, mix, slices, words_of

FEATURE_BITS = 18
FEATURES = 1 << FEATURE_BITS
#: The weights are fitted to about so many labelled rows, chosen by the hash of their id.
FIT_ROWS = 6000
THRESHOLD = 0.3
#: Up to so many labels (some 40 MB) go to every task; more of them meet the texts by a shuffle.
BROADCAST_LABELS = 1_000_000
EPOCHS = 15
FOLDS = 3
PENALTY = 1.0
SMOOTHING = 1.0


def features(texts, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of all rows, each feature of a row once, in order of row and feature."""
    found = words_of(texts, SPACED, shapes=True, powers=powers)
    n = len(found.hashes)
    row = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    with np.errstate(over="ignore"):
        again = np.zeros(n, dtype=np.uint64)
        again[1:] = (found.hashes[1:] == found.hashes[:-1]) & (row[1:] == row[:-1])
        pattern = mix(found.shapes + again * np.uint64(0x9E3779B97F4A7C15))
        keys = []  # a batch's features; a few MB of text make some 100 MB of them
        for kind, (values, size) in enumerate([(found.hashes, 1), (found.hashes, 2), (pattern, 1), (pattern, 2), (pattern, 3)]):
            place = (mix(grams(values, size) + np.uint64(kind)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
            whole = row[: len(place)] == row[size - 1 :][: len(place)]
            keys.append((row[: len(place)][whole] << FEATURE_BITS) | place[whole])
    key = np.unique(np.concatenate(keys))
    return key >> FEATURE_BITS, key & (FEATURES - 1)


@dataclass
class Model:
    """weight and ratio by feature; probability = 1 / (1 + exp(-(slope * margin + offset)))."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, row: np.ndarray, feature: np.ndarray, rows: int) -> np.ndarray:
        return probability(margins(row, feature, rows, self.ratio, self.weight, self.bias), self.slope, self.offset)


def probability(margin: np.ndarray, slope: float, offset: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500)))


def margins(row, feature, rows, ratio, weight, bias) -> np.ndarray:
    """A row's scaled indicators have length one; a row without features has the bias alone."""
    length = np.sqrt(np.bincount(row, weights=ratio[feature] ** 2, minlength=rows))
    total = np.bincount(row, weights=(ratio * weight)[feature], minlength=rows)
    return total / np.where(length > 0, length, 1) + bias


def log_count_ratio(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    p, q = good + SMOOTHING, bad + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of least ||w||^2 / 2 + PENALTY * sum of hinge losses, by its dual, one row at a time.

    ``rows`` are (features, values); the bias is the weight of one more feature that is 1 everywhere.
    """
    w, bias = np.zeros(FEATURES), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i]
            gradient = sign[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), PENALTY)
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                worst = max(worst, abs(new - alpha[i]))
                w[f] += step * v
                bias += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def calibrate(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, label), by Newton's method, targets
    softened as Platt does. The slope is kept above zero."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    slope, offset = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = probability(margin, slope, offset)
        g = np.array([((p - target) * margin).sum() + 1e-3 * slope, (p - target).sum()])
        d = p * (1 - p)
        h = np.array([[(d * margin**2).sum() + 1e-3, (d * margin).sum()], [(d * margin).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        size = min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        slope, offset = slope - size * step[0], offset - size * step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(slope), 1e-3), float(offset)


def fitted(texts, good: np.ndarray, ratio: np.ndarray) -> Model:
    """The model of these rows; margins for the curve come from models that did not see their row."""
    if good.all() or not good.any():
        # One label only: its smoothed share, whatever the text.
        share = (good.sum() + 1) / (len(good) + 2)
        return Model(ratio, np.zeros(FEATURES), 0.0, 1e-3, float(np.log(share / (1 - share))))
    rows, powers = [], Powers()
    for part in slices([pa.RecordBatch.from_arrays([texts], names=["text"])], most=1 << 20):
        row, feature = features(part.column("text"), powers)
        cut = np.searchsorted(row, np.arange(part.num_rows + 1))
        for a, b in zip(cut[:-1], cut[1:]):
            value = ratio[feature[a:b]].astype(np.float32)
            length = float(np.sqrt(value @ value))
            rows.append((feature[a:b].astype(np.int32), value / np.float32(length if length else 1.0)))
    sign = np.where(good, 1.0, -1.0)
    margin = np.zeros(len(rows))
    for k in range(FOLDS):
        mine = np.arange(len(rows)) % FOLDS == k
        inside = np.flatnonzero(~mine)
        w, bias = descend([rows[i] for i in inside], sign[inside])
        margin[mine] = [float(w[rows[i][0]] @ rows[i][1]) + bias for i in np.flatnonzero(mine)]
    slope, offset = calibrate(margin, good)
    return Model(ratio, *descend(rows, sign), slope, offset)


def _counts(batches) -> Iterator[pa.RecordBatch]:
    powers, total = Powers(), np.zeros((2, FEATURES), dtype=np.int64)
    for batch in slices(batches, most=2 << 20):
        label = batch.column("label").to_numpy()
        row, feature = features(batch.column("text"), powers)
        for k in (0, 1):
            total[k] += np.bincount(feature[label[row] == k], minlength=FEATURES)
    some = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[0, some]), pa.array(total[1, some])], names=["feature", "bad", "good"])


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of rows (doc_id, text, label 0 or 1). Without any row every text scores one half."""
    spark = labelled.sparkSession
    bad, good = np.zeros(FEATURES), np.zeros(FEATURES)
    counts = labelled.mapInArrow(_counts, "feature int, bad bigint, good bigint").groupBy("feature").agg(F.sum("bad"), F.sum("good"))
    for place, b, g in counts.collect():  # at most FEATURES rows
        bad[place], good[place] = b, g
    ratio = log_count_ratio(good, bad)
    rows = labelled.count()
    if not rows:
        return Model(ratio, np.zeros(FEATURES), 0.0, 1e-3, 0.0)
    kept = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(min(1.0, fit_rows / rows) * 1_000_000)
    shared = spark.sparkContext.broadcast(ratio)

    def fit(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        order = sorted(range(table.num_rows), key=list(zip(table.column("rank").to_pylist(), table.column("text").to_pylist())).__getitem__)
        table = table.take(order)
        m = fitted(table.column("text").combine_chunks(), table.column("label").to_numpy() == 1, shared.value)
        some = np.flatnonzero(m.weight)
        place = np.concatenate([some, [-1, -2, -3]])
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(np.concatenate([m.weight[some], [m.bias, m.slope, m.offset]]))], names=["place", "value"])

    # The bounded sample comes into one task.
    sample = labelled.where(kept).select(F.xxhash64("doc_id").alias("rank"), F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    found = {r["place"]: r["value"] for r in sample.repartition(1).mapInArrow(fit, "place int, value double").collect()}
    if not found:
        return Model(ratio, np.zeros(FEATURES), 0.0, 1e-3, 0.0)
    weight = np.zeros(FEATURES)
    bias, slope, offset = (found.pop(k) for k in (-1, -2, -3))
    weight[list(found)] = list(found.values())
    return Model(ratio, weight, bias, slope, offset)


def apply(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """The given columns, and the score (0 to 1) under a name that ``docs`` does not have."""
    from pyspark.sql import types as T

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        powers = Powers()
        for batch in slices(batches, text_col, 2 << 20):
            row, feature = features(batch.column(text_col), powers)
            score = shared.value.score(row, feature, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, T.DoubleType())]))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """(doc_id, text, label) of the rows whose crc32(id as text) mod 5 is not 0. A label other than 0 or 1, or
    a null one, or one without id, teaches nothing; an id with both labels counts for both."""
    wanted = picked(labels, {"doc_id": id_col, "label": label_col}).where("label IN (0, 1) AND doc_id IS NOT NULL").distinct()
    texts = picked(docs, {"doc_id": id_col, "text": text_col}, {"text": "string"})
    wanted = stored(wanted, "quality-labels")
    if wanted.count() <= BROADCAST_LABELS:
        wanted = F.broadcast(wanted)
    return texts.join(wanted, "doc_id").where(~held_out(F.col("doc_id"))).select("doc_id", "text", F.col("label").cast("int").alias("label"))


def held_out(doc_id):
    """Rows without id are never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. Null and empty texts have no features and
    get the score of the bias alone; repeated rows are all scored."""
    model = train(labelled_rows(docs, labels, id_col, text_col, label_col), fit_rows)
    texts = picked(docs, {"doc_id": id_col, "text": text_col}, {"text": "string"})
    scored = apply(texts, model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality(spark, sf: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels)
