"""Features and weights beside plain versions, and accuracy on rows no label of which was seen."""

import random

import numpy as np
import pyarrow as pa

from plumbline.llm import quality as q


def test_features_are_sets_within_rows():
    row, feature = q.features(pa.array(["a b a b", None, "a b", "", "b"]), q.Powers())
    sets = [set(feature[row == i].tolist()) for i in range(5)]
    assert sets[1] == sets[3] == set() and sets[2] <= sets[0] and len(row) == sum(map(len, sets))
    assert sets[4] <= sets[0] and len(sets[2]) == 5


def test_dual_descent_reaches_the_hinge_optimum(monkeypatch):
    monkeypatch.setattr(q, "EPOCHS", 2000)
    rng = np.random.default_rng(0)
    rows = [(np.array([0, 1]), rng.normal(size=2)) for _ in range(60)]
    sign = np.where(np.array([v[0] + 0.3 * rng.normal() for _, v in rows]) > 0, 1.0, -1.0)
    w, bias = q.descend(rows, sign)

    def loss(a, b, c):
        return (a * a + b * b + c * c) / 2 + sum(max(0, 1 - s * (a * v[0] + b * v[1] + c)) for (_, v), s in zip(rows, sign))

    best = loss(w[0], w[1], bias)
    for _ in range(400):
        d = rng.normal(scale=0.05, size=3)
        assert best <= loss(w[0] + d[0], w[1] + d[1], bias + d[2]) + 0.02


def corpus(n=600):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for d in range(n):
        words = [word() for _ in range(rng.randint(3, 60))]
        good = d % 7 != 0
        if not good:
            words = rng.choice([[w + "!!" for w in words], [words[0]] * 9 + words, [w.upper() + " |" for w in words]])
        docs.append((d, " ".join(words)))
        labels.append((d, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "long " * 20_000), (None, "no id"), docs[3]]
    d = spark.createDataFrame([(*r, 1.0, 3) for r in docs + extra], "doc_id bigint, text string, score double, label int").repartition(5)
    l = spark.createDataFrame([*labels, (None, 1), (9001, None), (9002, 7)], "doc_id bigint, quality int")
    got = q.quality(d, l).collect()
    assert len(got) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 60
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_one_label_no_label_no_rows(spark):
    docs, labels = corpus(40)
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    l = spark.createDataFrame(labels, "doc_id bigint, quality int")
    assert {r["predicted"] for r in q.quality(d, l.where("quality = 1")).collect()} == {1}
    assert {r["score"] for r in q.quality(d, l.limit(0)).collect()} == {0.5}
    assert q.quality(d.limit(0), l).count() == 0
