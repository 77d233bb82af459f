"""The recursions beside sums over all paths, counts beside plain counting, and held-out likelihood."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import hmm


def small(states=2, cells=3, seed=0):
    rng = np.random.default_rng(seed)
    emit = np.zeros((hmm.CELLS + 2, states))
    used = [5, 9, hmm.END_CELL][:cells]
    emit[used] = rng.dirichlet(np.ones(len(used)), states).T
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), emit, np.ones(hmm.CELLS + 2), 3, 3)


def paths(cells, m):
    for path in itertools.product(range(len(m.start)), repeat=len(cells)):
        p = m.start[path[0]] * m.emit[cells[0], path[0]]
        for a, b, c in zip(path, path[1:], cells[1:]):
            p *= m.move[a, b] * m.emit[c, b]
        yield path, p


def test_forward_is_the_sum_over_all_paths():
    m, rows = small(3), [[5, 9, 9, 5, hmm.END_CELL], [hmm.END_CELL], [9, hmm.END_CELL], [5] * 7]
    first = np.cumsum([0, *map(len, rows)])
    got = hmm.forward(np.concatenate([np.array(r) for r in rows]), first, m)
    assert np.allclose(got, [math.log(sum(p for _, p in paths(r, m))) for r in rows])


def test_long_texts_do_not_underflow():
    got = hmm.forward(np.full(50_000, 5), np.array([0, 50_000]), small())
    assert np.isfinite(got).all() and got[0] < -1000


def test_expected_counts_are_those_over_all_paths():
    m, rows = small(), [[5, 9, 5, hmm.END_CELL], [9, hmm.END_CELL], [hmm.END_CELL]]
    want = {"start": np.zeros(2), "move": np.zeros((2, 2)), "emit": np.zeros((hmm.CELLS + 2, 2))}
    for r in rows:
        total = sum(p for _, p in paths(r, m))
        for path, p in paths(r, m):
            want["start"][path[0]] += p / total
            for a, b in zip(path, path[1:]):
                want["move"][a, b] += p / total
            for c, s in zip(r, path):
                want["emit"][c, s] += p / total
    got = {k: np.zeros_like(v) for k, v in want.items()}
    hmm.expect(np.concatenate([np.array(r) for r in rows]), np.cumsum([0, *map(len, rows)]), m, got)
    assert all(np.allclose(got[k], want[k], atol=1e-4) for k in want)


def test_stretches_cover_every_token():
    at, length = hmm.stretches(np.array([0, 3, 3, 1503]), 512)
    assert sorted(zip(at.tolist(), length.tolist())) == [(0, 3), (3, 512), (515, 512), (1027, 476)]


def corpus():
    rng = random.Random(8)
    tongues = [[f"{c}{i}" for i in range(40)] for c in "xyz"]
    rows = [(d, " ".join(rng.choice(tongues[d % 3]) for _ in range(rng.choice([1, 8, 40, 700])))) for d in range(240)]
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "NEVER seen"), (5, rows[5][1]), (None, "x1 x2")]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 5 == 1


def test_counts_base_and_likelihood(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id bigint, text string, chunk int, token string").repartition(6)
    got = [r.asDict() for r in hmm.language_model(df, states=3).collect()]
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*(t or "").lower().split(), "</>"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        tokens = [*(t or "").lower().split(), "</>"]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        want.append((d, held(d), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 6)))
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=str) == sorted(want, key=str)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.3 * sum(r["n_tokens"] for r in out)
    assert all(r["score"] < 0 for r in got)


def test_probabilities_of_all_tokens_sum_to_one(spark):
    rows = [(d, t) for d, t in corpus() if d is not None][:60]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    m, vocabulary = hmm.train(df, 3, 1)
    table = {r["token"]: r["n"] for r in vocabulary.collect()}
    cells = hmm.cells_of(np.array(list(table), dtype=np.int64).view(np.uint64))
    each = m.emit[cells] * (np.array(list(table.values())) / m.cell_tokens[cells])[:, None]
    assert np.allclose(each.sum(axis=0) + m.emit[hmm.NEW_CELL], 1)
    assert np.allclose(m.move.sum(axis=1), 1) and np.isclose(m.start.sum(), 1)


def test_nothing_to_train_on(spark):
    alone = next(d for d in range(100) if held(d))
    got = hmm.language_model(spark.createDataFrame([(alone, "a b")], "doc_id bigint, text string")).collect()
    assert got[0]["train_tokens"] == 0 and got[0]["n_known"] == 0 and got[0]["score"] == pytest.approx(0)
    assert hmm.language_model(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_texts_start_once_in_training():
    cells = np.array([5, 9] * 700 + [hmm.END_CELL] + [9, hmm.END_CELL])
    out = {"start": np.zeros(2), "move": np.zeros((2, 2)), "emit": np.zeros((hmm.CELLS + 2, 2))}
    first = np.array([0, 1401, 1403])
    likelihood = hmm.expect(cells, first, small(), out)
    assert out["start"].sum() == pytest.approx(2, abs=1e-3) and out["move"].sum() == pytest.approx(1401, abs=0.1)
    assert likelihood == pytest.approx(hmm.forward(cells, first, small()).sum(), rel=1e-4)


def test_a_source_of_few_texts_has_its_state(spark):
    rng = random.Random(3)
    rows = [(d, " ".join(rng.choice([f"a{i}" for i in range(30)]) for _ in range(30))) for d in range(700)]
    rare = [(d, " ".join(rng.choice([f"z{i}" for i in range(30)]) for _ in range(400))) for d in range(1000, 1020)]
    ranked = spark.createDataFrame(rows + rare, "doc_id bigint, text string").selectExpr("doc_id", "xxhash64(doc_id, text) AS rank").orderBy("rank").collect()
    late = [r["doc_id"] for i, r in enumerate(ranked) if i >= 600 and r["doc_id"] >= 1000][:1]
    assert late  # beyond any prefix of 512 texts
    df = spark.createDataFrame(rows + [r for r in rare if r[0] in late], "doc_id bigint, text string")
    m, _ = hmm.train(df, 2)
    cell = hmm.cells_of(hmm.tokens_of(pa.array(["z1"]), hmm.Powers())[0])[0]
    assert m.emit[cell].max() > 10 * m.cell_tokens[cell] / m.tokens
