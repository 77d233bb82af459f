"""Links through counted collisions beside the cosine of all pairs."""

import math

import numpy as np
import pytest

from plumbline.llm import embeddings as e


def rows(n=700, size=24):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        x = rng.normal(size=size)
        if i % 3 and out:
            base = out[int(rng.integers(0, len(out)))]
            x = np.array(base[1]) / np.linalg.norm(base[1]) + rng.normal(size=size) * rng.choice([0.0, 0.03, 0.06, 0.08])
            x *= rng.choice([0.1, 1, 30])
        out.append((int(rng.permutation(10**6)[0]) + i * 10**6, [float(v) for v in x], int(rng.choice([1, 1, 1, 2, 3]))))
    out += [(1, None, 1), (2, [], 1), (3, [0.0] * size, 1), (4, [None] + [1.0] * (size - 1), 1), (5, [math.nan] * size, 1), (6, [math.inf] + [0.0] * (size - 1), 1)]
    out += [(7, out[5][1], None), (8, out[5][1], 99), (9, out[5][1][:9], out[5][2]), (10, [v * 1e200 for v in out[5][1]], out[5][2]), (11, [v * 1e-200 for v in out[5][1]], out[5][2]), out[6], out[6], (None, out[6][1], out[6][2])]
    return out


def brute(data):
    def fine(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and np.abs(v).max() > 0

    unit = [np.array(v) / np.abs(v).max() if fine(v, l) else None for _, v, l in data]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    near = [[j for j in range(len(data)) if j != i and unit[i] is not None and unit[j] is not None and data[i][2] == data[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.93] for i in range(len(data))]
    root = [None] * len(data)
    for i in range(len(data)):
        if root[i] is None:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [data[j][0] for j in seen if data[j][0] is not None]
            for j in seen:
                root[j] = (min(ids) if ids else None,)
    return sorted(((d[0], len(near[i]), root[i][0], d[0] == root[i][0]) for i, d in enumerate(data)), key=str)


@pytest.mark.parametrize("cell", [2048, 20])
def test_beside_all_pairs(spark, cell):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "s") for r in data], "vec_id bigint, embedding array<double>, label int, size int, class string").repartition(5)
    assert sorted((tuple(r) for r in e.near_vectors(df, cell=cell).collect()), key=str) == brute(data)


def test_a_crowded_bin_is_cut(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    data = [(i, (base + rng.normal(size=8) * 1e-6).tolist(), 1) for i in range(150)]
    got = e.near_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>, label int"), cell=10).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(149, 0)}


def test_recall_at_the_least_cosine():
    rng = np.random.default_rng(5)
    x = e.units(rng.normal(size=(3000, 64)))
    z = rng.normal(size=x.shape)
    z = e.units(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.9301 * x + math.sqrt(1 - 0.9301**2) * z
    turned = e.directions(64, e.PROJECTIONS)[:, 1:]
    count = (np.abs((x - y) @ turned) <= e.WINDOW * e.distance(0.93)).sum(axis=1)
    assert (count >= e.least_count()).mean() > 0.9999
    far = (np.abs((x[:-1] - x[1:]) @ turned) <= e.WINDOW * e.distance(0.93)).sum(axis=1)
    assert (far >= e.least_count()).mean() < 0.2


def test_empty_table(spark):
    assert e.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
