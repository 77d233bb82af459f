"""Copies beside a plain inversion of the Poisson distribution, and masses beside their targets."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing


def inverse(rate, u):
    k, term = 0, math.exp(-rate)
    below = term
    while below <= u and k < mixing.MOST:
        k += 1
        term *= rate / k
        below += term
    return k


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def rows():
    out = [(i, "w " * (i % 13 + 1), f"s{i % 3}" if i % 2 else "hot") for i in range(3000)]
    return out + [(5000, None, "void"), (5001, "", "void"), (5002, "x", None), (None, "no id", "s1"), (7, out[7][1], out[7][2]), (5003, "y" * 30_000, "one")]


@pytest.mark.parametrize("weights,total", [(None, None), ({"hot": 1, "s0": 3, "s1": 0.5, "one": 2.0}, 400_000.0)])
def test_beside_plain_inversion(spark, weights, total):
    df = spark.createDataFrame([(*r, 5, "p") for r in rows()], "doc_id bigint, text string, source string, copy int, mass string").repartition(6)
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(df, weights=weights, total=total).collect())
    mass = Counter()
    for _, t, s in rows():
        mass[s] += len(t or "")
    weight = {s: (weights.get(s, 0.0) if weights else m**mixing.FLATTEN) for s, m in mass.items()}
    whole = total or sum(mass.values())
    up = sum(w for s, w in weight.items() if mass[s])
    want = Counter()
    for d, t, s in rows():
        rate = weight[s] / up * whole / mass[s] if mass[s] else 1.0
        parts = max(1, math.ceil(rate / mixing.PART))
        key = str(d) if d is not None else "text " + hashlib.md5((t or "").encode()).hexdigest()
        want[(d, t, s)] += sum(inverse(rate / parts, unit(f"{mixing.SEED}|{key}|{j}")) for j in range(parts))
    assert got == Counter({k: v for k, v in want.items() if v})


def test_masses_come_near_their_targets(spark):
    df = spark.createDataFrame([r for r in rows() if r[2] in ("hot", "s0", "s1")], "doc_id bigint, text string, source string")
    out = mixing.mixed(df, weights={"hot": 1, "s0": 2, "s1": 40}, total=2_000_000)
    mass = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert mass["s0"] / mass["hot"] == pytest.approx(2, rel=0.1) and mass["s1"] / mass["hot"] == pytest.approx(40, rel=0.1)
    assert sum(mass.values()) == pytest.approx(2_000_000, rel=0.05)


def test_empty_table(spark):
    assert mixing.mixed(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
