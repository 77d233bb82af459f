"""Kept lines beside plain counting, and the minimal perfect hash beside a dictionary."""

import random
from collections import Counter

import numpy as np
import pytest

from plumbline.functions.columns import scratch
from plumbline.llm import lines

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents():
    rng = random.Random(12)
    usual = ["Home | About", "  home | ABOUT\t", "ÉTÉ", "été", "", " ", "漢字 line", "a\x00b", " nbsp ", "nbsp", "\x1cfs", "fs"] + [f"line {i}" for i in range(60)]
    rows = [(i, "\n".join(rng.choice(usual) + rng.choice(["", "", "\r", "!" * i]) for _ in range(rng.randint(1, 12)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "\n\n \n"), (None, "home | about\nonly here"), (None, None), (7, rows[7][1]), (504, "home | about"), (505, "x" * 300_000 + "\n" + "HOME | about\n" * 20_000)]
    return rows


def brute(rows, least):
    keys = [[x.strip(WHITE).translate(LOWER) for x in (t or "").split("\n")] for _, t in rows]
    found = Counter(k for own in keys for k in set(own) if k)
    out = []
    for (i, t), own in zip(rows, keys):
        goes = [found[k] >= least if k else False for k in own]
        kept = "\n".join(x for x, g in zip((t or "").split("\n"), goes) if not g)
        out.append((i, None if t is None else kept, len(own), sum(goes), max([found[k] for k, g in zip(own, goes) if g], default=0)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,shard_keys", [(10, 1 << 19), (10, 3), (2, 7), (10**6, 5), (1, 1)])
def test_beside_plain_counting(spark, least, shard_keys):
    rows = documents()
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id bigint, text string, n string, n_lines int").repartition(4)
    index = lines.build(df, scratch(spark, "lines-test"), least=least, shard_keys=shard_keys)
    got = lines.without_repeats(df, index)
    assert got.columns == ["doc_id", "text", "n", "n_lines", "n_dropped", "max_docs"]
    assert sorted((tuple(r) for r in got.drop("n").collect()), key=str) == brute(rows, least)


def test_a_higher_count_from_the_same_index(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = lines.build(df, scratch(spark, "lines-test"), least=3)
    got = lines.without_repeats(df, index, min_docs=30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 30)
    with pytest.raises(ValueError):
        lines.without_repeats(df, index, min_docs=2)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 50_000])
def test_perfect_and_minimal(n):
    rng = np.random.default_rng(n)
    high, low = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64)
    if n > 2:
        high[1] = high[0]  # two lines may share one half of their hash
        low[2] = low[0]
    counts = rng.integers(10, 70_000, n)
    shard = lines.Shard.of(lines.Shard.build(high, low, counts).row())
    assert sorted(shard.numbers(high, low).tolist()) == list(range(n))
    assert shard.probe(high, low).tolist() == counts.tolist()
    strange = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    assert not shard.probe(*strange).any() and not shard.probe(high, low ^ np.uint64(1)).any()
    assert n < 1000 or 8 * (shard.bits.nbytes + shard.before.nbytes) < 8 * n


def test_shelf_keeps_within_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHELF_BYTES", 300)
    monkeypatch.setattr(lines, "HELD", 20)
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    index = lines.build(df, scratch(spark, "lines-test"), least=2, shard_keys=5)
    shelf = lines.Shelf(index)
    for s in range(index.shards):
        shelf.shard(s)
    assert len(shelf.held) < index.shards and shelf.size <= 300
    assert sorted((tuple(r) for r in lines.without_repeats(df, index).collect()), key=str) == brute(rows, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert lines.without_repeats(df, lines.build(df, scratch(spark, "lines-test"))).count() == 0
