"""Windows found by shifting beside windows found by looking everywhere."""

import hashlib
import random
import re

import numpy as np
import pytest

from plumbline.llm.contamination import contamination, occurrences, item_patterns
from plumbline.llm.words import ALPHANUMERIC, words_of
import pyarrow as pa

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


def brute(docs, items, size=10):
    out = []
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for i, x in items:
            p = words(x) if i is not None else []
            n = min(size, len(p))
            windows = {tuple(p[a : a + n]) for a in range(len(p) - n + 1)} if n else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    met.add(str(i))
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "Aß", "of", "x1", "漢字"])
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(word() for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 9, 10, 11, 14]))) for i in range(6, 20)] + [(6, text(12)), (30, None), (None, text(12)), (31, "  .. ")]
    docs = [(d, text(rng.choice([0, 1, 5, 9, 10, 12, 60, 400]))) for d in range(60)]
    docs += [(100, "zz " * 3000 + items[8][1] + " yy" * 3000), (101, None), (102, ""), (103, "é" * 5000), (None, items[9][1]), (5, docs[5][1]), (104, items[10][1] + "Q")]
    return docs, items


@pytest.mark.parametrize("item_bytes", [1 << 20, 60])
def test_beside_brute_force(spark, item_bytes):
    docs, items = cases()
    long_only = [(i, x) for i, x in items if len(words(x)) >= 9 or i is None]
    for chosen in (items, long_only):
        d = spark.createDataFrame([(*r, 0, "s") for r in docs], "doc_id bigint, text string, n_words int, spans string")
        i = spark.createDataFrame(chosen, "item_id bigint, text string")
        got = contamination(d, i, item_bytes=item_bytes).drop("spans", "items").collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(docs, chosen)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string")
    assert [tuple(r)[:4] for r in contamination(d, i).collect()] == [(1, 2, 0, 0)]
    assert contamination(d.limit(0), i).count() == 0


def test_the_search_skips_words():
    item = " ".join(f"w{i}" for i in range(10))
    p = item_patterns([("1", item)], 10)[0]
    assert (p.shift == 9).sum() >= (1 << 20) - 10 and p.shift.min() == 0
    text = words_of(pa.array(["x " * 5000 + item + " y" * 7000]), ALPHANUMERIC)
    start, which = occurrences(text.hashes, text.first, p)
    assert start.tolist() == [5000] and which.tolist() == [0]
    assert np.diff(text.first)[0] == 12010
