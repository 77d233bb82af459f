"""Turned texts beside plain cutting at the units, exact round trips, and chunks shared between texts."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import middle


def documents():
    rng = random.Random(13)
    signs = ["a", "Word", "longer", " ", "\n", "\x00", "é", "漢", "😀", "́", "<", "P>", "<S", ">", "1", "Zz"]
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 2, 7, 300, 4000])))) for i in range(300)]
    shared = "".join(rng.choice(signs[:9]) for _ in range(20_000))
    rows += [(1000 + i, "".join(rng.choice(signs[:9]) for _ in range(i * 37)) + shared) for i in range(8)]
    rows += [(2000 + i, ("a<P>b", "<S>", "x<M>", "a" * 50_000, "é" * 30_000, "ab" * 40_000 + "é", "", None)[i % 8]) for i in range(40)]
    return rows + [(None, "no id here"), (None, None), (7, rows[7][1]), (7, "another text"), (-3, "minus three")]


def brute(doc, text):
    units = re.findall("(?s)[A-Za-z]+|[^A-Za-z]", text or "")
    h1, h2, h3, h4 = middle.draws(doc)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, text, n, "plain", None, None
    one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:one]), "".join(units[one:two]), "".join(units[two:])
    if h4 % 100 < 20:
        return doc, f"<S>{c}<P>{a}<M>{b}", n, "spm", len(a), len(b)
    return doc, f"<P>{a}<S>{c}<M>{b}", n, "psm", len(a), len(b)


@pytest.mark.parametrize("step", [1 << 20, 1000])
def test_beside_plain_cutting(spark, monkeypatch, step):
    monkeypatch.setattr(middle, "STEP", step)
    rows = documents()
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id bigint, text string, form string, units int").repartition(3)
    got = middle.turned(df)
    assert got.columns == ["doc_id", "text", "units", "n", "form", "prefix_chars", "middle_chars"]
    assert sorted((tuple(r) for r in got.drop("units").collect()), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert {r["form"] for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    back = got.select("doc_id", middle.restored(F.col("text"), F.col("form")).alias("text"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_every_cut_of_a_text():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé漢 \n😀Z1") for _ in range(n)) for n in (0, 1, 5, 3000)] + ["a" * 20_000, "a" * 8191 + "é" + "b" * 300]
    memory = middle.Memory()
    found = middle.Texts(pa.array(texts), memory)
    for i, text in enumerate(texts):
        starts = [x.start() for x in re.finditer("(?s)[A-Za-z]+|[^A-Za-z]", text)] + [len(text)]
        assert found.n[i] == len(starts) - 1
        for k in range(0, len(starts), max(1, len(starts) // 500)):
            byte, points = found.place(i, k)
            assert points == starts[k] and byte - found.offsets[i] == len(text[: starts[k]].encode())
    assert found.place(3, int(found.n[3]))[1] == 3000


def test_shared_passages_are_counted_once(monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(10_000))
    memory = middle.Memory()
    middle.Texts(pa.array([" ".join(word() for _ in range(50 * i)) + shared for i in range(6)]), memory)
    assert memory.counted < 0.4 * memory.asked
    monkeypatch.setattr(middle, "REMEMBERED", 10)
    middle.Texts(pa.array([shared]), memory)
    assert memory.size == 0


def test_chunks_stay_within_their_bounds():
    data = np.frombuffer(b"x" * 100_000 + bytes(range(256)) * 300, np.uint8)
    cut = middle.chunks(middle.ends(data), 0, len(data))
    sizes = np.diff([0, *cut])
    assert cut[-1] == len(data) and sizes.max() <= middle.LONGEST and sizes[:-1].min() >= middle.SHORTEST


def test_empty_table_and_taken_names(spark):
    assert middle.turned(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    with pytest.raises(ValueError):
        middle.turned(spark.createDataFrame([(1, "x")], "n bigint, text string"), id_col="n")
