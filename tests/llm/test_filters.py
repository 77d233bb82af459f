"""Every order of the filters beside running it, and positional sums beside plain counting."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from plumbline.llm import filters


def documents():
    rng = random.Random(11)
    words = ["a", "b", "été", "the", "Loud", "SHOUT", "100%", "漢字", "x|y"] + [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([5, 9, 309])]) for _ in range(rng.choice([3, 150, 199, 200, 260]))), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(1000 + i, rows[i % 3][1], "en") for i in range(40)] + [(-5, rows[7][1], "de"), (3, rows[3][1], "en"), (None, rows[4][1], "fr"), (None, "alone", None)]
    return rows + [(2000, None, "de"), (2001, "", "de"), (2002, " \t\n\x0b\x0c\r ", "en"), (2003, "\x1c \x85  ", "en"), (2004, "A" * 400_000, "en"), (2005, "many words " * 60_000, "fr")]


def brute(docs, labels, letters="ABCDE"):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, p in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        own = [x for x in labels if x[0] == i and i is not None]
        rows.append((p or "", {x for x in letters if bad[x]}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = []
    for part in {r[0] for r in rows}:
        mine, steps = [r for r in rows if r[0] == part], []
        for order in permutations(letters):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                fails = [r for r in mine if x in r[1]]
                steps.append((part, "".join(order), step, len(left), len(gone), len(fails) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*s, sum(t[4] for t in steps if t[1][t[2] - 1] == s[1][s[2] - 1])) for s in steps]
    return sorted(out)


LABELS = [(i, i % 3 % 2, int(i % 4 == 0)) for i in range(0, 150, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1), (1001, 1, None), (99_999, 1, 1)]
SCHEMA = "doc_id bigint, text string, lang string, failed string, part int, high double"


def test_beside_running_every_order(spark):
    docs = documents()
    df = spark.createDataFrame([(*d, "x", 1, 0.5) for d in docs], SCHEMA).repartition(5)
    labels = spark.createDataFrame([(*x, 7) for x in LABELS], "doc_id bigint, quality int, toxic int, part int")
    got = filters.report(filters.survivors(filters.failures(df, labels)))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes[3:]} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == brute(docs, LABELS)


def test_three_filters(spark):
    rows = [("p", m, m % 2 == 0, m == 3) for m in (0, 1, 1, 2, 3, 3, 5, 7)]
    df = spark.createDataFrame(rows, "part string, failed int, good boolean, toxic boolean")
    got = {(r["filter_order"], r["step"]): r for r in filters.report(filters.survivors(df, 3), "XYZ").collect()}
    assert len(got) == 18 and got["YXZ", 1]["removed"] == 4 and got["YXZ", 2]["removed"] == 3 and got["YXZ", 2]["redundant"] == 3
    assert got["ZYX", 3]["kept"] == 1 and sum(got[o, 1 + o.index("X")]["removed"] for o in map("".join, permutations("XYZ"))) == got["XYZ", 1]["shapley"]


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 26, 1000, 12_345])
def test_positional_sums(n):
    words = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    assert filters.popcounts(words).tolist() == [int((words >> np.uint32(b) & np.uint32(1)).sum()) for b in range(32)]
    assert (filters.popcounts(np.full(n, 0xFFFFFFFF, np.uint32)) == n).all()


def test_many_parts_are_sent_on(spark, monkeypatch):
    monkeypatch.setattr(filters, "PARTS_HELD", 3)
    df = spark.range(2000).selectExpr("cast(id % 50 as string) AS part", "cast(id % 32 as int) AS failed", "true AS good", "false AS toxic")
    got = filters.survivors(df).collect()
    assert len(got) == 50 and all(r["n"][0] == 40 and r["good"] == r["n"] and sum(r["toxic"]) == 0 for r in got)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filters.report(filters.survivors(filters.failures(empty, labels))).count() == 0
    one = spark.createDataFrame([(1, "x", None)], "doc_id bigint, text string, lang string")
    assert filters.report(filters.survivors(filters.failures(one, labels))).count() == 600
