"""Links found through segments beside links between all pairs."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import jaccard as j
from plumbline.llm.common import components


def brute(docs, n, share):
    sets = []
    for d, t in docs:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * 100 >= round(share * 100) * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    names = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            names[find(i)] = min(d, names.get(find(i), d))
    return sorted(((d, len(s), names.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def corpus():
    rng = random.Random(3)
    docs = []
    for k in range(40):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 9, 12, 20, 45, 100, 260]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
            docs.append((len(docs) * 3 % 211 + 1000, rng.choice([" ", "\n"]).join(own).title()))
    docs += [(1, None), (2, ""), (3, "   "), (None, "a b c d"), (5, "A b c d"), docs[4], docs[4], (None, "only one of its kind here"), (6, "é " * 4000)]
    return docs


@pytest.mark.parametrize("n,share,tile", [(3, 0.9, 256), (5, 0.8, 2), (3, 0.8, 256)])
def test_beside_all_pairs(spark, n, share, tile):
    docs = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, class string, entry int").repartition(7)
    got = j.near_groups(df, n, share, tile_sets=tile).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, n, share)


def test_empty_table(spark):
    assert j.near_groups(spark.createDataFrame([], "doc_id bigint, text string"), 3, 0.9).count() == 0


@pytest.mark.parametrize("share", [Fraction(8, 10), Fraction(9, 10)])
def test_no_pair_within_the_difference_is_missed(share):
    rng = np.random.default_rng(9)
    used = set()
    for sets in (10, 10**5, 10**9):
        plan = j.schemes({b: sets for b in range(20)}, share)
        for _ in range(400):
            size = int(rng.integers(4, 400))
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            most = j.largest_difference(len(a), len(a), share)
            gone = int(rng.integers(0, min(most, len(a) - 1) + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, max(0, most - gone), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both < share * (len(a) + len(b) - both):
                continue
            small, large = sorted((a, b), key=len)
            scheme = plan.get(j.band_of(len(large)))
            if len(small) == len(large) == both:
                continue
            assert scheme and len(small) >= scheme.reach and j.band_of(len(small)) in (scheme.number, scheme.number - 1)
            assert len(np.intersect1d(j.signatures(small, scheme), j.signatures(large, scheme)))
            used.add((scheme.near > 0, scheme.spare > 0))
    assert {x for x, _ in used} == {True, False} and len(used) >= 3


@pytest.mark.parametrize("share", [Fraction(8, 10), Fraction(9, 10)])
def test_sketches_lose_no_link(share):
    rng = np.random.default_rng(5)
    sets = []
    for size in (1, 2, 5, 40, 63, 64, 65, 130, 700, 3000):
        base = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        sets.append(base)
        for part in (0.01, 0.05, 0.1, 0.19, 0.3, 0.6):
            other = rng.integers(0, 2**63, int(size * part) + 1, dtype=np.uint64)
            sets += [np.unique(np.concatenate([base, other])), np.unique(np.concatenate([base[len(other) // 2 :], other[: len(other) // 2]]))]
    sets = [s for s in sets if len(s)]
    sizes = np.array([len(s) for s in sets])
    group = list(range(len(sets)))
    for a, b in j.alike([j.parity(s) for s in sets], sizes, share):
        group = [group[a] if g == group[b] else g for g in group]
    linked = 0
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= share * (len(sets[a]) + len(sets[b]) - both):
                assert group[a] == group[b]
                linked += 1
    assert linked > 20


def test_sketches_keep_strangers_apart():
    rng = np.random.default_rng(6)
    passage = rng.integers(0, 2**63, 46, dtype=np.uint64)
    sets = [np.unique(np.concatenate([passage, rng.integers(0, 2**63, 260, dtype=np.uint64)])) for _ in range(60)]
    assert not j.alike([j.parity(s) for s in sets], np.array([len(s) for s in sets]), Fraction(8, 10))


def test_marks_keep_every_number(spark):
    numbers = [0, 63, 64, 2**23, 2**48 - 1, 12345678901234]
    marks = j.marked(spark.createDataFrame([(n,) for n in numbers], "number bigint"))
    assert all(marks[n % j.MARKS // 64] >> (n % 64) & 1 for n in numbers)
    assert not marks[1000] and not j.marked(spark.createDataFrame([], "number bigint")).any()


def test_small_tiles_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(j, "TILE_SKETCHES", 2)
    docs = corpus()
    got = j.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string"), 5, 0.8).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 5, 0.8)


@pytest.mark.parametrize("many,paired,blocked", [(1, 1, 1), (2, 2, 4), (64, 1, 100)])
def test_every_kind_of_meeting_loses_nothing(spark, monkeypatch, many, paired, blocked):
    for name, value in (("MANY", many), ("PAIRED", paired), ("BLOCKED", blocked)):
        monkeypatch.setattr(j, name, value)
    docs = corpus()
    got = j.near_groups(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), 5, 0.8).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, 5, 0.8)


def test_strangers_who_meet_one_after_the_other_are_no_block():
    of = {k: [k, k + 1] for k in range(40)} | {100: list(range(200, 220)), 200: list(range(300, 330)), 300: [400, 401], 400: [500], 500: [600, 601]}
    rows = [(e, a, a if a == 400 else None) for e, members in of.items() for a in sorted(members * (2 if e % 200 == 100 else 1))] + [(500, 601, 600)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 7])], names=["entry", "a", "b"]) for i in range(0, len(rows), 7)]
    got = {(r["a"], r["b"], r["kind"]) for b in j._met(iter(batches), 16, 25) for r in b.to_pylist()}
    want = {(k, k + 1, j.PAIR) for k in [*range(40), 600]} | {(a, 100, j.BLOCK) for a in range(200, 220)}
    assert got == want | {(300, a, j.LINK) for a in range(301, 330)} | {(400, 401, j.LINK), (601, 600, j.LINK)}


def test_components_of_paths_and_stars(spark):
    rows = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(40)] + [(5000, 5000), (7, 3)]
    got = components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()
    by = {}
    for r in got:
        by.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, by.values())) == [list(range(61)), list(range(1000, 1040))]
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_representatives_by_group_and_id(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(30))
    rows = [(7, text("a")), (7, text("b")), (9, text("b")), (None, text("c")), (None, text("c") + " more"), (3, text("d")), (None, text("d")), (None, text("d") + " more"), (4, ""), (5, None)]
    got = j.representatives(spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, rep int"), 3, 0.8).collect()
    found = sorted(((r["doc_id"], (r["text"] or "")[:1]) for r in got), key=str)
    assert found == sorted([(7, "a"), (7, "b"), (None, "c"), (3, "d"), (4, ""), (5, "")], key=str)


def test_low_similarity_beside_all_pairs(spark):
    rng = random.Random(5)
    docs = [(0, " ".join(f"w{i}" for i in range(10))), (1, " ".join(f"w{i}" for i in range(20)))]
    for k in range(12):
        words = [f"{k}x{i}" for i in range(rng.randint(12, 60))]
        docs += [(10 * k + 2 + i, " ".join(words[: rng.randint(len(words) * 2 // 5, len(words))])) for i in range(4)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in j.near_groups(df, 1, 0.5).collect()), key=str)
    assert got == brute(docs, 1, 0.5) and (1, 20, 0) in got
