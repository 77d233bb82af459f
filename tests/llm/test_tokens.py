"""Ids beside the library's own, and the coder by exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plumbline.functions.columns import scratch
from plumbline.llm import tokens as k

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(2)
    signs = ["a", "Word", " ", "  ", "\n", "\t", "\x0b", "É", "é", "é", "́", "漢", " ", " ", "ß", "İ", "Σ", "'s", "12", "<|endoftext|>", "!!", "\x1c", "😀", "\x00"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(500)] + [None, "", " ", "long " * 50_000]


def test_ids_are_those_of_the_whole_text():
    ids, sizes = k.Encoder(PATH, 1).encode(pa.array(texts()))
    library = Tokenizer.from_file(PATH)
    at = 0
    for text, n in zip(texts(), sizes):
        assert ids[at : at + n].tolist() == library.encode(text or "", add_special_tokens=False).ids + [1]
        at += n
    assert at == len(ids)


def test_ids_of_pieces_at_the_edges_of_slots_and_cuts():
    """Words of 14 to 17 bytes, capitals, punctuation after letters, control strings in either case, met twice."""
    rng = random.Random(3)
    pieces = [s * n for s in ("x", "X", "é", "\x00") for n in (7, 8, 14, 15, 16, 17)] + [
        "word,", "WORD,", "Éa..", "a×,", "÷,", "a—,", "can't,", "'S", "a1,", "<|endoftext|>", "<|ENDOFTEXT|>", "ab<|endoftext|>,", "a|,", "é́,", "漢,", "x\x01,",
    ]
    rows = [rng.choice(["", " ", "\n"]).join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(2000)]
    encoder, library = k.Encoder(PATH, 1), Tokenizer.from_file(PATH)
    want = [i for r in rows for i in [*library.encode(r, add_special_tokens=False).ids, 1]]
    for _ in range(2):
        ids, sizes = encoder.encode(pa.array(rows))
        assert ids.tolist() == want and int(sizes.sum()) == len(want)


def test_a_tokenizer_that_keeps_white_space_is_refused():
    with pytest.raises(ValueError, match="white space"):
        k.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 1)


@pytest.mark.parametrize("sizes", [[0], [1], [31, 32, 33], [k.CHECKPOINT * k.LANES + 1, k.BLOCK, 5]])
def test_round_trip(sizes):
    rng = np.random.default_rng(1)
    blocks = [np.minimum(rng.zipf(1.3, n), 49_000).astype(np.uint32) for n in sizes]
    every = np.concatenate(blocks)
    values, counts = np.unique(every, return_counts=True)
    table = k.Table(k.scaled(dict(zip(values.tolist(), counts.tolist()))))
    coded = k.code(blocks, table)
    back = k.decode([(len(b), w, c) for b, (w, c) in zip(blocks, coded)], table)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))


def test_frequencies_add_up():
    for counts in ({}, {5: 1}, {i: 1 for i in range(50_000)}, {1: 10**12, 2: 1, 7: 3}):
        f = k.scaled(counts)
        assert sum(f.values()) == 1 << k.SCALE_BITS and min(f.values()) >= 1 and set(counts) <= set(f)


def test_checksums_join():
    joined = k.Joined()
    for n in (0, 1, 7, 1000, 70_000):
        a, b = b"some bytes", bytes(i % 251 for i in range(n))
        assert joined.join(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


def brute(rows):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_beside_the_library(spark, monkeypatch):
    monkeypatch.setattr(k, "BLOCK", 1 << 10)
    rows = [(7 * i - 5, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id bigint, text string, ids string, part int").repartition(5)
    path = scratch(spark, "files")
    k.write(df, path, PATH)
    assert sorted(tuple(r) for r in k.summary(k.read(spark, path)).collect()) == brute(rows)
    damaged = spark.read.parquet(f"{path}/blocks").selectExpr("part", "block", "n", "crc32 + 1 AS crc32", "words", "checkpoints", "documents")
    other = scratch(spark, "files")
    damaged.write.parquet(f"{other}/blocks")
    for t in ("table", "parts"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{other}/{t}")
    with pytest.raises(Exception, match="damaged"):
        k.read(spark, other).count()


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (2, None)]
    path = scratch(spark, "files")
    k.write(spark.createDataFrame(rows, "doc_id bigint, text string"), path, PATH)
    got = sorted((tuple(r) for r in k.summary(k.read(spark, path)).collect()), key=lambda r: r[1])
    assert [(r[0], r[2]) for r in got] in ([(None, 2), (1, 3), (1, 3), (1, 2), (2, 1)], [(None, 2), (1, 2), (1, 3), (1, 3), (2, 1)])
    path = scratch(spark, "files")
    k.write(spark.createDataFrame([], "doc_id bigint, text string"), path, PATH)
    assert k.summary(k.read(spark, path)).count() == 0
