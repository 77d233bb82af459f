"""How filters interact: every order of up to five filters, from one 32-bit word a document.

A document fails some of the filters. Bit ``s`` of its word says whether it survives the set ``s`` of filters (its
letters as bits), so a table of one word for each set of failed filters gives a document's word. Tasks add the words of
a part up bit by bit, with carry-save adders over whole arrays, and the 32 sums of a part tell how many documents
each set of filters leaves. What any order of filters keeps and removes at any step follows from these sums.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import picked, stored

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SIGNS = re.compile(rb"[#$%&*|]")
NOT_CAPITALS = bytes(set(range(256)) - set(range(65, 91)))
CONTINUED = bytes(range(0x80, 0xC0))
#: Parts whose sums a task holds before it sends them on.
PARTS_HELD = 4096
SUMS = "part string, subset int, n bigint, good bigint, toxic bigint"


def failed(raw: bytes) -> int:
    """Filters A to D that a text in UTF-8 fails, as bits. bytes.split cuts at the six ASCII white spaces only."""
    words = raw.split()
    n = len(words)
    few = n < LEAST_WORDS
    dull = 100 * len(set(words)) < LEAST_DISTINCT * n
    loud = 100 * len(raw.translate(None, NOT_CAPITALS)) > MOST_CAPITALS * len(raw.translate(None, CONTINUED))
    return few | dull << 1 | loud << 2 | (SIGNS.search(raw) is not None) << 3


def failures(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", part_col="lang") -> DataFrame:
    """(part, failed, good, toxic): a row for each document, ``failed`` the filters A to E it fails as bits.

    Null texts are empty and null parts the empty string. E fails where a smaller id has the same text, by a digest of
    128 bits; a row without id fails it never and makes no other row fail it, and rows that repeat an id are compared
    by id alone. A document is good or toxic if any of its labels says so. Texts are read whole, once.
    """
    rows = picked(docs, {"doc_id": id_col, "text": text_col, "part": part_col}, {"doc_id": "bigint", "text": "string", "part": "string"})

    def run(batches):
        for batch in batches:
            bits, digests = [], []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                bits.append(failed(raw))
                digests.append(hashlib.blake2b(raw, digest_size=16).digest())
            two = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            columns = [batch.column("doc_id"), batch.column("part"), pa.array(bits, pa.int32()), pa.array(two[:, 0]), pa.array(two[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "failed", "high", "low"])

    narrow = rows.select("doc_id", F.coalesce("part", F.lit("")).alias("part"), "text").mapInArrow(run, "doc_id bigint, part string, failed int, high bigint, low bigint")
    narrow = stored(narrow, "failures")
    # Only texts that several ids share are joined back. Tables that were written can be broadcast by their known size,
    # and a join of scans alone can be split where a key is hot.
    first = narrow.groupBy("high", "low").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    told = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rows = narrow.join(stored(first, "repeated"), ["high", "low"], "left").join(stored(told.where("doc_id IS NOT NULL"), "told"), "doc_id", "left")
    repeated = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    no = F.lit(False)
    return rows.select("part", (F.col("failed") + F.when(repeated, 16).otherwise(0)).alias("failed"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def survival_words(filters: int) -> np.ndarray:
    """For each set of failed filters the word whose bit ``s`` is 1 where no failed filter is in the set ``s``."""
    sets = np.arange(1 << filters)
    return ((sets[:, None] & sets[None, :] == 0).astype(np.uint64) << sets.astype(np.uint64)).sum(axis=1).astype(np.uint32)


def popcounts(words: np.ndarray) -> np.ndarray:
    """How often each of the 32 bits is 1. Three arrays of one weight become their sum bits, of that weight,
    and their carries, of twice the weight, until a few words are left, whose bits are counted."""
    total, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 8:
            third = len(words) // 3
            a, b, c = words[:third], words[third : 2 * third], words[2 * third : 3 * third]
            either = a ^ b
            carries.append(a & b | either & c)
            words = np.concatenate([either ^ c, words[3 * third :]])
        total += weight * np.unpackbits(words.view(np.uint8), bitorder="little").reshape(-1, 32).sum(axis=0, dtype=np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return total


def survivors(rows: DataFrame, filters: int = len(LETTERS)) -> DataFrame:
    """(part, n, good, toxic): for each part, arrays of how many documents each set of filters leaves.

    Takes the rows of ``failures``. A part's sums are made in the tasks first, so a part of any size
    sends 32 rows a task; no rows give no parts.
    """
    sets = 1 << filters

    def run(batches):
        table = survival_words(filters)
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros((3, 32), np.int64))

        def out():
            parts = list(held)
            sums = [np.concatenate([held[p][i, :sets] for p in parts]) for i in range(3)]
            subset = np.tile(np.arange(sets, dtype=np.int32), len(parts))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(parts, object), sets), pa.string()), pa.array(subset), *map(pa.array, sums)], names=["part", "subset", "n", "good", "toxic"])

        for batch in batches:
            part = batch.column("part").dictionary_encode()
            code = part.indices.to_numpy(zero_copy_only=False)
            words = table[batch.column("failed").to_numpy(zero_copy_only=False)]
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(part.dictionary) + 1))
            of = [np.ones(len(words), bool), *(batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("good", "toxic"))]
            for k, name in enumerate(part.dictionary.to_pylist()):
                own = order[edges[k] : edges[k + 1]]
                held[name] += np.stack([popcounts(words[own[chosen[own]]]) for chosen in of])
            if len(held) > PARTS_HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    sums = rows.mapInArrow(run, SUMS).groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    listed = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("sums"))
    return listed.select("part", *[F.col(f"sums.{c}").alias(c) for c in ("n", "good", "toxic")])


def report(sums: DataFrame, letters: Sequence[str] = LETTERS) -> DataFrame:
    """What each step of each order of the filters does in each part, as the module says.

    kept: documents left after the step; removed: here; redundant: failing the step's filter, but removed before;
    unique_fails: failing no other filter; good_lost, toxic_lost: removed here with that label; shapley: removed
    by the step's filter, summed over all orders.
    """
    k, names = len(letters), "".join(letters)
    bit = lambda letter: f"shiftleft(1, instr('{names}', {letter}) - 1)"
    mask = lambda upto: f"aggregate(filter(sequence(1, {k}), i -> i <= {upto}), 0, (m, i) -> m | {bit('substr(filter_order, i, 1)')})"
    weights = ", ".join(f"{math.factorial(s) * math.factorial(k - 1 - s)}L" for s in range(k))
    shapley = f"aggregate(filter(sequence(0, {(1 << k) - 1}), s -> s & bit = 0), 0L, (m, s) -> m + array({weights})[bit_count(s)] * (n[s] - n[s | bit]))"
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = sums.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.select("*", F.expr(bit("substr(filter_order, step, 1)")).alias("bit"), F.expr(mask("step - 1")).alias("before"), F.expr(mask("step")).alias("after"))
    lost = lambda c: f"{c}[before] - {c}[after]"
    every = (1 << k) - 1
    return steps.selectExpr(
        "part", "filter_order", "step", "n[after] AS kept", f"{lost('n')} AS removed", f"n[0] - n[bit] - ({lost('n')}) AS redundant",
        f"n[{every} - bit] - n[{every}] AS unique_fails", f"{lost('good')} AS good_lost", f"{lost('toxic')} AS toxic_lost", f"{shapley} AS shapley",
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
 + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS failed FROM w),
c AS (SELECT part, failed, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY part, failed),
a AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM a, a b, a c, a d, a e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
 CAST(list_sum([CASE WHEN i < step THEN 1 << (ascii(filter_order[i]) - 65) ELSE 0 END for i in [1, 2, 3, 4, 5]]) AS INTEGER) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN failed & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN failed & earlier = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN failed & earlier > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN failed & earlier = 0 AND failed & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failed & earlier = 0 AND failed & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
 FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""


def op11_filter_audit(spark, sf: str) -> DataFrame:
    rows = failures(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    return report(survivors(rows))
