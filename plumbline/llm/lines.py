"""Lines that many documents repeat, dropped by probing a sharded minimal perfect hash.

Lines are counted by a hash of 128 bits. Those found in enough documents are dealt to shards by hash, and a task builds
each shard's minimal perfect hash: a line takes the place its hash gives it on the first level where no other
line wants that place, and the number of places taken before it is its own number. At that number two plain arrays hold
a fingerprint, which turns other lines away, and the count of documents. Documents are not joined with anything: tasks
hash their lines, read the shards these fall into from the shared folder, and keep the last used shards.

    <path>/shard=<s>    n, bits, sizes, before, prints, counts
"""

from __future__ import annotations

from collections import Counter, OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted, scratch
from plumbline.llm.common import picked, stored
from plumbline.llm.warc import opened
from plumbline.llm.words import mix, slices

MIN_DOCS = 10
SHARD_KEYS = 1 << 19
#: Places a level has for each line that is left.
ROOM = 2
#: Distinct lines a task counts before it sends them on, and bytes of shards it keeps.
HELD, SHELF_BYTES = 200_000, 128 << 20
SHARD = "n bigint, bits binary, sizes array<bigint>, before binary, prints binary, counts binary"


def keys_of(raw: bytes) -> list[bytes]:
    """A key for each line: bytes.strip and bytes.lower know ASCII white space and ASCII letters only."""
    return [line.strip() for line in raw.lower().split(b"\n")]


# -- the hash ----------------------------------------------------------------------------------


def spot(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(high + low * np.uint64(2 * level + 1)) % np.uint64(size)


class Shard:
    """A minimal perfect hash of (high, low) with a fingerprint and a count for each number."""

    def __init__(self, n: int, bits: np.ndarray, sizes: list[int], before: np.ndarray, prints: np.ndarray, counts: np.ndarray):
        self.n, self.bits, self.sizes, self.before, self.prints, self.counts = n, bits, sizes, before, prints, counts

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> Shard:
        """From distinct pairs: levels of bits, until every pair has a place of its own."""
        taken, sizes, left = [], [], np.arange(len(high))
        while len(left):
            size = -(-ROOM * len(left) // 64) * 64
            at = spot(high[left], low[left], len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            taken.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        flat = np.concatenate(taken) if taken else np.zeros(0, bool)
        bits = np.packbits(flat, bitorder="little").view(np.uint64)
        before = np.zeros(len(bits), np.uint32)
        before[1:] = np.cumsum(np.bitwise_count(bits))[:-1]
        out = cls(len(high), bits, sizes, before, np.zeros(len(high), np.uint64), np.zeros(len(high), np.min_scalar_type(int(counts.max(initial=0)))))
        number = out.numbers(high, low)
        out.prints[number], out.counts[number] = low, counts
        return out

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each pair, -1 where no level has a place for it. A strange pair may get any number."""
        out, left, base = np.full(len(high), -1, np.int64), np.arange(len(high)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = spot(high[left], low[left], level, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            found = self.bits[word] >> bit & np.uint64(1) == 1
            word, bit = word[found], bit[found]
            out[left[found]] = self.before[word] + np.bitwise_count(self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            left, base = left[~found], base + size
        return out

    def probe(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The count of each pair, 0 for a pair whose fingerprint says that the shard was not built from it."""
        number = self.numbers(high, low)
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(number >= 0)
        some = some[self.prints[number[some]] == low[some]]
        out[some] = self.counts[number[some]]
        return out

    def row(self) -> dict:
        return {"n": self.n, "bits": self.bits.tobytes(), "sizes": self.sizes, "before": self.before.tobytes(), "prints": self.prints.tobytes(), "counts": bytes([self.counts.itemsize]) + self.counts.tobytes()}

    @classmethod
    def of(cls, row: dict) -> Shard:
        counts = np.frombuffer(row["counts"], np.dtype(f"u{row['counts'][0]}"), offset=1)
        return cls(row["n"], np.frombuffer(row["bits"], np.uint64), row["sizes"], np.frombuffer(row["before"], np.uint32), np.frombuffer(row["prints"], np.uint64), counts)

    @property
    def size(self) -> int:
        return sum(x.nbytes for x in (self.bits, self.before, self.prints, self.counts))


# -- counting and building ---------------------------------------------------------------------


def line_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(high, low, n): in how many documents each line key of one code point or more is found."""

    def run(batches):
        def out():
            two = np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2)
            columns = [two[:, 0], two[:, 1], np.fromiter(held.values(), np.int64, len(held))]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["high", "low", "n"])

        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(map(xxhash.xxh3_128_digest, {k for k in keys_of((text.as_py() or "").encode()) if k}))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    found = picked(docs, {"text": text_col}, {"text": "string"}).mapInArrow(run, "high bigint, low bigint, n bigint")
    return found.groupBy("high", "low").agg(F.sum("n").alias("n"))


@dataclass
class Index:
    """Where the shards are, how many, and the least count of documents they hold."""

    path: str
    shards: int
    least: int


def build(docs: DataFrame, path: str, text_col: str = "text", least: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> Index:
    """Index every line key that at least ``least`` documents hold; a row is a document.

    A shard is built in one task from some ``shard_keys`` distinct lines, however often they occur, and written
    with the table, so a lost task is done again. Without such lines there are no shards.
    """
    repeated = stored(line_counts(docs, text_col).where(F.col("n") >= least), "line-counts")
    shards = -(-repeated.count() // shard_keys)

    def run(key, table):
        columns = [table.column(c).to_numpy() for c in ("high", "low", "n")]
        row = Shard.build(columns[0].view(np.uint64), columns[1].view(np.uint64), columns[2]).row()
        return pa.table({c: [v] for c, v in {"shard": key[0].as_py(), **row}.items()}, schema=pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("sizes", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("before", "prints", "counts")]]))

    if shards:
        dealt = repeated.withColumn("shard", F.pmod("high", F.lit(shards)))
        dealt.groupBy("shard").applyInArrow(run, f"shard bigint, {SHARD}").write.partitionBy("shard").parquet(path)
    return Index(path, shards, least)


# -- probing -----------------------------------------------------------------------------------


class Shelf:
    """The shards that a task used last."""

    def __init__(self, index: Index):
        self.index, self.held, self.size = index, OrderedDict(), 0
        self.system, self.folder = opened(index.path)

    def shard(self, s: int) -> Shard | None:
        if s not in self.held:
            where = f"{self.folder}/shard={s}"
            there = self.system.get_file_info(where).type.name != "NotFound"  # a shard without lines has no folder
            row = ds.dataset(where, filesystem=self.system, format="parquet").to_table().to_pylist()[0] if there else None
            self.held[s] = Shard.of(row) if row else None
            self.size += self.held[s].size if row else 0
            while self.size > SHELF_BYTES and len(self.held) > 1:
                _, gone = self.held.popitem(last=False)
                self.size -= gone.size if gone else 0
        self.held.move_to_end(s)
        return self.held[s]

    def counts(self, high: np.ndarray, low: np.ndarray, shard: np.ndarray) -> np.ndarray:
        out = np.zeros(len(high), np.int64)
        order = np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(own) and (found := self.shard(int(shard[own[0]]))):
                out[own] = found.probe(high[own], low[own])
        return out


def without_repeats(docs: DataFrame, index: Index, text_col: str = "text", min_docs: int | None = None) -> DataFrame:
    """The given columns with the text's other lines, ``n_lines``, ``n_dropped`` and ``max_docs``.

    A line goes when its key, stripped of ASCII white space and in lower case, is indexed with at least ``min_docs``
    documents; lines without a key stay. ``max_docs`` is the count of the most frequent line dropped, 0 where none was. A
    null text is one empty line and stays null. Columns with the new names are replaced. A text is split in one task.
    """
    least = index.least if min_docs is None else min_docs
    if least < index.least:
        raise ValueError(f"the index holds lines of at least {index.least} documents")
    new = {"n_lines": pa.int64(), "n_dropped": pa.int64(), "max_docs": pa.int64()}
    kept = [f for f in docs.schema if f.name not in new]
    rows = docs.select(*[quoted(f.name).cast("string").alias(f.name) if f.name == text_col else quoted(f.name) for f in kept])

    def run(batches):
        shelf = Shelf(index)
        for batch in slices(batches, text_col):
            texts = [t.as_py() for t in batch.column(text_col)]
            lines = [(t or "").encode().split(b"\n") for t in texts]
            keys = [k for own in lines for k in (line.strip() for line in own)]
            has = np.fromiter(map(bool, keys), bool, len(keys))
            two = np.frombuffer(b"".join(xxhash.xxh3_128_digest(k.lower()) for k in keys if k), dtype=np.uint64).reshape(-1, 2)
            high, low = two[:, 0], two[:, 1]
            counts = np.zeros(len(keys), np.int64)
            if index.shards and len(high):
                counts[has] = shelf.counts(high, low, np.mod(high.view(np.int64), index.shards))
            n_lines = np.fromiter(map(len, lines), np.int64, len(lines))
            first = np.cumsum(n_lines) - n_lines
            goes = has & (counts >= least)
            top = np.maximum.reduceat(np.where(goes, counts, 0), first)
            dropped = np.add.reduceat(goes.astype(np.int64), first)
            for i in np.flatnonzero(dropped):
                stay = ~goes[first[i] : first[i] + n_lines[i]]
                texts[i] = b"\n".join([line for line, s in zip(lines[i], stay) if s]).decode()
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[text_col] = pa.array(texts, columns[text_col].type)
            columns |= {"n_lines": pa.array(n_lines), "n_dropped": pa.array(dropped), "max_docs": pa.array(top)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, T.StructType([*rows.schema, *[T.StructField(c, T.LongType()) for c in new]]))



SQL = f"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT nr, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS place FROM d),
k AS (SELECT nr, place, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
n AS (SELECT key, count(DISTINCT nr) AS n FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT nr) >= {MIN_DOCS}),
r AS (SELECT nr, count(*) AS n_lines, count(n) AS n_dropped, coalesce(max(n), 0) AS max_docs, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE n IS NULL), '') AS kept FROM k LEFT JOIN n ON k.key = n.key GROUP BY nr)
SELECT doc_id, n_lines, n_dropped, max_docs, sha256(kept) AS kept_sha256 FROM d JOIN r ON d.nr = r.nr
"""


def op12_line_dedup(spark, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    kept = without_repeats(docs, build(docs, scratch(spark, "line-index")))
    return kept.select("doc_id", "n_lines", "n_dropped", "max_docs", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
