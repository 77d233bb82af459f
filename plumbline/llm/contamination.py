"""Passages of test items in documents, found by Wu and Manber's multi-pattern search over words.

A pattern is a window of consecutive words of an item. The search looks at a block of two
words and jumps by the shift the block's table entry allows: a block that no pattern holds lets
it jump over a whole pattern but one word. At shift zero the two words select the
patterns that end in them, and every word of such a pattern is compared, as hash and then as text.
Many cursors, one for each strip of a document, take their steps together.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import picked
from plumbline.llm.words import ALPHANUMERIC, Powers, grams, slices, words_of

WINDOW_WORDS = 10
BLOCK = 2
TABLE_BITS = 20
STRIP = 2048
#: Items are searched in blocks of about so many bytes of text; a table of shifts and patterns
#: then takes at most some 200 MB in a task, however large the test sets are.
ITEM_BYTES = 4 << 20
RESULT = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


@dataclass
class Patterns:
    """Distinct windows of one length: words by row, items of each, and the tables of the search."""

    length: int
    words: np.ndarray
    texts: list[bytes]
    items: list[list[str]]
    shift: np.ndarray
    suffix: np.ndarray
    by_suffix: np.ndarray

    @property
    def block(self) -> int:
        return min(BLOCK, self.length)


def place(block_hashes: np.ndarray) -> np.ndarray:
    return (block_hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def compiled(length: int, windows: dict[bytes, tuple[np.ndarray, set[str]]]) -> Patterns:
    """The shift table has, for a block, the least distance of its end from a pattern's end."""
    texts = sorted(windows)
    rows = np.array([windows[t][0] for t in texts], dtype=np.uint64).reshape(len(texts), length)
    block = min(BLOCK, length)
    shift = np.full(1 << TABLE_BITS, length - block + 1, dtype=np.uint8)
    keys = grams(rows, block)
    for end in range(block, length + 1):
        np.minimum.at(shift, place(keys[:, end - block]), length - end)
    suffix = keys[:, -1]
    order = np.argsort(suffix, kind="stable")
    return Patterns(length, rows, texts, [sorted(windows[t][1]) for t in texts], shift, suffix[order], order)


def item_patterns(items: list[tuple[str, str]], size: int) -> list[Patterns]:
    """Patterns of (item id, text) rows, by length: ``size`` words, or all words of a shorter item."""
    found = words_of(pa.array([t for _, t in items], pa.string()), ALPHANUMERIC)
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
    for k, (item, _) in enumerate(items):
        first, last = int(found.first[k]), int(found.first[k + 1])
        length = min(size, last - first)
        words = [found.text(i) for i in range(first, last)]
        for at in range(last - first - length + 1 if length else 0):
            text = b" ".join(words[at : at + length])
            by_length.setdefault(length, {}).setdefault(text, (found.hashes[first + at : first + at + length], set()))[1].add(item)
    return [compiled(n, windows) for n, windows in sorted(by_length.items())]


def occurrences(hashes: np.ndarray, first: np.ndarray, p: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(place of an occurrence's first word, pattern) for all rows; rows are hashes[first[i]:first[i+1]]."""
    none = np.zeros(0, np.int64)
    if len(hashes) < p.length:
        return none, none
    blocks = grams(hashes, p.block)
    # A strip holds the places where a block may end a pattern: all strips of a row cover them once.
    counts = np.maximum(np.diff(first) - p.length + 1, 0)
    strips = -(-counts // STRIP)
    row = np.repeat(np.arange(len(counts)), strips)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(strips) - strips, strips)
    at = first[row] + p.length - p.block + nth * STRIP
    stop = np.minimum(at + STRIP, first[row + 1] - p.block + 1)
    ends: list[np.ndarray] = []
    while len(at):
        jump = p.shift[place(blocks[at])].astype(np.int64)
        hit = jump == 0
        ends.append(at[hit])
        at = at + np.maximum(jump, 1)
        live = at < stop
        if not live.all():
            at, stop = at[live], stop[live]
    end = np.concatenate(ends) if ends else none
    keys = blocks[end]
    low, high = np.searchsorted(p.suffix, keys, "left"), np.searchsorted(p.suffix, keys, "right")
    found_at, found = [none], [none]
    tries = high - low
    for k in range(int(tries.max(initial=0))):  # the k-th pattern of each suffix's bucket
        live = tries > k
        pattern, start = p.by_suffix[low[live] + k], end[live] + p.block - p.length
        same = np.ones(len(start), dtype=bool)
        for j in range(p.length):
            same[same] = hashes[start[same] + j] == p.words[pattern[same], j]
        found_at.append(start[same])
        found.append(pattern[same])
    return np.concatenate(found_at), np.concatenate(found)


def search(batch: pa.RecordBatch, patterns: list[Patterns], powers: Powers) -> pa.RecordBatch:
    """Adds what these patterns hit to the spans and items that earlier blocks of items left."""
    found = words_of(batch.column("text"), ALPHANUMERIC, powers=powers)
    spans = [[x.as_py() or []] for x in batch.column("spans")]
    items = [set(x.as_py() or []) for x in batch.column("items")]
    for p in patterns:
        start, which = occurrences(found.hashes, found.first, p)
        rows = np.searchsorted(found.first, start, side="right") - 1
        for s, w, r in zip(start.tolist(), which.tolist(), rows.tolist()):
            if b" ".join(found.text(i) for i in range(s, s + p.length)) == p.texts[w]:
                at = s - int(found.first[r])
                spans[r].append([at, at + p.length])
                items[r].update(p.items[w])
    flat = [merged([x for x in s if x]) for s in spans]
    made = {"n_words": pa.array(found.counts, pa.int64()), "spans": pa.array(flat, pa.list_(pa.int64())), "items": pa.array([sorted(i) for i in items], pa.list_(pa.string()))}
    return pa.RecordBatch.from_arrays([made.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)


def merged(spans: list[list[int]]) -> list[int]:
    """Flat starts and ends of the union; each input is itself a flat list of starts and ends."""
    out: list[int] = []
    for a, b in sorted((s[i], s[i + 1]) for s in spans for i in range(0, len(s), 2)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def searched(marked: DataFrame, items: DataFrame, item_col: str, item_text_col: str, size: int, item_bytes: int) -> DataFrame:
    """(doc_id, text, n_words, spans, items) and any further columns of rows (doc_id, text, ...), block by block of items."""
    spark = marked.sparkSession
    wanted = picked(items, {"item_id": item_col, "text": item_text_col}, {"item_id": "string", "text": "string"}).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // item_bytes))
    marked = marked.selectExpr("*", "CAST(0 AS BIGINT) AS n_words", "CAST(NULL AS ARRAY<BIGINT>) AS spans", "CAST(NULL AS ARRAY<STRING>) AS items")
    key = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    for b in range(blocks):
        block = [tuple(r) for r in wanted.where(key == b).select("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast(item_patterns(block, size))

        def scan(batches, shared=shared):
            powers = Powers()
            for batch in slices(batches):
                yield search(batch, shared.value, powers)

        marked = marked.mapInArrow(scan, marked.schema)
    return marked


def contamination(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", size: int = WINDOW_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per row of ``docs``: words, words inside any window of an item, items met.

    A null or empty text has no words; an item without id or words has no windows; items that repeat
    an id share its windows, and a repeated document row is answered as often as it comes. Items go
    through the documents in blocks of ``item_bytes`` that follow their number, one after
    the other within a task; a document carries the union of its hits from block to block.
    """
    marked = picked(docs, {"doc_id": id_col, "text": text_col}, {"text": "string"})
    marked = searched(marked, items, item_col, item_text_col, size, item_bytes)

    def digest(batches):
        for batch in batches:
            items = batch.column("items").to_pylist()
            spans = batch.column("spans").to_pylist()
            hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                 pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), pa.array([h > 0 for h in hit], pa.bool_()), batch.column("spans"), batch.column("items")],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"],
            )

    out = marked.select("doc_id", "n_words", "spans", "items")
    return out.mapInArrow(digest, f"doc_id {dict(marked.dtypes)['doc_id']}, {RESULT.split(', ', 1)[1]}, spans array<bigint>, items array<string>")


def clean(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", size: int = WINDOW_WORDS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no window of an item."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"), F.struct(*[quoted(c) for c in docs.columns if c != text_col]).alias("others"))
    rows = searched(rows, items, item_col, item_text_col, size, item_bytes).where("size(spans) = 0")
    return rows.select(*[F.col("text").alias(c) if c == text_col else F.col("others")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[pos : pos + least(10, len(words)) - 1], ' ') AS pattern
  FROM (SELECT item_id, words, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) AS pos FROM i WHERE len(words) > 0) s),
g AS (SELECT doc_id, size, pos, array_to_string(words[pos : pos + size - 1], ' ') AS pattern
  FROM (SELECT doc_id, words, size, unnest(generate_series(1, len(words) - size + 1)) AS pos FROM w, (SELECT DISTINCT size FROM p) z WHERE len(words) >= size) s),
h AS (SELECT g.doc_id, g.pos, g.size, p.item_id FROM g JOIN p ON g.size = p.size AND g.pattern = p.pattern),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS place FROM h) s GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) s GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op2_contamination(spark, sf: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select(*[c.split()[0] for c in RESULT.split(", ")])
