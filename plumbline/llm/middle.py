"""Fill-in-the-middle texts: documents cut at two units and put together in another order.

A unit is a run of ASCII letters or one other code point. Texts are cut into chunks where a rolling hash of the last 32 bytes
says so, so passages that documents share fall into the same chunks. A task counts a chunk once and remembers, by its
bytes, how many units and code points begin in it and whether it begins and ends in a letter. Sums of these, less
one unit wherever a run of letters goes over a chunk's end, say how many units a text has and in which chunk a cut
lies, and only that chunk is looked at again.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted
from plumbline.llm.words import slices, text_bytes

SEED = "1"
#: Of a hundred documents, so many are turned round, and of a hundred of those, so many have the suffix first.
TURNED, SUFFIX_FIRST = 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a chunk: at least, at most, and one in 2**BITS places may end it.
SHORTEST, LONGEST, BITS, REACH = 256, 8192, 10, 32
GEAR = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 32, 256, dtype=np.uint32)
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes hashed at a time, and bytes of chunks that a task remembers.
STEP, REMEMBERED = 1 << 20, 64 << 20


def ends(data: np.ndarray) -> list[int]:
    """Places behind bytes at which the hash of the last 32 bytes ends a chunk, in steps of bounded size."""
    out = []
    for at in range(0, len(data), STEP):
        low = max(0, at - REACH + 1)
        h = GEAR[data[low : at + STEP]]
        for s in (1, 2, 4, 8, 16):  # the sum over 2 s bytes from two sums over s bytes
            more = h.copy()
            more[s:] += h[:-s] << np.uint32(s)
            h = more
        out.append(np.flatnonzero(h[at - low :] >> np.uint32(32 - BITS) == 0) + at + 1)
    return np.concatenate(out).tolist() if out else []


def chunks(found: Sequence[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of a text. The hash counts from its 256th byte on, so no other text's bytes matter."""
    out, at = [], start
    while at < end:
        k = bisect_left(found, at + SHORTEST)
        at = min(found[k] if k < len(found) else end, at + LONGEST, end)
        out.append(at)
    return out


def begins(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At which bytes a unit begins, and a code point, as though nothing came before."""
    letter, point = LETTER[data], data & 0xC0 != 0x80
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return unit, point


class Memory:
    """Summaries of chunks by their bytes: units, code points, begins and ends in a letter."""

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[int, int, bool, bool]] = {}
        self.size = self.asked = self.counted = 0

    def of(self, pieces: list[bytes]) -> np.ndarray:
        """A row of four numbers for each chunk. Chunks not met before are counted together."""
        self.asked += len(pieces)
        fresh = list(dict.fromkeys(p for p in pieces if p not in self.known))
        if fresh:
            data = np.frombuffer(b"".join(fresh), np.uint8)
            lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
            first = np.cumsum(lengths) - lengths
            unit, point = begins(data)
            unit[first] = point[first]
            units, points = (np.add.reduceat(x.astype(np.int64), first) for x in (unit, point))
            rows = zip(units.tolist(), points.tolist(), LETTER[data[first]].tolist(), LETTER[data[first + lengths - 1]].tolist())
            self.known.update(zip(fresh, rows))
            self.size += len(data)
            self.counted += len(fresh)
        out = np.array([self.known[p] for p in pieces], np.int64).reshape(-1, 4)
        if self.size > REMEMBERED:
            self.known.clear()
            self.size = 0
        return out


class Texts:
    """The units of a batch of texts, ready to be cut at."""

    def __init__(self, texts, memory: Memory):
        self.data, self.offsets = text_bytes(texts)
        self.raw = self.data.tobytes()
        found = ends(self.data)
        own = [chunks(found, a, b) for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())]
        self.stop = np.array([e for x in own for e in x], np.int64)
        counts = np.fromiter(map(len, own), np.int64, len(own))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.start = np.concatenate([[0], self.stop[:-1]]) if len(self.stop) else self.stop
        rows = memory.of([self.raw[a:b] for a, b in zip(self.start.tolist(), self.stop.tolist())])
        units = rows[:, 0].copy()
        # A run of letters that goes on from the chunk before, of the same text, is no new unit.
        self.joined = np.zeros(len(units), bool)
        self.joined[1:] = (rows[1:, 2] == 1) & (rows[:-1, 3] == 1)
        self.joined[self.first[:-1][counts > 0]] = False
        units -= self.joined
        self.units, self.points = (np.concatenate([[0], np.cumsum(x)]) for x in (units, rows[:, 1]))
        self.n = self.units[self.first[1:]] - self.units[self.first[:-1]]

    def place(self, i: int, k: int) -> tuple[int, int]:
        """(byte, code points before it in the text) where unit k of text i begins, or its end where k is n."""
        base = self.points[self.first[i]]
        if k == self.n[i]:
            return int(self.offsets[i + 1]), int(self.points[self.first[i + 1]] - base)
        target = self.units[self.first[i]] + k
        c = int(np.searchsorted(self.units, target, side="right")) - 1
        unit, point = begins(self.data[self.start[c] : self.stop[c]])
        unit[0] &= not self.joined[c]
        at = int(np.flatnonzero(unit)[target - self.units[c]])
        return int(self.start[c]) + at, int(self.points[c] - base + np.count_nonzero(point[:at]))


def draws(doc_id, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits from seed and id; a null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def turned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, share: int = TURNED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """The given columns with the text put together anew, ``n`` units, ``form`` and the characters of prefix and middle.

    Forms: ``plain``, the text as it was: empty, holding a marker, or drawn; ``psm``: prefix, suffix, middle;
    ``spm``: suffix, prefix, middle, each behind its marker. The draw hangs on seed and id, so rows that repeat an id
    are drawn alike. A null text stays null and plain, with no units. Columns with the new names are replaced. Texts
    are cut whole in the task that reads them, without a shuffle.
    """
    new = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long"}
    kept = [f for f in docs.schema if f.name not in new or f.name in (id_col, text_col)]
    if {id_col, text_col} & set(new):
        raise ValueError(f"id and text cannot be called {sorted(new)}")
    rows = docs.select(*[quoted(f.name).cast("string").alias(f.name) if f.name == text_col else quoted(f.name) for f in kept])
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches):
        memory = Memory()
        for batch in slices(batches, text_col):
            texts = Texts(batch.column(text_col), memory)
            given = batch.column(text_col).is_valid().to_pylist()
            out, forms, sizes = [], [], []
            for i, doc in enumerate(batch.column(id_col).to_pylist()):
                n, (h1, h2, h3, h4) = int(texts.n[i]), draws(doc, seed)
                a, b = int(texts.offsets[i]), int(texts.offsets[i + 1])
                raw = texts.raw[a:b]
                if not n or p in raw or s in raw or m in raw or h3 % 100 >= share:
                    out.append(raw if given[i] else None)
                    forms.append("plain")
                    sizes.append((None, None))
                    continue
                one, two = sorted((h1 % (n + 1), h2 % (n + 1)))
                (x, before), (y, upto) = texts.place(i, one), texts.place(i, two)
                first, middle, last = raw[: x - a], raw[x - a : y - a], raw[y - a :]
                late = h4 % 100 < suffix_first
                out.append(b"".join([s, last, p, first, m, middle] if late else [p, first, s, last, m, middle]))
                forms.append("spm" if late else "psm")
                sizes.append((before, upto - before))
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns[text_col] = pa.array(out, pa.binary()).cast(pa.string())
            columns |= {"n": pa.array(texts.n, pa.int64()), "form": pa.array(forms, pa.string())}
            columns |= {c: pa.array([x[j] for x in sizes], pa.int64()) for j, c in enumerate(("prefix_chars", "middle_chars"))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, T.StructType([*rows.schema, *[T.StructField(c, T.LongType() if t == "long" else T.StringType()) for c, t in new.items()]]))


def restored(text: Column, form: Column) -> Column:
    """The text before it was turned. Its parts hold no marker, and none arises where a part meets one."""
    p, s, m = (F.instr(text, F.lit(x)) for x in (PREFIX, SUFFIX, MIDDLE))
    cut = lambda a, b: F.substr(text, a + 3, b - a - 3)
    middle = F.substr(text, m + 3)
    return F.when(form == "psm", F.concat(cut(p, s), middle, cut(s, m))).when(form == "spm", F.concat(cut(p, m), middle, cut(s, p))).otherwise(text)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, text, h, regexp_extract_all(text, '(?s)[A-Za-z]+|[^A-Za-z]') AS units FROM d),
k AS (SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS one, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS two,
 CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS three, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS four FROM u),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR three >= 90 THEN 'plain' WHEN four < 20 THEN 'spm' ELSE 'psm' END AS form,
 array_to_string(units[1:least(one, two)], '') AS a, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS b, array_to_string(units[greatest(one, two) + 1:n], '') AS c FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""


def op13_fill_in_middle(spark, sf: str) -> DataFrame:
    out = turned(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).withColumn("text", F.coalesce("text", F.lit("")))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("text")).alias("output_sha256"), digest(restored(F.col("text"), F.col("form"))).alias("restored_sha256"))
