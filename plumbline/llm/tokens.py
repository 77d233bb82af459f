"""Token ids in files, coded by a static range asymmetric numeral system.

A set of files has one shared frequency table and rows of independent blocks. A block
codes a fixed number of ids in interleaved lanes that share one stream of 32-bit words; the decoder's
states and place in the stream are noted at checkpoints, so any part of a block can be decoded
by itself, and all parts together in step. Each block holds a checksum of its ids.

    <path>/table    id, frequency (their sum is 2**SCALE_BITS)
    <path>/blocks   part, block, n, crc32, words, checkpoints, documents
    <path>/parts    part, start, n

Parts follow the ascending ids of the documents; ``start`` counts the ids of all parts before.
A block lists the stretches of documents in it: document id, number of the document in the part,
place in the block and number of ids.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import scratch
from plumbline.llm.common import picked, stored
from plumbline.llm.words import LOWER, SPACED, mix, slices, text_bytes

SCALE_BITS = 20
LANES = 32
BLOCK = 1 << 15
CHECKPOINT = 256
LOW = np.uint64(1 << 31)
#: Blocks coded in step; their arrays take some 20 MB.
TOGETHER = 32
#: White-space-free pieces whose ids a task remembers.
REMEMBERED = 600_000
#: Short pieces also have a slot each, found for a whole batch at once; the slots take 24 MB.
SLOT_BITS = 20
#: ASCII letters are 1, ASCII punctuation 2, all else 0.
KINDS = np.array([1 if chr(b).isalpha() else 2 if 32 < b < 127 and not chr(b).isdigit() else 0 for b in range(128)] + [0] * 128, dtype=np.int8)
LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
END = 1
BLOCKS = (
    "part int, block bigint, n int, crc32 bigint, words binary, checkpoints binary, "
    "documents array<struct<doc_id:{id},row:bigint,at:int,n:int>>"
)


# -- ids ---------------------------------------------------------------------------------------


class Numbers(dict):
    """A piece's number; a piece not met before is learnt."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, piece: bytes) -> int:
        return self.learn(piece)


class Encoder:
    """Ids of whole texts from a tokenizer that drops white space and joins nothing across it.

    Pieces between ASCII white space are encoded once and remembered, so ids are those of the whole
    text. Where the library's normaliser and splitter are of the known kind, punctuation after Latin letters is a piece by
    itself, A-Z are lowered first, and Latin letters go straight to the library's model as the one word that the splitter would
    make of them. A tokenizer whose ids depend on the white space is refused.
    """

    OWN = "|"
    LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
    KNOWN = {"NFC", "Replace", "Lowercase"}, "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.library, self.end = Tokenizer.from_file(path), end
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        steps = {x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])}
        split, *more = (told.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        # The library's own tokens are met as they are written, so none may lie in a piece that is cut or lowered.
        own = [t["content"] for t in told.get("added_tokens", [])]
        apart = all(self.OWN in t and re.search("[^A-Za-z][A-Za-z]", t) for t in own)
        self.plain = apart and (steps, split.get("pattern", {}).get("Regex")) == self.KNOWN and [m["type"] for m in more] == ["ByteLevel"]
        probe = ["So", "it", "is,", "1", "é"]
        if self.of_library("\t So it\n is,  1 é ") != sum(map(self.of_library, probe), []):
            raise ValueError("the tokenizer must drop white space and join nothing across it")
        self.signs = byte_signs()
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = Numbers(self.learn)
        self.ids, self.begin = array("I"), array("q", [0])
        self.head, self.tail = np.zeros((2, 1 << SLOT_BITS), dtype=np.uint64)
        self.held = np.zeros(1 << SLOT_BITS, dtype=np.int64)

    def word(self, text: str) -> list[int]:
        signs = text if text.isascii() else text.encode().decode("latin-1").translate(self.signs)
        return [t.id for t in self.model.tokenize(signs)]

    def of_library(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def learn(self, piece: bytes) -> int:
        text = piece.decode()
        number = self.number[piece] = len(self.begin) - 1
        self.ids.extend(self.word(text.lower()) if self.plain and self.LETTERS.fullmatch(text) else self.of_library(text))
        self.begin.append(len(self.ids))
        return number

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, each row closed by the end id, and each row's number of ids."""
        if len(self.number) > REMEMBERED:
            self.clear()
        data, offsets = text_bytes(texts)
        start, end = spans(data, offsets)
        if self.plain:
            start, end = parted(data, start, end)
        which = self.numbers(self.folded(data, start, end), start, end)
        begins = np.array(self.begin, dtype=np.int64)
        flat = np.append(np.array(self.ids, dtype=np.uint32), np.uint32(self.end))
        # The end id is one more piece after each row's pieces.
        places = np.searchsorted(start, offsets[1:])
        take = np.insert(which, places, len(begins) - 1)
        size = np.append(np.diff(begins), 1)[take]
        total = np.cumsum(size)
        ids = flat[np.repeat(begins[take] - (total - size), size) + np.arange(int(size.sum()))]
        return ids, np.diff(total[places + np.arange(len(places))], prepend=0)

    def folded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bytes with A-Z lowered, where the library lowers them too: not in a piece with the sign of its own tokens."""
        if not self.plain:
            return data
        out = np.take(LOWER, data)
        own = np.unique(np.searchsorted(start, np.flatnonzero(data == ord(self.OWN)), side="right") - 1)
        for a, b in zip(start[own].tolist(), end[own].tolist()):
            out[a:b] = data[a:b]
        return out

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each piece: from the slot of its bytes, where they are the same, else from the dictionary.

        A piece of up to 15 bytes is two 64-bit numbers, its length among them, so that a slot holds it
        whole and nothing rests on hashes. The first piece of a slot stays; others, and longer pieces, are looked up each time.
        """
        size = end - start
        eights = np.ndarray((len(data) + 8,), "<u8", np.append(data, np.zeros(16, np.uint8)), strides=(1,))
        head = eights[start] & LOW_BYTES[np.minimum(size, 8)]
        tail = eights[start + 8] & LOW_BYTES[np.clip(size - 8, 0, 7)]
        tail |= np.minimum(size, 16).astype(np.uint64) << np.uint64(56)
        slot = (mix(head + mix(tail)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        hit = (self.tail[slot] == tail) & (self.head[slot] == head) & (size < 16)
        out = np.where(hit, self.held[slot], 0)
        missed = np.flatnonzero(~hit)
        raw = data.tobytes()
        pieces = (raw[a:b] for a, b in zip(start[missed].tolist(), end[missed].tolist()))
        out[missed] = np.fromiter(map(self.number.__getitem__, pieces), dtype=np.int64, count=len(missed))
        fresh = missed[(size[missed] < 16) & (self.tail[slot[missed]] == 0)]
        places, first = np.unique(slot[fresh], return_index=True)
        self.head[places], self.tail[places], self.held[places] = head[fresh[first]], tail[fresh[first]], out[fresh[first]]
        return out


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs without ASCII white space begin and end; no run goes on into the next row."""
    inside = np.take(SPACED, data)
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[rows] = inside[rows]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


@lru_cache(maxsize=1)
def encoder(path: str, end: int) -> Encoder:
    """The encoder of this Python worker, which keeps what it has met for the worker's next tasks."""
    return Encoder(path, end)


def parted(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans, those of Latin letters with ASCII punctuation after them cut between the two."""
    kind = np.take(KINDS, data)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    cut = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
    mine = np.searchsorted(start, cut, side="right") - 1
    letters, marks = (np.append(0, np.cumsum(kind == k, dtype=np.int64)) for k in (1, 2))
    first, last = start[mine], end[mine]
    whole = (first < cut) & (letters[cut] - letters[first] == cut - first) & (marks[last] - marks[cut] == last - cut)
    return np.sort(np.append(start, cut[whole]), kind="stable"), np.sort(np.append(end, cut[whole]), kind="stable")


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in a byte-level vocabulary: printable Latin-1 signs stand for
    themselves, the other bytes for the signs from 256 on, in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in kept]
    return {b: chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)}


# -- coding ------------------------------------------------------------------------------------


def scaled(counts: dict[int, int]) -> dict[int, int]:
    """Frequencies of at least 1 that sum to 2**SCALE_BITS, near proportion; ties by id."""
    total = 1 << SCALE_BITS
    if not counts:
        return {END: total}
    if len(counts) > total // 2:
        raise ValueError(f"more than {total // 2} different ids")
    ids = sorted(counts)
    share = np.array([counts[i] for i in ids], dtype=np.float64)
    spread = total - len(ids)
    out = 1 + np.floor(share / share.sum() * spread).astype(np.int64)
    out[np.lexsort((ids, -share))[: total - int(out.sum())]] += 1
    out[int(np.argmax(out))] += total - int(out.sum())
    return dict(zip(ids, out.tolist()))


class Table:
    def __init__(self, frequency: dict[int, int]):
        self.ids = np.array(sorted(frequency), dtype=np.uint32)
        self.frequency = np.array([frequency[int(i)] for i in self.ids], dtype=np.uint64)
        self.start = np.cumsum(self.frequency) - self.frequency
        self.symbol = np.full(int(self.ids[-1]) + 1, -1, dtype=np.int32)
        self.symbol[self.ids] = np.arange(len(self.ids))
        self.slot = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.frequency.astype(np.int64))


def shape(n: int) -> int:
    """Steps of a block of n ids: a lane has every LANES-th id, the last steps may be short."""
    return -(-n // LANES)


def code(blocks: list[np.ndarray], table: Table) -> list[tuple[bytes, bytes]]:
    """(words, checkpoints) of each block, all coded in step from their last ids to the first."""
    steps = max((shape(len(b)) for b in blocks), default=0)
    symbols = np.full((steps, len(blocks), LANES), -1, dtype=np.int32)
    for k, b in enumerate(blocks):
        padded = np.full(shape(len(b)) * LANES, -1, dtype=np.int32)
        padded[: len(b)] = table.symbol[b]
        symbols[: shape(len(b)), k] = padded.reshape(-1, LANES)
    state = np.full((len(blocks), LANES), LOW, dtype=np.uint64)
    words = np.zeros((steps, len(blocks), LANES), dtype=np.uint32)
    sent = np.zeros((steps, len(blocks), LANES), dtype=bool)
    noted = np.zeros((-(-steps // CHECKPOINT), len(blocks), LANES), dtype=np.uint64)
    bits = np.uint64(SCALE_BITS)
    for t in range(steps - 1, -1, -1):
        used = symbols[t] >= 0
        s = np.where(used, symbols[t], 0)
        f, c = table.frequency[s], table.start[s]
        spill = used & (state >= (f << np.uint64(63 - SCALE_BITS)))
        sent[t], words[t] = spill, state
        x = np.where(spill, state >> np.uint64(32), state)
        q = x // f
        state = np.where(used, (q << bits) + (x - q * f) + c, state)
        if t % CHECKPOINT == 0:
            noted[t // CHECKPOINT] = state
    out = []
    for k, b in enumerate(blocks):
        marks = -(-shape(len(b)) // CHECKPOINT)
        mine = sent[: shape(len(b)), k]
        per_step = mine.sum(axis=1)
        before = np.cumsum(per_step) - per_step
        at = before[np.arange(marks) * CHECKPOINT].astype(np.uint64)
        out.append((words[: shape(len(b)), k][mine].tobytes(), np.concatenate([at[:, None], noted[:marks, k]], axis=1).tobytes()))
    return out


def decode(blocks: list[tuple[int, bytes, bytes]], table: Table) -> list[np.ndarray]:
    """Ids of each (n, words, checkpoints); every stretch between checkpoints runs in step with all others."""
    pieces = []
    stream, base = [], 0
    for k, (n, words, checkpoints) in enumerate(blocks):
        marks = np.frombuffer(checkpoints, dtype=np.uint64).reshape(-1, LANES + 1)
        for m, row in enumerate(marks):
            low = m * CHECKPOINT * LANES
            pieces.append((k, min(n - low, CHECKPOINT * LANES), base + int(row[0]), row[1:]))
        stream.append(np.frombuffer(words, dtype=np.uint32))
        base += len(stream[-1])
    if not pieces:
        return [np.zeros(0, np.uint32) for _ in blocks]
    flat = np.concatenate([*stream, np.zeros(LANES, np.uint32)])
    sizes = np.array([p[1] for p in pieces])
    state = np.stack([p[3] for p in pieces])
    at = np.array([p[2] for p in pieces])
    steps = shape(int(sizes.max()))
    out = np.zeros((len(pieces), steps, LANES), dtype=np.uint32)
    mask, bits = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    lanes = np.arange(LANES)
    for t in range(steps):
        used = t * LANES + lanes[None, :] < sizes[:, None]
        slot = state & mask
        s = table.slot[slot.astype(np.int64)]
        out[:, t] = table.ids[s]
        x = table.frequency[s] * (state >> bits) + slot - table.start[s]
        need = used & (x < LOW)
        rank = np.cumsum(need, axis=1)
        word = flat[np.minimum(at[:, None] + rank - 1, len(flat) - 1)]
        x = np.where(need, (x << np.uint64(32)) | word, x)
        state = np.where(used, x, state)
        at = at + rank[:, -1]
    got: list[list[np.ndarray]] = [[] for _ in blocks]
    for p, ids in zip(pieces, out):
        got[p[0]].append(ids.reshape(-1)[: p[1]])
    return [np.concatenate(g) if g else np.zeros(0, np.uint32) for g in got]


def little(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


# -- files -------------------------------------------------------------------------------------


def narrow(tokenizer: str, end: int) -> str:
    """The type of ids between steps: two bytes where the vocabulary allows it."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else "<u4"


def encoded(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end: int) -> DataFrame:
    """(doc_id, order, ids) of every row; order is a hash of the text, for rows that share an id."""
    wanted = picked(docs, {"doc_id": id_col, "text": text_col}, {"text": "string"}).select("doc_id", F.xxhash64("text").alias("order"), "text")
    kind = narrow(tokenizer, end)

    def run(batches):
        ours = encoder(tokenizer, end)
        for batch in slices(batches, most=2 << 20):
            ids, sizes = ours.encode(batch.column("text"))
            raw, size = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
            ends = np.cumsum(sizes) * size
            rows = [raw[a:b] for a, b in zip((ends - sizes * size).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("order"), pa.array(rows, pa.binary())], names=["doc_id", "order", "ids"])

    return wanted.mapInArrow(run, f"doc_id {dict(wanted.dtypes)['doc_id']}, order bigint, ids binary")


def _counts(batches, kind: str) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        seen = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype=kind), minlength=len(total))
        seen[: len(total)] += total
        total = seen
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])


def _coded(batches, frequency: dict[int, int], id_type, kind: str) -> Iterator[pa.RecordBatch]:
    """Blocks of one part, whose rows come in order."""
    from pyspark import TaskContext

    part, table = TaskContext.get().partitionId(), Table(frequency)
    done, row = 0, 0
    pending: list[np.ndarray] = []
    held, documents = 0, [[]]

    def out(blocks: list[np.ndarray], inside: list) -> pa.RecordBatch:
        payload = code(blocks, table)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(blocks), pa.int32()), pa.array(range(done, done + len(blocks)), pa.int64()), pa.array([len(b) for b in blocks], pa.int32()),
             pa.array([zlib.crc32(little(b)) for b in blocks], pa.int64()), pa.array([w for w, _ in payload], pa.binary()), pa.array([c for _, c in payload], pa.binary()),
             pa.array(inside, pa.list_(pa.struct([("doc_id", id_type), ("row", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])))],
            names=["part", "block", "n", "crc32", "words", "checkpoints", "documents"],
        )

    for batch in batches:
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            ids = np.frombuffer(raw, dtype=kind)
            low = 0
            while low < len(ids):
                take = min(len(ids) - low, BLOCK - held % BLOCK)
                documents[-1].append((doc, row, held % BLOCK, take))
                pending.append(ids[low : low + take])
                held, low = held + take, low + take
                if held % BLOCK == 0:
                    documents.append([])
                if held == BLOCK * TOGETHER:
                    yield out(list(np.concatenate(pending).reshape(TOGETHER, BLOCK)), documents[:-1])
                    done, held, pending, documents = done + TOGETHER, 0, [], [[]]
            row += 1
    if held:
        every = np.concatenate(pending)
        blocks = [every[a : a + BLOCK] for a in range(0, held, BLOCK)]
        yield out(blocks, documents[: len(blocks)])


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Write every text's ids in ascending order of document id, each text closed by ``end``.

    Null and empty texts are just the end id. Rows without id come first. Rows that share an id
    are all written, in an order that depends on their texts only. An empty table writes a table of the
    end id alone and no block.
    """
    spark, kind = docs.sparkSession, narrow(tokenizer, end)
    ids = stored(encoded(docs, tokenizer, id_col, text_col, end), "ids")
    counts = ids.select("ids").mapInArrow(lambda it: _counts(it, kind), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    frequency = scaled({r["id"]: r["n"] for r in counts.collect()})  # one row for each id of the vocabulary
    spark.createDataFrame(sorted(frequency.items()), "id bigint, frequency bigint").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(frequency)
    id_type = ids.select("doc_id").limit(0).toArrow().schema.field(0).type
    ordered = ids.repartitionByRange("doc_id", "order").sortWithinPartitions("doc_id", "order")
    schema = BLOCKS.format(id=dict(ids.dtypes)["doc_id"])
    ordered.select("doc_id", "ids").mapInArrow(lambda it: _coded(it, shared.value, id_type, kind), schema).write.parquet(f"{path}/blocks")
    sizes = {r["part"]: r["n"] for r in spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, total = [], 0
    for part in sorted(sizes):  # one row for each part
        starts.append((part, total, sizes[part]))
        total += sizes[part]
    spark.createDataFrame(starts, "part int, start bigint, n bigint").coalesce(1).write.parquet(f"{path}/parts")


def read(spark, path: str, with_ids: bool = True) -> DataFrame:
    """Stretches of documents, decoded and checked: (doc_id, part, row, start, n, crc32, ids).

    ``start`` is the place among all ids of the files. A document has one stretch for each block it
    lies in. A block whose checksum differs fails the job.
    """
    blocks, parts = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/parts")
    frequency = {r["id"]: r["frequency"] for r in spark.read.parquet(f"{path}/table").collect()}
    shared = spark.sparkContext.broadcast(frequency)
    id_type = dict(blocks.select(F.col("documents")[0]["doc_id"].alias("doc_id")).dtypes)["doc_id"]

    def run(batches):
        table = Table(shared.value)
        for big in batches:
            for low in range(0, big.num_rows, TOGETHER):
                batch = big.slice(low, TOGETHER)
                part, block, n, crc, words, marks = (batch.column(c).to_pylist() for c in ("part", "block", "n", "crc32", "words", "checkpoints"))
                decoded = decode(list(zip(n, words, marks)), table)
                out = []
                for k, (ids, inside) in enumerate(zip(decoded, batch.column("documents").to_pylist())):
                    raw = little(ids)
                    if zlib.crc32(raw) != crc[k]:
                        raise ValueError(f"block {block[k]} of part {part[k]} is damaged")
                    for d in inside:
                        piece = raw[d["at"] * 4 : (d["at"] + d["n"]) * 4]
                        out.append((d["doc_id"], part[k], d["row"], block[k] * BLOCK + d["at"], d["n"], zlib.crc32(piece), piece if with_ids else None))
                columns = list(zip(*out)) or [[]] * 7
                types = [batch.schema.field("documents").type.value_type.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "part", "row", "at", "n", "crc32", "ids"])

    pieces = blocks.mapInArrow(run, f"doc_id {id_type}, part int, row bigint, at bigint, n int, crc32 bigint, ids binary")
    placed = pieces.join(parts.select("part", F.col("start").alias("before")), "part")
    return placed.select("doc_id", "part", "row", (F.col("before") + F.col("at")).alias("start"), "n", "crc32", "ids")


# -- checksums ---------------------------------------------------------------------------------


class Joined:
    """crc32 of two byte strings in a row from their own: appending zeros is linear over GF(2)."""

    def __init__(self) -> None:
        one = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
        for _ in range(3):
            one = self._twice(one)
        self.zeros = [one]  # 2**k zero bytes

    @staticmethod
    def _apply(matrix: list[int], value: int) -> int:
        out, i = 0, 0
        while value:
            if value & 1:
                out ^= matrix[i]
            value >>= 1
            i += 1
        return out

    def _twice(self, matrix: list[int]) -> list[int]:
        return [self._apply(matrix, column) for column in matrix]

    def join(self, first: int, second: int, length: int) -> int:
        k = 0
        while length:
            if k == len(self.zeros):
                self.zeros.append(self._twice(self.zeros[-1]))
            if length & 1:
                first = self._apply(self.zeros[k], first)
            length >>= 1
            k += 1
        return first ^ second


def summary(pieces: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document that ``read`` returned."""
    id_type = dict(pieces.dtypes)["doc_id"]
    grouped = pieces.groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("start", "n", "crc32"))).alias("pieces"))

    def run(batches):
        joined = Joined()
        for batch in batches:
            out = []
            for found in batch.column("pieces").to_pylist():
                crc = found[0]["crc32"]
                for p in found[1:]:
                    crc = joined.join(crc, p["crc32"], 4 * p["n"])
                out.append((found[0]["start"], sum(p["n"] for p in found), crc))
            columns = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return grouped.select("doc_id", "pieces").mapInArrow(run, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op6_tokens(spark, sf: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write(spark.read.parquet(f"{sf}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return summary(read(spark, path, with_ids=False))
