"""Groups of documents whose shingle sets have a Jaccard similarity of at least a given share.

Equal sets are one class. Sets of about one size share a scheme that hashes the universe of
shingles into segments. Two sets that differ in at most d shingles agree on a segment, or differ
in one shingle there, because the segments' allowances add up to more than d: an exact segment
allows for one difference, a segment indexed with its one-deletion neighbours for two. How many
segments get neighbours, and how many may stay empty, is the scheme's allocation; it is chosen
by the index rows it writes and the chance meetings it leaves. A shared passage lets many classes
meet by chance, so only classes of one index entry are held against each other, by sizes and by
parity sketches: the bits in which two sketches differ are never more than the shingles in which
the sets differ, so no link is lost. A few classes of an entry are paired, more of them are a block
of their own, and those of entries too common for that come into one block where they are linked.
What is left together is compared exactly, tile against tile. A tile returns a spanning forest of
its links, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted
from plumbline.llm.common import components, picked, stored
from plumbline.llm.words import SPACED, Powers, grams, mix, slices, words_of

BAND = 1.4
#: What a chance meeting of two sets costs, in index rows.
MEETING = 4.0
#: A tile compares about this many sets, or this many shingles, with as many others.
TILE_SETS = 256
TILE_SHINGLES = 1 << 20
COLUMNS = 1 << 13
#: A tile of sketches holds about this many of them, or this many bytes, twice.
TILE_SKETCHES = 4096
TILE_BYTES = 1 << 22
#: Classes of an entry that are paired, that are one block, and that are linked at once within a batch.
PAIRED = 16
BLOCKED = 2048
MANY = 64
#: What a row of meetings is: two classes, a class and the entry that is its block, or two classes of one block.
PAIR, BLOCK, LINK = 0, 1, 2
#: Bits of the filter that keeps texts of no candidate out of the shuffle: 1 MB at every size.
MARKS = 1 << 23
#: Classes a task remembers so as to index copies once; a class it forgot is indexed again.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Scheme:
    """For sizes low..high, and smaller ones from ``reach`` on; the first ``near`` segments carry neighbours."""

    number: int
    low: int
    high: int
    reach: int
    segments: int
    near: int
    spare: int


def largest_difference(a: int, b: int, share: Fraction) -> int:
    """Most shingles in just one of two sets of sizes a and b with Jaccard similarity >= share."""
    return int((1 - share) * (a + b) / (1 + share))


def band_range(band: int) -> tuple[int, int]:
    low = math.ceil(BAND**band)
    return low, math.ceil(BAND ** (band + 1)) - 1


def band_of(size: int) -> int:
    band = int(math.log(size) / math.log(BAND))
    while band_range(band)[0] > size:
        band -= 1
    while band_range(band)[1] < size:
        band += 1
    return band


def allocate(low: int, high: int, sets: int, share: Fraction) -> tuple[int, int, int]:
    """(segments, of them with neighbours, spare ones) at the least estimated cost.

    A segment empty in both sets holds no difference, so a set need not index empty segments as
    long as it has no more than ``spare`` of them: they are added to what the difference needs,
    twice if neighbours are used, as a segment with neighbours then loses an allowance of two.
    """
    allowance = largest_difference(high, high, share) + 1
    best = None
    for near in sorted({allowance // 2 * k // 16 for k in range(17)}):
        base = allowance - near
        for spared in (False, True):
            spare = 0
            for _ in range(20 if spared else 0):
                empty = (base + spare) * math.exp(-low / (base + spare))
                spare = math.ceil(empty + 3 * math.sqrt(empty)) * (2 if near else 1)
                if spare > base:
                    break
            segments = base + spare
            if spare > base or spared and not spare:
                continue
            each = low / segments
            rows = segments + near * (1 + each)
            chance = near * (each * math.exp(-each)) ** 2 if spared else segments * math.exp(-2 * each) + near * 2 * each * math.exp(-2 * each)
            cost = sets * rows + MEETING * sets * sets * min(1.0, chance)
            if best is None or cost < best[0]:
                best = cost, segments, near, spare // 2 if near else spare
    return best[1:]


def schemes(sizes: dict[int, int], share: Fraction) -> dict[int, Scheme]:
    """One scheme for each band that holds sets or may be reached from one; none where only equal sets link."""
    out = {}
    for band in sorted({b + k for b in sizes for k in (-1, 0, 1) if b + k >= 0}):
        low, high = band_range(band)
        if low <= high and largest_difference(high, high, share) > 0:
            below = max(1, math.ceil(math.log(1 / share) / math.log(BAND)))
            sets = sum(sizes.get(band - k, 0) for k in range(below + 1))
            out[band] = Scheme(band, low, high, math.ceil(low * share), *allocate(low, high, sets, share))
    return out


def signatures(shingles: np.ndarray, s: Scheme) -> np.ndarray:
    """Index entries of one set under a scheme, each a hash of scheme, segment and content.

    A segment's content is the sum of its shingles' hashes, so a one-deletion neighbour is a
    subtraction. Sets write contents and neighbours alike; that two neighbours meet does no harm.
    """
    with np.errstate(over="ignore"):
        value = mix(shingles + np.uint64(s.number * 2 + 1))
        segment = ((value >> np.uint64(32)) % np.uint64(s.segments)).astype(np.int64)
        count = np.bincount(segment, minlength=s.segments)
        order = np.argsort(segment, kind="stable")
        running = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(value[order], out=running[1:])
        ends = np.cumsum(count)
        total = running[ends] - running[ends - count]
        name = mix(np.arange(s.segments, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s.number))
        full = count > 0 if int((count == 0).sum()) <= s.spare else np.ones(s.segments, dtype=bool)
        out = [mix(total + name)[full]]
        if s.near:
            of = segment < s.near
            out.append(mix(total[segment[of]] - value[of] + name[segment[of]]))
        return np.unique(np.concatenate(out))


def shingle_sets(texts, n: int, powers: Powers) -> list[np.ndarray]:
    """Sorted distinct n-word shingles of each row, the whole row where it has fewer words."""
    found = words_of(texts, SPACED, powers=powers)
    long = grams(found.hashes, n)
    out = []
    for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(long[a : b - n + 1]))
        else:
            out.append(grams(found.hashes[a:b], b - a) if b > a else long[:0])
    return out


def set_key(shingles: np.ndarray) -> bytes | None:
    """A set's 128-bit name; None for an empty set."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        a, b = mix(shingles + np.uint64(11)).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "little") + int(b).to_bytes(8, "little")


def parity(shingles: np.ndarray) -> bytes | None:
    """One bit for each shingle or more, a power of two of them: is the number of shingles hashed to it odd?"""
    if not len(shingles):
        return None
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    with np.errstate(over="ignore"):
        at = mix(shingles + np.uint64(29)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: bytes, words: int) -> np.ndarray:
    """The sketch the same set has at fewer 64-bit words."""
    out = np.frombuffer(sketch, dtype=np.uint64)
    while len(out) > words:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def number_of(key: bytes) -> int:
    """48 bits of a class's name. They only gather candidates; a class is told apart by the whole."""
    return int.from_bytes(key[:6], "big")


def _record(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _sets(batches, n: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in slices(batches):
        sets = shingle_sets(batch.column("text"), n, powers)
        found = [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.binary())]
        given = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in given], *found], names=[*given, "n_shingles", "class", "sketch"])


def _unseen(batches, n: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes], list[np.ndarray]]]:
    """Rows of classes the task has not met yet: their places, names and sets."""
    powers, seen = Powers(), set()
    for batch in slices(batches):
        if len(seen) > REMEMBERED:
            seen.clear()
        rows, keys, kept = [], [], []
        for i, s in enumerate(shingle_sets(batch.column("text"), n, powers)):
            key = set_key(s)
            if key is not None and key not in seen:
                seen.add(key)
                rows.append(i)
                keys.append(key)
                kept.append(s)
        yield batch, rows, keys, kept


def _entries(batches, n: int, plan: dict[int, Scheme], many: int) -> Iterator[pa.RecordBatch]:
    """(entry, class, null) for the index. More than ``many`` classes that meet within the batch are linked to one of them
    at once, as (any number, class, class), and it alone goes on, as (entry, class, itself): a hot entry is one row a batch."""
    for _, _, keys, sets in _unseen(batches, n):
        entries, owners = [], []
        for key, s in zip(keys, sets):
            band = band_of(len(s))
            for scheme in plan.values():
                if scheme.number >= band and len(s) >= scheme.reach:
                    entries.append(signatures(s, scheme))
                    owners.append(np.full(len(entries[-1]), number_of(key)))
        if not entries:
            continue
        entry, owner = np.concatenate(entries).view(np.int64), np.concatenate(owners)
        order = np.lexsort((owner, entry))
        entry, owner = entry[order], owner[order]
        again = np.zeros(len(entry), dtype=bool)
        again[1:] = entry[1:] == entry[:-1]
        first = np.maximum.accumulate(np.where(again, 0, np.arange(len(entry))))
        hot = np.bincount(first, minlength=len(entry))[first] > many
        gone = hot & again
        pairs = np.unique(np.stack([owner[first[gone]], owner[gone]], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        itself = pa.array(owner[~gone], pa.int64(), mask=~hot[~gone])
        yield pa.RecordBatch.from_arrays([pa.array(entry[~gone]), pa.array(owner[~gone]), itself], names=["entry", "a", "b"])
        if len(pairs):
            yield _record({"entry": (pairs[:, 0] ^ (pairs[:, 1] << 1), pa.int64()), "a": (pairs[:, 0], pa.int64()), "b": (pairs[:, 1], pa.int64())})


def _met(batches, paired: int, blocked: int) -> Iterator[pa.RecordBatch]:
    """(a, b, kind) of classes that share an entry; rows come sorted by entry and class.

    Up to ``paired`` classes are sent as pairs, up to ``blocked`` each with the entry's number. More of them, or those linked
    within a batch, are links with the first one.
    """

    def sent(a: np.ndarray, b: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        if len(a):
            yield _record({"a": (a, pa.int64()), "b": (b, pa.int64()), "kind": (np.full(len(a), kind), pa.int32())})

    def closed(entry: np.ndarray, a: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """What whole entries give."""
        if not len(entry):
            return
        fresh = np.append(True, entry[1:] != entry[:-1])
        hot = np.logical_or.reduceat(hot, np.flatnonzero(fresh))
        once = fresh | np.append(True, a[1:] != a[:-1])
        entry, a, fresh = entry[once], a[once], fresh[once]
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(a)))
        hot |= size > blocked
        few = ~hot & (size <= paired)
        pairs = [np.zeros((0, 2), dtype=np.int64)]
        for k in np.unique(size[few & (size > 1)]):
            i, j = np.triu_indices(k, 1)
            at = first[few & (size == k)][:, None]
            pairs.append(np.stack([a[at + i].ravel(), a[at + j].ravel()], axis=1))
        yield from sent(*np.unique(np.concatenate(pairs), axis=0).T, PAIR)
        block = np.repeat(~hot & ~few, size)
        yield from sent(a[block], entry[block], BLOCK)
        link = np.repeat(hot, size) & ~fresh
        links = np.unique(np.stack([np.repeat(a[first], size)[link], a[link]], axis=1), axis=0)
        yield from sent(*links.T, LINK)

    entry, a, hot = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    for batch in batches:
        new, b = batch.column("a").to_numpy(), batch.column("b").fill_null(-1).to_numpy()
        done = (b != -1) & (b != new)
        yield from sent(new[done], b[done], LINK)
        entry, a, hot = np.append(entry, batch.column("entry").to_numpy()[~done]), np.append(a, new[~done]), np.append(hot, b[~done] != -1)
        if not len(entry):
            continue
        # The last entry may go on in the next batch; one too common to be a block goes on as its first class.
        last = np.searchsorted(entry, entry[-1])
        yield from closed(entry[:last], a[:last], hot[:last])
        entry, a, hot = entry[last:], a[last:], hot[last:]
        if len(entry) > blocked + 1 and (hot.any() or len(np.unique(a)) > blocked):
            yield from closed(entry, a, np.ones(len(entry), dtype=bool))
            entry, a, hot = entry[:1], a[:1], np.ones(1, dtype=bool)
    yield from closed(entry, a, hot)


def marked(numbers: DataFrame) -> np.ndarray:
    """One bit for each remainder of the numbers by ``MARKS``. A number whose bit is not set is not among them."""
    words = numbers.select(F.expr(f"CAST(pmod(number, {MARKS}) DIV 64 AS INT)").alias("at"), F.expr("shiftleft(1L, CAST(pmod(number, 64) AS INT))").alias("bit"))
    out = np.zeros(MARKS // 64, dtype=np.int64)
    for r in words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[r["at"]] = r["bits"]
    return out


def _texts(batches, n: int, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch, rows, keys, _ in _unseen(batches, n):
        number = np.array([number_of(k) for k in keys], dtype=np.int64)
        wanted = (marks[number % MARKS // 64] >> (number % 64) & 1).astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(number[wanted]), batch.column("text").take(pa.array(np.array(rows, dtype=np.int64)[wanted]))], names=["number", "text"])


def linked(sets: list[np.ndarray], share: Fraction) -> np.ndarray:
    """For each set the first set of its component; sets link at the exact similarity."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.ones(len(every), dtype=bool)
    fresh[1:] = every[1:] != every[:-1]
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1  # a shingle of one set meets no other
    owner, column = owner[shared], column[shared]
    inter = np.zeros((len(sets), len(sets)), dtype=np.int64)
    if len(column):
        fresh = np.ones(len(column), dtype=bool)
        fresh[1:] = column[1:] != column[:-1]
        column = np.cumsum(fresh) - 1
        for low in range(0, int(column[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            has = np.zeros((len(sets), int(column[b - 1]) - low + 1), dtype=np.float32)
            has[owner[a:b], column[a:b] - low] = 1
            inter += (has @ has.T).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    near = share.denominator * inter >= share.numerator * union
    label = np.arange(len(sets))
    while True:
        lower = np.where(near, label[None, :], len(sets)).min(axis=1)
        lower = np.minimum(lower, label)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _runs(batches, columns: tuple[str, ...]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each key; rows come sorted by these columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in columns)))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if low == high:
                continue
            if held and keys[low] != last:
                yield held
                held = []
            last = keys[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield held


def alike(sketches: list[bytes], sizes: np.ndarray, share: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose sizes and sketches allow the similarity."""
    words = min(len(s) for s in sketches) // 8
    bits = np.stack([folded(s, words) for s in sketches])
    left, rest, size = np.arange(len(sketches)), bits, sizes
    out = []
    while len(left):
        queue = [left[0]]
        left, rest, size = left[1:], rest[1:], size[1:]
        while queue and len(left):
            i = queue.pop()
            apart = np.maximum(np.bitwise_count(rest ^ bits[i]).sum(axis=1, dtype=np.int64), np.abs(size - sizes[i]))
            near = apart * (share.denominator + share.numerator) <= (share.denominator - share.numerator) * (size + sizes[i])
            if near.any():
                found = left[near]
                out += [(int(i), int(k)) for k in found]
                queue += found.tolist()
                left, rest, size = left[~near], rest[~near], size[~near]
    return out


def _alike(batches, keys: tuple[str, ...], share: Fraction) -> Iterator[pa.RecordBatch]:
    """Pairs of classes that may link, as a forest for every key's sketches."""
    for rows in _runs(batches, keys):
        number = np.concatenate([r.column("number").to_numpy() for r in rows])
        sizes = np.concatenate([r.column("size").to_numpy() for r in rows])
        pairs = alike([s for r in rows for s in r.column("sketch").to_pylist()], sizes, share)
        if pairs:
            a, b = np.array(pairs).T
            yield _record({"a": (number[a], pa.int64()), "b": (number[b], pa.int64())})


def _compare(batches, n: int, share: Fraction) -> Iterator[pa.RecordBatch]:
    """Links of every tile; its rows come together, sorted by tile."""
    powers = Powers()
    for rows in _runs(batches, ("block", "i", "j")):
        by_key: dict[bytes, np.ndarray] = {}
        for r in rows:
            for s in shingle_sets(r.column("text"), n, powers):
                by_key.setdefault(set_key(s), s)
        keys = sorted(by_key)
        label = linked([by_key[k] for k in keys], share)
        own = np.flatnonzero(label != np.arange(len(keys)))
        yield _record({"a": ([keys[label[i]] for i in own], pa.binary()), "b": ([keys[i] for i in own], pa.binary())})


def _cells(member: DataFrame, keys: list[str], tiles: DataFrame) -> DataFrame:
    """Each member once for every pair of tiles of its block it belongs to, as tile i against tile j >= i."""
    at = member.join(tiles, keys).withColumn("at", F.pmod(F.xxhash64("number"), F.col("tiles")).cast("int"))
    every = at.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return every.withColumn("i", F.least("at", "with")).withColumn("j", F.greatest("at", "with")).drop("at", "with", "tiles")


def _likely(member: DataFrame, share: Fraction) -> DataFrame:
    """(a, b): classes of each block of (number, size, sketch, block) that may link, by sizes and sketches, as forests.

    Sizes of a link differ by a factor of at most 1 / share, which is the width of a step, so
    a class is compared in its own step and in the one below.
    """
    width = max(math.log(1 / share), 0.01) * (1 + 1e-6)
    step = F.floor(F.log("size") / width)
    spread = member.withColumn("step", F.explode(F.array(step, step - 1)))
    tiles = spread.groupBy("block", "step").agg(
        F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / TILE_SKETCHES), F.ceil(F.sum(F.octet_length("sketch")) / TILE_BYTES)).cast("int").alias("tiles")
    )
    cells = _cells(spread, ["block", "step"], tiles.where("n > 1").drop("n"))
    return _compared(cells, ["block", "step", "i", "j"], share)


def _compared(cells: DataFrame, keys: list[str], share: Fraction) -> DataFrame:
    """(a, b): pairs within each key's rows that may link, as a forest."""
    rows = cells.select(*keys, "number", "size", "sketch").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(lambda it: _alike(it, tuple(keys), share), "a bigint, b bigint")


def _held(batches, share: Fraction) -> Iterator[pa.RecordBatch]:
    """The pairs of classes whose sketches allow the similarity."""
    top, bottom = share.denominator - share.numerator, share.denominator + share.numerator
    for batch in batches:
        sketches = [batch.column(f"sketch_{c}") for c in "ab"]
        words = [pa.compute.binary_length(c).to_numpy() // 8 for c in sketches]
        apart = np.zeros(batch.num_rows, dtype=np.int64)
        for wa, wb in np.unique(np.stack(words, axis=1), axis=0):
            rows = np.flatnonzero((words[0] == wa) & (words[1] == wb))
            bits = [np.frombuffer(b"".join(c.take(pa.array(rows)).to_pylist()), dtype=np.uint64).reshape(len(rows), w) for c, w in zip(sketches, (wa, wb))]
            for k, width in enumerate((wa, wb)):
                while width > min(wa, wb):
                    width //= 2
                    bits[k] = bits[k][:, :width] ^ bits[k][:, width:]
            apart[rows] = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
        near = apart * bottom <= top * batch.column("sizes").to_numpy()
        if near.any():
            yield batch.select(["a", "b"]).filter(pa.array(near))


def _paired(pairs: DataFrame, sketches: DataFrame, share: Fraction) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    top, bottom = share.denominator - share.numerator, share.denominator + share.numerator
    for c in "ab":
        pairs = pairs.join(sketches.select(F.col("number").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
    pairs = pairs.where(f"abs(size_a - size_b) * {bottom} <= {top} * (size_a + size_b)")
    return pairs.select("a", "b", F.expr("size_a + size_b").alias("sizes"), "sketch_a", "sketch_b").mapInArrow(lambda it: _held(it, share), "a bigint, b bigint")


def near_groups(docs: DataFrame, n: int, share: float, id_col: str = "doc_id", text_col: str = "text", tile_sets: int = TILE_SETS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest id reachable by links.

    Words are runs without ASCII white space, ASCII capitals lowered; a set holds the distinct
    shingles of ``n`` words, or the whole sequence where there are fewer words. Null and empty texts
    have an empty set, no link, and their own id. Repeated rows are one class and are all
    returned. A row without id takes part, but never gives a component its name, which is null
    if no member has an id.
    """
    return _groups(picked(docs, {"doc_id": id_col, "text": text_col}, {"text": "string"}), n, share, tile_sets).select("doc_id", "n_shingles", "component_id")


def _groups(wanted: DataFrame, n: int, share: float, tile_sets: int = TILE_SETS) -> DataFrame:
    """near_groups of rows (doc_id, text and others), with the others, the class and its component's root."""
    exact = Fraction(str(share))
    given = ", ".join(f"{c} {t}" for c, t in wanted.dtypes if c != "text")
    rows = stored(wanted.mapInArrow(lambda it: _sets(it, n), f"{given}, n_shingles bigint, class binary, sketch binary"), "sets")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("size"))
    sizes = classes.groupBy(F.round(F.log("size") * 8).alias("step")).agg(F.count(F.lit(1)).alias("sets"), F.min("size").alias("size")).collect()
    bands: dict[int, int] = {}
    for r in sizes:
        bands[band_of(r["size"])] = bands.get(band_of(r["size"]), 0) + r["sets"]
    plan = schemes(bands, exact)

    texts = wanted.select("text")
    many, paired, blocked = MANY, PAIRED, BLOCKED
    index = texts.mapInArrow(lambda it: _entries(it, n, plan, many), "entry bigint, a bigint, b bigint")
    meets = stored(index.repartition("entry").sortWithinPartitions("entry", "a").mapInArrow(lambda it: _met(it, paired, blocked), "a bigint, b bigint, kind int"), "meets")
    joined = components(meets.where(F.col("kind") == LINK).select("a", "b")).select(F.col("node").alias("number"), F.col("root").alias("block"))
    met = meets.where(F.col("kind") == BLOCK).select(F.col("a").alias("number"), F.col("b").alias("block"))

    number = F.expr("CAST(conv(hex(substring(class, 1, 6)), 16, 10) AS BIGINT)").alias("number")
    sketches = rows.where("class IS NOT NULL").groupBy("class").agg(F.any_value("sketch").alias("sketch"), F.max("n_shingles").alias("size"))
    sketches = sketches.select(number, "size", "sketch")
    pairs = meets.where(F.col("kind") == PAIR).select("a", "b").distinct()
    # An entry's block is no more than half a tile.
    small = _compared(sketches.join(met, "number"), ["block"], exact)
    may = _likely(sketches.join(joined, "number"), exact).union(small).union(_paired(pairs, sketches, exact))
    blocks = components(may).select(F.col("node").alias("number"), F.col("root").alias("block"))

    member = classes.select(number, "size").join(blocks, "number")
    tiles = member.groupBy("block").agg(F.greatest(F.ceil(F.count(F.lit(1)) / tile_sets), F.ceil(F.sum("size") / TILE_SHINGLES)).cast("int").alias("tiles"))
    marks = marked(blocks)
    spread = texts.mapInArrow(lambda it: _texts(it, n, marks), "number bigint, text string").join(_cells(blocks, ["block"], tiles), "number")
    links = spread.select("block", "i", "j", "text").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(lambda it: _compare(it, n, exact), "a binary, b binary")
    roots = components(links).select(F.col("node").alias("class"), "root")

    grouped = classes.join(roots, "class", "left").select("class", "first_id", F.coalesce("root", "class").alias("root"))
    named = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = grouped.join(named, "root").select("class", "root", "component_id")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.drop("sketch").join(names, "class", "left").withColumn("component_id", own)


def representatives(docs: DataFrame, n: int, share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, that of the smallest id, with all its columns; rows without text stay, one of each id and text.

    If a group has rows of several texts under that id, the text of the least digest stays. A row without id
    stays only if no row of its group has an id, and then one for the group.
    """
    digest = lambda c: F.unhex(F.md5(F.coalesce(c, F.lit("")).cast("binary")))
    wanted = picked(docs, {"doc_id": id_col, "text": text_col}, {"text": "string"}).withColumn("digest", digest(F.col("text")))
    # A structure of the id equals itself also where the id is null. A text's digest stands for its set.
    key = F.struct(F.struct("doc_id").alias("rep__id"), F.col("digest").alias("rep__digest")).alias("key")
    first = _groups(wanted, n, share).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = first.where("class IS NOT NULL").groupBy("root").agg(F.min(key).alias("key")).select("key.*").union(first.where("class IS NULL").select(key).select("key.*").distinct())
    rows = docs.withColumn("rep__id", F.struct(quoted(id_col).alias("doc_id"))).withColumn("rep__digest", digest(quoted(text_col).cast("string")))
    copies = Window.partitionBy("rep__id", "rep__digest").orderBy(quoted(text_col))
    rows = rows.join(keep, ["rep__id", "rep__digest"], "left_semi").withColumn("rep__at", F.row_number().over(copies))
    return rows.where("rep__at = 1").select(*[quoted(c) for c in docs.columns])


def op9_jaccard(spark, sf: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf}/documents.parquet"), 3, 0.9)


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[pos : pos + least(3, len(words)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - least(3, len(words)) + 1)) AS pos FROM w WHERE len(words) > 0) t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.a = w.doc_id
"""
