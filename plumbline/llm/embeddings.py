"""Near copies among vectors: collisions on many sorted projections are counted for each pair, and
pairs with enough of them are verified by their cosine.

Vectors of one label (and length) are cut along one projection into cells, and cells that may hold a pair
face each other in a tile. In a tile every other projection is sorted; a window around
each query collects the vectors that collide with it. For a pair at the least cosine, the difference on a Gaussian
projection is normal with a known deviation, so the number of collisions is binomial, and the
count a pair must reach follows from the recall that is asked for. Exact copies are one class.
A tile returns numbers of links and a spanning forest, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import components, picked, stored

LEAST_COSINE = 0.93
PROJECTIONS = 32
#: Half of a window, in standard deviations of a projected difference at the least cosine.
WINDOW = 1.5
#: Share of the pairs at the least cosine that may be missed; nearer pairs are missed less.
MISS = 1e-9
CELL = 2048
BINS = 2048
SEED = 11
VERIFIED = 1 << 16


def distance(cosine: float) -> float:
    """Between unit vectors."""
    return math.sqrt(2 - 2 * cosine)


def least_count(projections: int = PROJECTIONS, window: float = WINDOW, miss: float = MISS) -> int:
    """The most collisions that all but ``miss`` of the pairs at the least cosine reach."""
    p = math.erf(window / math.sqrt(2))
    below, count = 0.0, 0
    while True:
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return count
        count += 1


def directions(size: int, count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, size])).normal(size=(size, count + 1))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _named(batches) -> Iterator[pa.RecordBatch]:
    """(vec_id, class, label, size, bin, vector): class names label and numbers; null where it cannot link."""
    for batch in batches:
        out = []
        lists = batch.column("vector").to_pylist()
        for label, numbers in zip(batch.column("label").to_pylist(), lists):
            x = None
            if label is not None and numbers and None not in numbers:
                x = np.array(numbers, dtype=np.float64)
                # Scaled first, so that neither huge nor tiny numbers leave the range of a square.
                top = np.abs(x).max()
                x = x / top if np.isfinite(x).all() and top > 0 else None
            if x is None:
                out.append((None, None, None, None))
                continue
            first = directions(len(x), 0)[:, 0]
            along = float(units(x[None])[0] @ (first / np.linalg.norm(first)))
            name = hashlib.blake2b(repr(label).encode() + b"|" + np.array(numbers, dtype=np.float64).tobytes(), digest_size=16).digest()
            out.append((name, len(x), math.floor(along * BINS), x.tobytes()))
        name, size, place, raw = zip(*out) if out else ([],) * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array(name, pa.binary()), pa.array(size, pa.int32()), pa.array(place, pa.int32()), pa.array(raw, pa.binary())],
            names=["vec_id", "label", "class", "size", "bin", "vector"],
        )


def collisions(left: np.ndarray, right: np.ndarray, half: float) -> np.ndarray:
    """How many projections put each right vector into the window around each left one."""
    count = np.zeros((len(left), len(right)), dtype=np.uint8)
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k], kind="stable")
        line = right[order, k]
        low, high = np.searchsorted(line, left[:, k] - half, "left"), np.searchsorted(line, left[:, k] + half, "right")
        for q, (a, b) in enumerate(zip(low.tolist(), high.tolist())):
            count[q, order[a:b]] += 1
    return count


def links(left: np.ndarray, right: np.ndarray, least_cosine: float, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in left, place in right) that collide often enough and pass the exact cosine."""
    turned = directions(left.shape[1], PROJECTIONS)[:, 1:]
    x, y = units(left), units(right)
    a, b = np.nonzero(collisions(x @ turned, y @ turned, WINDOW * distance(least_cosine)) >= needed)
    near = [np.einsum("ij,ij->i", x[a[i : i + VERIFIED]], y[b[i : i + VERIFIED]]) >= least_cosine for i in range(0, len(a), VERIFIED)]
    keep = np.concatenate(near) if near else np.zeros(0, bool)
    return a[keep], b[keep]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of n places."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((i, j))
    return out


def _tile(rows: list[pa.RecordBatch], diagonal: bool, least_cosine: float, needed: int) -> pa.RecordBatch:
    side = np.concatenate([r.column("second").to_numpy(zero_copy_only=False) for r in rows]).astype(bool)
    names = [n for r in rows for n in r.column("class").to_pylist()]
    weight = np.concatenate([r.column("copies").to_numpy() for r in rows])
    raw = [v for r in rows for v in r.column("vector").to_pylist()]
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    left = np.flatnonzero(~side)
    right = left if diagonal else np.flatnonzero(side)
    a, b = links(x[left], x[right], least_cosine, needed) if len(left) and len(right) else (np.zeros(0, int),) * 2
    a, b = left[a], right[b]
    if diagonal:
        a, b = a[a < b], b[a < b]
    total = np.bincount(a, weights=weight[b], minlength=len(names)) + np.bincount(b, weights=weight[a], minlength=len(names))
    some = np.flatnonzero(total)
    edges = forest(a, b, len(names))
    columns = [[names[i] for i in some] + [names[i] for i, _ in edges], [None] * len(some) + [names[j] for _, j in edges], total[some].astype(np.int64).tolist() + [0] * len(edges)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int64())], names=["a", "b", "n"])


def _tiles(batches, least_cosine: float, needed: int) -> Iterator[pa.RecordBatch]:
    """Tiles of one partition, one after the other; a tile's rows come together."""
    held, tile = [], None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "size", "i", "j"))))
        cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if low < high:
                if held and keys[low] != tile:
                    yield _tile(held, tile[2] == tile[3], least_cosine, needed)
                    held = []
                tile = keys[low]
                held.append(batch.slice(low, high - low))
    if held:
        yield _tile(held, tile[2] == tile[3], least_cosine, needed)


def _cells(classes: DataFrame, cell: int, least_cosine: float) -> tuple[DataFrame, DataFrame]:
    """(label, size, bin, cell, parts) for every bin, and the facing cells (label, size, i, j).

    Bins run along the first projection, on which a unit direction moves a pair by no more than its
    distance. Bins are taken together up to about ``cell`` classes; a bin that has more alone is cut by hash.
    """
    group = ["label", "size"]
    bins = classes.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("bin")) - F.col("n")
    cut = bins.withColumn("strip", F.floor(before / cell))
    strips = cut.groupBy(*group, "strip").agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.ceil(F.sum("n") / (2 * cell)).cast("int").alias("parts"))
    cut = cut.join(strips, [*group, "strip"]).select(*group, "bin", "strip", "parts")
    name = F.format_string("%012d-%06d", "strip", "part")
    each = strips.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*group, "low", "high", name.alias("cell"))
    other = each.select(*group, F.col("low").alias("low_j"), F.col("high").alias("high_j"), F.col("cell").alias("j"))
    reach = math.floor(distance(least_cosine) * BINS) + 1
    facing = each.join(other, group).where(f"cell <= j AND low_j - high <= {reach} AND low - high_j <= {reach}").select(*group, F.col("cell").alias("i"), "j")
    return cut, facing


def near_vectors(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", least_cosine: float = LEAST_COSINE, cell: int = CELL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link when their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least ``least_cosine``. A null, empty or zero vector, or one with a null or non-finite
    number, links with nothing and is its own component. A repeated row is another vector that its
    copies link with. Rows without id link, but never name a component, which is null if no member has an id.
    """
    wanted = picked(vectors, {"vec_id": id_col, "vector": vector_col, "label": label_col}, {"vector": "array<double>"})
    types = dict(wanted.dtypes)
    named = stored(wanted.mapInArrow(_named, f"vec_id {types['vec_id']}, label {types['label']}, class binary, size int, bin int, vector binary"), "vectors")
    classes = named.where("class IS NOT NULL").groupBy("class", "label", "size", "bin").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.min("vector").alias("vector"))
    classes = stored(classes, "vector-classes")
    bins, facing = _cells(classes, cell, least_cosine)
    name = F.format_string("%012d-%06d", "strip", F.pmod(F.xxhash64("class"), F.col("parts")))
    placed = classes.join(bins, ["label", "size", "bin"]).select("class", "label", "size", "copies", "vector", name.alias("cell"))
    as_i = facing.select("label", "size", F.col("i").alias("cell"), "i", "j", F.lit(False).alias("second"))
    as_j = facing.where("i <> j").select("label", "size", F.col("j").alias("cell"), "i", "j", F.lit(True).alias("second"))
    tiles = placed.join(as_i.unionByName(as_j), ["label", "size", "cell"]).drop("cell")
    needed = least_count()
    key = ["label", "size", "i", "j"]
    found = tiles.repartition(*key).sortWithinPartitions(*key).mapInArrow(lambda it: _tiles(it, least_cosine, needed), "a binary, b binary, n bigint")
    found = stored(found, "vector-links")
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "class")
    grouped = classes.select("class", "first_id", "copies").join(degree, "class", "left").join(roots, "class", "left")
    grouped = grouped.select("class", "first_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "class").alias("root"))
    names = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = grouped.join(names, "root").select("class", "n_links", "component_id")
    out = named.select("vec_id", "class").join(answer, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op4_embeddings(spark, sf: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


SQL = f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= {LEAST_COSINE}),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a) SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN r ON r.a = vec_id
"""
