"""How many groups, and which method finds them best?"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import for_passes, materialise, quoted, side_by_side
from plumbline.operators.cluster_metrics import cluster_count, point_strips, silhouette_squared, silhouettes
from plumbline.operators.neighbours import DensityScan, density_radius, distances, matrix, weighted_points

MICRO_CLUSTERS = 300
# k-means: rounds at most, the move of a centre that ends them, and draws of first centres.
ROUNDS = 50
MOVED = 1e-4
DRAWS = 2


def k_range(rows: int) -> list[int]:
    return list(range(2, min(11, max(3, rows // 50)) + 1))


def assemble(df: DataFrame, cols: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=output).transform(df)


@dataclass
class Centres:
    """Labels every row with its nearest centre, or with the group that centre is in."""

    centres: np.ndarray
    groups: np.ndarray
    cols: list[str]

    def transform(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        centres, groups = self.centres, self.groups
        vec = F.array(*[quoted(c).cast("double") for c in self.cols])

        def label(batches):
            for pdf in batches:
                if len(pdf):
                    nearest = distances(matrix(pdf["__x"]), centres).argmin(axis=1)
                    yield pdf.drop(columns="__x").assign(**{name: groups[nearest].astype("int32")})

        fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
        return df.withColumn("__x", vec).mapInPandas(label, f"{fields}, {name} int")


@dataclass
class Fit(Centres):
    """The best start of k-means for one number of clusters."""

    inertia: float
    silhouette: float | None


def fit_kmeans(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42, restarts: int = 10) -> Fit:
    """The best of several starts."""
    return fit_starts(df, cols, [k], seed, restarts)[k]


def fit_starts(df: DataFrame, cols: Sequence[str], ks: Sequence[int], seed: int = 42, restarts: int = 10) -> dict[int, Fit]:
    """The best of several starts for every k. All starts of all k share their passes over the rows.

    Equal rows are one weighted point. A start draws its first centres as k-means|| does, twice 2k points by weight and squared
    distance, and goes on until no centre moves by more than ``MOVED`` or after ``ROUNDS`` rounds. The draws come from
    hashes of the points, so they do not depend on how rows lie in tasks.
    """
    points = weighted_points(df, cols)
    n = points.count()
    data = for_passes(points.select("x", "w", F.xxhash64("x").alias("h")), n).cache()
    at = np.array(data.agg(*[F.sum(F.col("x")[j] * F.col("w")) / F.sum("w") for j in range(len(cols))]).first(), dtype=float)
    if not np.isfinite(at).all() or data.where(F.exists("x", lambda v: v.isNull())).limit(1).count():
        data.unpersist()
        raise ValueError("k-means needs columns without null, NaN or infinite values")
    starts = [(k, seed + r) for k in ks for r in range(restarts)]
    centres = _drawn(data, starts, at)
    inertia, stats, live = {}, {}, list(range(len(starts)))
    for turn in range(ROUNDS + 1):
        sums = _sums(data, {s: centres[s] for s in live}, at)
        for s in list(live):
            weight, total, square, cost = sums[s]
            moved = np.where(weight[:, None] > 0, total / np.maximum(weight, 1)[:, None], centres[s])
            step = np.sqrt(((moved - centres[s]) ** 2).sum(axis=1)).max()
            if turn == ROUNDS or step <= MOVED:
                inertia[s], stats[s] = cost, (weight, total, square)
                live.remove(s)
            else:
                centres[s] = moved
        if not live:
            break
    best = {k: min((s for s, (of, _) in enumerate(starts) if of == k), key=inertia.__getitem__) for k in ks}
    values = silhouettes(data, {k: (centres[s], *stats[s]) for k, s in best.items()}, at)
    data.unpersist()
    return {k: Fit(centres[s] + at, np.arange(len(centres[s])), list(cols), inertia[s], values[k]) for k, s in best.items()}


def _nearest(x: np.ndarray, centres: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every start, each row's nearest centre and the squared distance to it; one matrix product for all starts."""
    stacked = np.concatenate(list(centres.values()))
    score = (stacked * stacked).sum(axis=1) - 2.0 * (x @ stacked.T)
    begin = 0
    for s, own in centres.items():
        near = score[:, begin : begin + len(own)].argmin(axis=1)
        gap = x - own[near]
        yield s, near, (gap * gap).sum(axis=1)
        begin += len(own)


def _sums(data: DataFrame, centres: dict[int, np.ndarray], at: np.ndarray) -> dict[int, tuple]:
    """By start: weight, sum and summed squares of the rows nearest to each centre, and the cost of them all."""
    dims = len(at)

    def add(batches):
        stacked = np.concatenate(list(centres.values()))
        sums, cost = np.zeros((len(stacked), dims + 2)), dict.fromkeys(centres, 0.0)
        for x, w, _ in point_strips(batches, at, len(stacked)):
            square = (x * x).sum(axis=1)
            parts = np.column_stack([np.ones(len(x)), x, square]) * w[:, None]
            # A row for each centre, so that the least of a start's is taken over whole rows at once.
            score = (stacked * stacked).sum(axis=1)[:, None] - 2.0 * (stacked @ x.T)
            begin = 0
            for s, own in centres.items():
                block = score[begin : begin + len(own)]
                least = block.min(axis=0)
                hit = block == least
                if np.count_nonzero(hit) > len(x):
                    hit = block.argmin(axis=0) == np.arange(len(own))[:, None]
                sums[begin : begin + len(own)] += hit.astype(float) @ parts
                cost[s] += float(w @ np.maximum(least + square, 0.0))
                begin += len(own)
        place = [(s, i) for s, own in centres.items() for i in range(len(own))]
        yield pa.RecordBatch.from_pylist(
            [{"s": s, "i": i, "w": t[0], "cost": 0.0 if i else cost[s], "total": t[1:].tolist()} for (s, i), t in zip(place, sums)],
            pa.schema([("s", pa.int32()), ("i", pa.int32()), ("w", pa.float64()), ("cost", pa.float64()), ("total", pa.list_(pa.float64()))]),
        )

    parts = data.mapInArrow(add, "s int, i int, w double, cost double, total array<double>")
    wide = [F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(dims + 1)]
    out = {s: (np.zeros(len(c)), np.zeros((len(c), dims)), np.zeros(len(c)), np.zeros(len(c))) for s, c in centres.items()}
    # As many rows as centres.
    for r in parts.groupBy("s", "i").agg(F.sum("w").alias("w"), F.sum("cost").alias("cost"), *wide).collect():
        weight, total, square, cost = out[r["s"]]
        weight[r["i"]], cost[r["i"]], total[r["i"]], square[r["i"]] = r["w"], r["cost"], r[4:-1], r[-1]
    return {s: (weight, total, square, float(cost.sum())) for s, (weight, total, square, cost) in out.items()}


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) from a hash and a salt, by the finishing steps of splitmix64."""
    z = h.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _drawn(data: DataFrame, starts: Sequence[tuple[int, int]], at: np.ndarray) -> list[np.ndarray]:
    """First centres of every start: one point, then ``DRAWS`` times 2k more, joined to k by the weight they draw."""
    dims = len(at)
    found: list[np.ndarray] = [np.zeros((0, dims)) for _ in starts]
    for draw in range(DRAWS + 1):
        known = dict(enumerate(found))
        want = [1 if draw == 0 else 2 * k for k, _ in starts]

        def pick(batches, draw=draw, known=known, want=want):
            held = [(np.zeros(0), np.zeros((0, dims))) for _ in starts]
            for x, w, h in point_strips(batches, at, max(1, sum(map(len, known.values())))):
                pulls = {s: w * gap for s, _, gap in _nearest(x, known)} if draw else dict.fromkeys(known, w)
                for s, pull in pulls.items():
                    with np.errstate(divide="ignore"):
                        rank = np.log(_uniform(h, starts[s][1] * (DRAWS + 1) * 1000 + starts[s][0] * (DRAWS + 1) + draw)) / pull
                    first = np.argpartition(-rank, want[s] - 1)[: want[s]] if len(rank) > want[s] else np.arange(len(rank))
                    first = first[pull[first] > 0]
                    ranks, rows = np.concatenate([held[s][0], rank[first]]), np.concatenate([held[s][1], x[first]])
                    keep = np.argsort(-ranks, kind="stable")[: want[s]]
                    held[s] = ranks[keep], rows[keep]
            rows = [{"s": s, "rank": float(r), "x": x.tolist()} for s, (ranks, xs) in enumerate(held) for r, x in zip(ranks, xs)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("s", pa.int32()), ("rank", pa.float64()), ("x", pa.list_(pa.float64()))]))

        drawn = data.mapInArrow(pick, "s int, rank double, x array<double>")
        place = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("rank"), "x"))
        limit = F.element_at(F.array(*[F.lit(n) for n in want]), F.col("s") + 1)
        rows = drawn.withColumn("place", place).where(F.col("place") <= limit).orderBy("s", "place").collect()
        for s in range(len(starts)):
            more = [r["x"] for r in rows if r["s"] == s]
            found[s] = np.concatenate([found[s], np.array(more, dtype=float).reshape(len(more), dims)])
    pulled = _sums(data, dict(enumerate(found)), at)
    return [_joined(c, pulled[s][0], *starts[s]) for s, c in enumerate(found)]


def _joined(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres of a few weighted points: k-means++ and then rounds until no point changes its centre."""
    if len(points) <= k:
        return points
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
    while len(chosen) < k:
        pull = weight * (distances(points, points[chosen]) ** 2).min(axis=1)
        if not pull.sum() > 0:
            break
        chosen.append(int(rng.choice(len(points), p=pull / pull.sum())))
    centres, before = points[chosen], None
    for _ in range(30):
        near = distances(points, centres).argmin(axis=1)
        if before is not None and (near == before).all():
            break
        mass = np.bincount(near, weight, len(centres))
        total = np.stack([np.bincount(near, weight * points[:, j], len(centres)) for j in range(points.shape[1])], axis=1)
        centres, before = np.where(mass[:, None] > 0, total / np.where(mass > 0, mass, 1.0)[:, None], centres), near
    return centres


def kmeans_sweep(
    df: DataFrame, cols: Sequence[str], ks: Sequence[int] | None = None, seed: int = 42, restarts: int = 10
) -> tuple[DataFrame, dict[int, Fit]]:
    """(k, inertia, silhouette) for every k, and the fitted models."""
    ks = list(ks or k_range(df.count()))
    models = fit_starts(df, cols, ks, seed, restarts)
    rows = [(k, float(models[k].inertia), models[k].silhouette) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double"), models


def elbow(curve: DataFrame) -> DataFrame:
    """Distance of every point of the (k, inertia) curve to its chord; one row per k."""
    ends = curve.agg(
        F.min_by("k", "k").alias("k0"), F.min_by("inertia", "k").alias("i0"),
        F.max_by("k", "k").alias("k1"), F.max_by("inertia", "k").alias("i1"),
    ).first()
    dk, di = float(ends["k1"] - ends["k0"]), ends["i1"] - ends["i0"]
    length = float(np.hypot(dk, di))
    cross = F.lit(dk) * (F.lit(ends["i0"]) - F.col("inertia")) - F.lit(di) * (F.lit(float(ends["k0"])) - F.col("k"))
    return curve.withColumn("bend", F.abs(cross) / F.lit(length or 1.0))


def choose_k(curve: DataFrame, k: int | None = None) -> DataFrame:
    """Best k by silhouette and by elbow; silhouette decides unless the caller does."""
    out = elbow(curve).agg(
        F.min_by("k", F.struct(-F.col("silhouette"), F.col("k"))).alias("by_silhouette"),
        F.min_by("k", F.struct(-F.col("bend"), F.col("k"))).alias("by_elbow"),
    )
    chosen = F.lit(k) if k is not None else F.col("by_silhouette")
    return out.select("by_silhouette", "by_elbow", chosen.cast("int").alias("k"))


def nearest_centre(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]], name: str = "cluster") -> DataFrame:
    """Number of the nearest of a few fixed centres, as a column expression."""
    options = []
    for i, c in enumerate(centres):
        d = sum(((quoted(x) - F.lit(float(v))) * (quoted(x) - F.lit(float(v))) for x, v in zip(cols, c)), F.lit(0.0))
        options.append(F.struct(d.alias("d"), F.lit(i).alias("i")))
    return df.withColumn(name, F.array_min(F.array(*options))["i"])


def _merge(centres: np.ndarray, sizes: np.ndarray, k: int, linkage: str) -> np.ndarray:
    """Join the closest groups until k are left; groups start as weighted centres."""
    n = len(centres)
    d = distances(centres, centres)
    if linkage == "ward":
        d = d * np.sqrt(2 * np.outer(sizes, sizes) / np.add.outer(sizes, sizes))
    np.fill_diagonal(d, np.inf)
    member = np.arange(n)
    weight = sizes.astype(float).copy()
    alive = np.ones(n, dtype=bool)
    for _ in range(n - k):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        i, j = min(i, j), max(i, j)
        wi, wj, w = weight[i], weight[j], weight
        if linkage == "complete":
            row = np.maximum(d[i], d[j])
        elif linkage == "average":
            row = (wi * d[i] + wj * d[j]) / (wi + wj)
        else:
            with np.errstate(invalid="ignore"):
                row = np.sqrt(((wi + w) * d[i] ** 2 + (wj + w) * d[j] ** 2 - w * d[i, j] ** 2) / (wi + wj + w))
        row[~alive] = np.inf
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        weight[i] += weight[j]
        alive[j] = False
        member[member == j] = i
    return np.unique(member, return_inverse=True)[1]


@dataclass
class Hierarchy(Centres):
    """Micro-cluster centres (a bounded number) and the group each one ended in."""


def micro_clusters(df: DataFrame, cols: Sequence[str], seed: int = 42, micro: int = MICRO_CLUSTERS) -> tuple[np.ndarray, np.ndarray]:
    """Centres and sizes of a bounded number of groups; the points themselves where no more are distinct."""
    vec = F.array(*[quoted(c).cast("double") for c in cols])
    points = df.groupBy(vec.alias("x")).agg(F.count(F.lit(1)).alias("n"))
    few = points.limit(micro + 1).collect()
    if len(few) <= micro:
        few = sorted(few, key=lambda r: r["x"])
        return np.array([r["x"] for r in few]), np.array([r["n"] for r in few])
    model = KMeans(k=micro, seed=seed, maxIter=20, featuresCol="features").fit(assemble(df, cols))
    centres, sizes = np.array(model.clusterCenters()), np.array(model.summary.clusterSizes)
    return centres[sizes > 0], sizes[sizes > 0]


def hierarchical(df: DataFrame, cols: Sequence[str], k: int, linkage: str, seed: int = 42, micro: int = MICRO_CLUSTERS) -> Hierarchy:
    """Micro-clusters on Spark, then linkage of their weighted centres.

    A table with no more distinct points than micro-clusters is linked point by point.
    """
    return _linked(*micro_clusters(df, cols, seed, micro), cols, k, linkage)


def _linked(centres: np.ndarray, sizes: np.ndarray, cols: Sequence[str], k: int, linkage: str) -> Hierarchy:
    return Hierarchy(centres, _merge(centres, sizes, min(k, len(centres)), linkage), list(cols))


def bisecting(df: DataFrame, cols: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Top-down splitting, Spark's own hierarchical method."""
    data = assemble(df, cols)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).drop("features")


def best_by_silhouette(candidates: DataFrame) -> DataFrame:
    """The first candidate with the largest silhouette; a later one must be strictly better."""
    w = Window.orderBy(F.desc_nulls_last("silhouette"), "step")
    # One row per method tried, a handful in all.
    return candidates.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


@dataclass
class Clustering:
    name: str
    kind: str
    silhouette: float | None
    labelled: DataFrame
    model: Any
    curve: DataFrame
    candidates: DataFrame


def discover(
    df: DataFrame, cols: Sequence[str], *, k: int | None = None, seed: int = 42, restarts: int = 10,
    density: bool = True, keep: Sequence[str] = (),
) -> Clustering:
    """Try k-means, density and hierarchical clusters; keep the best silhouette."""
    spark = df.sparkSession

    def dense() -> list[tuple]:
        points = weighted_points(df, cols)
        eps = density_radius(df, cols, points=points)
        if not eps or eps <= 0:
            return []
        scan = DensityScan(df, cols, eps, points)

        def at_least(m: int) -> tuple | None:
            labelled = materialise(scan.clusters(m, keep=keep))
            if cluster_count(labelled).first()["clusters"] > 1:
                return f"density eps={eps:.2f} min={m}", "density", silhouette_squared(labelled, cols).first()["silhouette"], labelled, None
            return None

        return [t for t in side_by_side(spark, [lambda m=m: at_least(m) for m in (3, 5, 10)]) if t]

    (curve, models), groups, scanned = side_by_side(spark, [
        lambda: kmeans_sweep(df, cols, seed=seed, restarts=restarts),
        lambda: micro_clusters(df, cols, seed),
        lambda: dense() if density else [],
    ])
    choice = choose_k(curve, k).first()["k"]
    model = models.get(choice) or fit_kmeans(df, cols, choice, seed, restarts)

    def linked(linkage: str) -> tuple:
        h = _linked(*groups, cols, choice, linkage)
        labelled = h.transform(df)
        return f"hierarchical {linkage}", "hierarchical", silhouette_squared(labelled, cols).first()["silhouette"], labelled, h

    tried = [(f"kmeans k={choice}", "kmeans", model.silhouette, model.transform(df), model), *scanned]
    tried += side_by_side(spark, [lambda x=x: linked(x) for x in ("ward", "complete", "average")])
    tried = [(i, *t) for i, t in enumerate(tried)]
    table = spark.createDataFrame([t[:4] for t in tried], "step int, name string, kind string, silhouette double")
    won = tried[best_by_silhouette(table).first()["step"]]
    return Clustering(won[1], won[2], won[3], won[4], won[5], curve, table)
