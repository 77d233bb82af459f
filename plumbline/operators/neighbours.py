"""Exact nearest neighbours and density clusters without pairing every two rows.

Equal rows are combined into weighted points. Points are assigned to the nearest of a
bounded number of pivots; a pivot's cell only receives points the triangle inequality
cannot rule out. Cells are cut into blocks of bounded size on both sides, so a hot cell
becomes many tasks, and a block emits a few rows per point, never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import Ledger, materialise, quoted, stored
from plumbline.operators.ordering import bucketed, cumulate, quantiles, skew_lookup

MAX_PIVOTS = 1000
BLOCK_ROWS = 2048
# Rows of a block where the pivots rule little out, rows of it that are measured at a time, and dimensions from which products in double precision screen the pairs.
TILE_ROWS = 8192
STRIP_ROWS = 512
SCREENED_DIMS = 8
# Groups of columns whose least distances bound the nearest ones, pairs a row that a coarse screen may leave to be measured, and
# links of a block that are listed at a time.
GROUPS = 64
LEFT = 16
LISTED = 4_000_000
# Rounding must never rule out a neighbour.
SLACK = 1 + 1e-9


def vector(cols: Sequence[str]) -> Column:
    # Adding zero turns -0.0 into 0.0, so equal points have equal arrays.
    return F.array(*[quoted(c).cast("double") + F.lit(0.0) for c in cols])


def weighted_points(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(pid, x, w): every distinct point once, with the number of rows it stands for."""
    points = df.select(vector(cols).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("w"))
    return materialise(points.select(F.monotonically_increasing_id().alias("pid"), "x", "w"))


def choose_pivots(points: DataFrame, limit: int = MAX_PIVOTS) -> np.ndarray:
    """About sqrt(n) points with the smallest hashes."""
    m = min(limit, max(1, math.isqrt(points.count())))
    rows = points.orderBy(F.xxhash64("x"), "x").limit(m).select("x").collect()
    return np.array([r["x"] for r in rows], dtype=float)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences; equal points are exactly 0 apart."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        total += d * d
    return np.sqrt(total)


def _screened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Squared distances by one matrix product and what they may be wrong by, or None where plain ones are cheaper or safer."""
    if a.shape[1] < SCREENED_DIMS:
        return None
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    total = aa[:, None] + bb[None, :] - 2.0 * (a @ b.T)
    slack = 1e-14 * a.shape[1] * float(aa.max(initial=0.0) + bb.max(initial=0.0)) + 1e-300
    return (total, slack) if np.isfinite(total).all() else None


def _coarse(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Squared distances by one matrix product in single precision and what they may be wrong by, or None where they may not fit it."""
    dims = a.shape[1]
    if not len(a) or not len(b):
        return None
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    most = float(aa.max() + bb.max())
    if not most < 1e36:
        return None
    left = np.column_stack([-2.0 * a, aa, np.ones(len(a))]).astype(np.float32)
    right = np.column_stack([b, np.ones(len(b)), bb]).astype(np.float32)
    return left @ right.T, (dims + 8) * 2.0**-21 * most + 1e-34


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``distances`` row by row, with the same sums in the same order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        d = a[:, j] - b[:, j]
        total += d * d
    return np.sqrt(total)


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """``distances(a, b) <= eps``; only pairs too near the limit to tell are measured plainly."""
    found = _coarse(a, b)
    if found is not None and eps * eps < 1e36:
        total, slack = found
        hit, maybe = total <= np.float32(eps * eps - 2 * slack), total <= np.float32(eps * eps + 2 * slack)
        if np.count_nonzero(maybe) - np.count_nonzero(hit) <= LEFT * len(a):
            i, j = divmod(np.flatnonzero(maybe ^ hit), len(b))
            hit[i, j] = _paired(a[i], b[j]) <= eps
            return hit
    found = _screened(a, b)
    if found is None:
        return distances(a, b) <= eps
    total, slack = found
    hit = total <= eps * eps
    i, j = np.nonzero(np.abs(total - eps * eps) <= slack + 1e-14 * eps * eps)
    hit[i, j] = _paired(a[i], b[j]) <= eps
    return hit


def closest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and distances (rows of ``a``, k) of the k nearest rows of ``b``, in no order."""
    take = min(k, len(b))
    found = _coarse(a, b)
    if found is not None:
        total, slack = found
        # The k-th of the groups' least distances bounds the k-th of all.
        groups = max(GROUPS, 2 * take)
        least = total if len(b) < 2 * groups else total[:, : len(b) // groups * groups].reshape(len(a), -1, groups).min(axis=1)
        limit = np.partition(least, take - 1, axis=1)[:, take - 1]
        maybe = total <= (limit + np.float32(3 * slack))[:, None]
        if np.count_nonzero(maybe) <= (LEFT + 4 * take) * len(a):
            i, j = divmod(np.flatnonzero(maybe), len(b))
            return _nearest_of(len(a), i, j, _paired(a[i], b[j]), take)
    found = _screened(a, b)
    if found is None:
        d = distances(a, b)
        idx = np.argpartition(d, take - 1, axis=1)[:, :take]
        return idx, np.take_along_axis(d, idx, axis=1)
    total, slack = found
    limit = np.partition(total, take - 1, axis=1)[:, take - 1]
    i, j = np.nonzero(total <= limit[:, None] + 2 * slack)
    return _nearest_of(len(a), i, j, _paired(a[i], b[j]), take)


def _nearest_of(rows: int, i: np.ndarray, j: np.ndarray, d: np.ndarray, take: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (row, number, distance) sorted by row, at least ``take`` for each, the nearest ``take`` of every row."""
    order = np.lexsort((j, d, i))
    first = np.searchsorted(i, np.arange(rows))[:, None] + np.arange(take)
    return j[order][first], d[order][first]


def strips(rows: int) -> Iterator[slice]:
    return (slice(s, s + STRIP_ROWS) for s in range(0, rows, STRIP_ROWS))


def matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, 1))


def assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot (``cell``) and the distance to it (``reach``)."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(matrix(pdf["x"]), pivots)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), reach=d[np.arange(len(pdf)), cell])

    fields = ", ".join(f"{c} {t}" for c, t in points.dtypes)
    return points.mapInPandas(nearest, f"{fields}, cell int, reach double")


def _radii(assigned: DataFrame, m: int) -> np.ndarray:
    out = np.full(m, -1.0)
    for r in assigned.groupBy("cell").agg(F.max("reach").alias("r")).collect():
        out[r["cell"]] = r["r"]
    return out


def _knn_bounds(assigned: DataFrame, pivots: np.ndarray, radii: np.ndarray, k: int) -> np.ndarray:
    """Per cell, a distance within which every one of its points surely has k points."""
    kth = np.full(len(pivots), np.inf)
    w = Window.partitionBy("cell").orderBy("reach", "pid")
    # row_number <= k is cut before the shuffle, so a hot cell sends k rows per task.
    top = assigned.select("cell", "reach", F.row_number().over(w).alias("i")).where(F.col("i") <= k)
    for r in top.where(F.col("i") == k).collect():
        kth[r["cell"]] = r["reach"]
    between = distances(pivots, pivots)
    return radii + (between + kth[None, :]).min(axis=1)


def _blocks(
    left: DataFrame, right: DataFrame, pivots: np.ndarray, limits: np.ndarray, carry: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (cell, lb, rb). ``limits`` bounds the distance of a partner to the pivot.

    Where the pivots rule so little out that cells take more copies of points than plain tiles do, there is one cell of tiles.
    """
    m = len(pivots)
    bound = limits * SLACK + 1e-12
    extra = [c for c in ("pid", "x", *carry)]

    def reached(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(m, dtype="int64")
        for pdf in batches:
            for s in range(0, len(pdf), 1024):
                counts += (distances(matrix(pdf["x"].iloc[s : s + 1024]), pivots) <= bound[None, :]).sum(axis=0)
        yield pd.DataFrame({"cell": np.arange(m, dtype="int32"), "n": counts})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 1024):
                part = pdf.iloc[s : s + 1024]
                row, cell = np.nonzero(distances(matrix(part["x"]), pivots) <= bound[None, :])
                yield part.iloc[row].assign(cell=cell.astype("int32"))

    types = dict(right.dtypes)
    fields = ", ".join(f"{c} {types[c]}" for c in extra)
    sizes_l = _cell_sizes(left, m)
    sizes_r = np.zeros(m)
    for r in right.select("x").mapInPandas(reached, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        sizes_r[r["cell"]] = r["n"]
    n_l = np.maximum(1, np.ceil(sizes_l / BLOCK_ROWS)).astype(int)
    n_r = np.maximum(1, np.ceil(sizes_r / BLOCK_ROWS)).astype(int)
    all_l, all_r = sizes_l.sum(), right.count()
    tiles_l, tiles_r = max(1, math.ceil(all_l / TILE_ROWS)), max(1, math.ceil(all_r / TILE_ROWS))
    if all_l * tiles_r + all_r * tiles_l < (sizes_l * n_r + sizes_r * n_l).sum():
        left, sent = left.withColumn("cell", F.lit(0)), right.select(*[F.col(c).alias(c) for c in extra], F.lit(0).alias("cell"))
        n_l, n_r = np.array([tiles_l]), np.array([tiles_r])
    else:
        sent = right.select(*extra).mapInPandas(spread, f"{fields}, cell int")

    def at(counts: np.ndarray) -> Column:
        return F.element_at(F.array(*[F.lit(int(c)) for c in counts]), F.col("cell") + 1)

    def cut(n: np.ndarray) -> Column:
        return F.pmod(F.xxhash64("pid", F.lit("block")), at(n)).cast("int")

    def every(n: np.ndarray) -> Column:
        return F.explode(F.sequence(F.lit(0), at(n) - 1))

    a = left.withColumn("lb", cut(n_l)).select("*", every(n_r).alias("rb"))
    b = sent.withColumn("rb", cut(n_r)).select("*", every(n_l).alias("lb"))
    return a, b


def _cell_sizes(df: DataFrame, m: int) -> np.ndarray:
    out = np.zeros(m)
    for r in df.groupBy("cell").count().collect():
        out[r["cell"]] = r["count"]
    return out


def _meet(a: DataFrame, b: DataFrame, fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    keys = ["cell", "lb", "rb"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(fn, schema)


def nearest_points(points: DataFrame, k: int, vectors: bool = True) -> DataFrame:
    """(pid, x, w, near): the k nearest distinct points of every point, itself included.

    ``near`` holds (d, w, y) in order of distance, y on request only; with weights it covers k rows at least.
    """
    pivots = choose_pivots(points)
    assigned = materialise(assign(points, pivots))
    radii = _radii(assigned, len(pivots))
    limits = radii + _knn_bounds(assigned, pivots, radii, k)
    limits[radii < 0] = -1.0
    a, b = _blocks(assigned, points, pivots, limits, ["w"])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"pid": [], "near": []})
        ys, ws = matrix(right["x"]), right["w"].to_numpy()
        xs, near = matrix(left["x"]), []
        for strip in strips(len(xs)):
            for row, ds in zip(*closest(xs[strip], ys, k)):
                near.append([{"d": float(d), "w": int(ws[j]), **({"y": ys[j].tolist()} if vectors else {})} for j, d in zip(row, ds)])
        return pd.DataFrame({"pid": left["pid"].to_numpy(), "near": near})

    near_type = f"array<struct<d:double,w:bigint{',y:array<double>' if vectors else ''}>>"
    found = _meet(a, b, best, f"pid bigint, near {near_type}")
    merged = found.groupBy("pid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return points.join(merged, "pid")


def _at_rank(near: Column, k: int) -> Column:
    """Distance at which the weights reach k rows."""
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("d"))
    walked = F.aggregate(
        near, start,
        lambda s, e: F.when(s["seen"] >= k, s).otherwise(
            F.struct((s["seen"] + e["w"]).alias("seen"), e["d"].alias("d"))
        ),
    )
    return walked["d"]


def _point_distances(points: DataFrame, k: int) -> DataFrame:
    """(x, w, distance): how far every distinct point's k-th row is; kept, as lookups and the passes of a quantile read it again and again."""
    return materialise(nearest_points(points, k, vectors=False).select("x", "w", _at_rank(F.col("near"), k).alias("distance")))


def neighbour_distance(df: DataFrame, cols: Sequence[str], k: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """Distance of every row to its k-th nearest row, counting the row itself."""
    total = df.count()
    table = _point_distances(weighted_points(df, cols), k).select("x", F.col("w").alias("n"), F.lit(total).alias("total"), "distance")
    rows = df.select(*[quoted(c) for c in keep], vector(cols).alias("x"))
    return skew_lookup(rows, table, ["x"], ["distance"]).drop("x")


def density_radius(df: DataFrame, cols: Sequence[str], k: int = 5, share: float = 0.9, points: DataFrame | None = None) -> float:
    """The quantile, over all rows, of the k-th neighbour distance that density clustering uses."""
    found = _point_distances(weighted_points(df, cols) if points is None else points, k)
    # A point is its number of rows again, some at a time.
    runs = found.select("distance", F.col("w").cast("bigint").alias("w"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(w - 1) DIV 4096"))).alias("run"))
    rows = runs.select(F.explode(F.array_repeat("distance", F.least(F.lit(4096), F.col("w") - 4096 * F.col("run")).cast("int"))).alias("distance"))
    return quantiles(rows, ["distance"], [share])["distance"][0]


class DensityScan:
    """Density clusters at one radius; neighbour counts serve every ``min_samples``."""

    def __init__(self, df: DataFrame, cols: Sequence[str], eps: float, points: DataFrame | None = None):
        self.df, self.cols, self.eps = df, list(cols), eps
        self.total = df.count()
        points = weighted_points(df, cols) if points is None else points
        self.pivots = choose_pivots(points)
        assigned = materialise(assign(points, self.pivots))
        self.limits = _radii(assigned, len(self.pivots))
        self.limits = np.where(self.limits < 0, -1.0, self.limits + eps)
        a, b = _blocks(assigned, points, self.pivots, self.limits, ["w"])

        def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"pid": [], "around": []})
            xs, ys, ws = matrix(left["x"]), matrix(right["x"]), right["w"].to_numpy()
            around = [within(xs[strip], ys, eps) @ ws for strip in strips(len(xs))]
            return pd.DataFrame({"pid": left["pid"].to_numpy(), "around": np.concatenate(around)})

        around = _meet(a, b, count, "pid bigint, around bigint").groupBy("pid").agg(F.sum("around").alias("around"))
        self.points = materialise(assigned.join(around, "pid"))

    def clusters(self, min_samples: int, keep: Sequence[str] = ()) -> DataFrame:
        """Every row with its cluster number, -1 for noise.

        A border point joins the cluster of its nearest core point.
        """
        core = self.points.where(F.col("around") >= min_samples)
        labels = self._components(core)
        border = self._attach(self.points.where(F.col("around") < min_samples), core, labels)
        named = labels.select("pid", "label").unionByName(border)
        numbers = _numbered(labels)
        table = (
            self.points.join(named, "pid", "left").join(F.broadcast(numbers) if self._few(numbers) else numbers, "label", "left")
            .select("x", F.col("w").alias("n"), F.lit(self.total).alias("total"), F.coalesce("number", F.lit(-1)).alias("cluster"))
        )
        rows = self.df.select(*[quoted(c) for c in keep], *[quoted(c) for c in self.cols if c not in keep], vector(self.cols).alias("x"))
        return skew_lookup(rows, table, ["x"], ["cluster"]).drop("x")

    @staticmethod
    def _few(numbers: DataFrame, limit: int = 100_000) -> bool:
        return numbers.limit(limit + 1).count() <= limit

    def _components(self, core: DataFrame) -> DataFrame:
        """(pid, label): connected core points share the smallest pid of the component."""
        eps = self.eps
        a, b = _blocks(core, core, self.pivots, self.limits, [])

        def stars(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """Link every point of the block to one point of its component in the block."""
            if not len(left) or not len(right):
                return pd.DataFrame({"u": [], "v": []})
            lp, rp = left["pid"].to_numpy(), right["pid"].to_numpy()
            u, v = np.concatenate([lp, rp]), np.concatenate(starred(matrix(left["x"]), matrix(right["x"]), lp, rp, eps))
            return pd.DataFrame({"u": u, "v": v})[u != v].drop_duplicates()

        edges = _meet(a, b, stars, "u bigint, v bigint").distinct()
        edges = materialise(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        return connected(core.select("pid"), edges)

    def _attach(self, loose: DataFrame, core: DataFrame, labels: DataFrame) -> DataFrame:
        eps = self.eps
        a, b = _blocks(loose, core.join(labels, "pid"), self.pivots, self.limits, ["label"])

        def attach(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"pid": [], "d": [], "label": []})
            xs, ys = matrix(left["x"]), matrix(right["x"])
            found = [closest(xs[strip], ys, 1) for strip in strips(len(xs))]
            i, best = (np.concatenate(c)[:, 0] for c in zip(*found))
            out = pd.DataFrame({"pid": left["pid"].to_numpy(), "d": best, "label": right["label"].to_numpy()[i]})
            return out[best <= eps]

        return _meet(a, b, attach, "pid bigint, d double, label bigint").groupBy("pid").agg(
            F.min_by("label", F.struct("d", "label")).alias("label")
        )


def starred(xs: np.ndarray, ys: np.ndarray, lab_l: np.ndarray, lab_r: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """The smallest label of each point's component among the points of both sides, linked where a pair is within ``eps``.

    Links are listed, so a round costs as much as there are links; more than ``LISTED`` of them are settled some at a time.
    """
    lab_l, lab_r = lab_l.copy(), lab_r.copy()
    listed, waits = [], 0
    # A label met later may lower others that were settled before; then all strips are gone through again.
    while True:
        before = lab_l.copy(), lab_r.copy()
        again = False
        for strip in strips(len(xs)):
            at = np.flatnonzero(within(xs[strip], ys, eps))
            listed.append((at // len(ys) + strip.start, at % len(ys)))
            waits += len(at)
            if waits > LISTED:
                _settle(listed, lab_l, lab_r)
                listed, waits, again = [], 0, True
        _settle(listed, lab_l, lab_r)
        listed, waits = [], 0
        if not again or ((before[0] == lab_l).all() and (before[1] == lab_r).all()):
            return lab_l, lab_r


def _settle(listed: list, lab_l: np.ndarray, lab_r: np.ndarray) -> None:
    """Lower the labels of both sides until no listed link (i, j) joins two of them."""
    i, j = (np.concatenate([pair[side] for pair in listed]) if listed else np.zeros(0, dtype=int) for side in (0, 1))
    while True:
        low = np.minimum(lab_l[i], lab_r[j])
        if (lab_l[i] == low).all() and (lab_r[j] == low).all():
            return
        np.minimum.at(lab_l, i, low)
        np.minimum.at(lab_r, j, lab_l[i])


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(pid, label) with the smallest pid of each component; edges go both ways.

    Each round takes the smallest label among the neighbours, then follows the label's
    own label, so the number of rounds grows with the logarithm of the diameter. Labels
    shared by many nodes are broadcast. Every round is written and read again: a checkpoint would hand what Spark
    has inferred of its columns on to the next round, which doubles with every round. A round's tables go with the next.
    """
    total = nodes.count()
    labels, before = nodes.select("pid", F.col("pid").alias("label")), None
    while True:
        with Ledger(nodes.sparkSession) as written:
            heard = edges.join(labels, edges.v == labels.pid).groupBy("u").agg(F.min("label").alias("heard"))
            step = labels.join(heard, labels.pid == heard.u, "left").select(
                "pid", F.col("label").alias("old"), F.least("label", "heard").alias("label")
            )
            step = stored(step, "heard")
            uses = step.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
            jump = uses.join(
                step.select(F.col("pid").alias("label"), F.col("label").alias("root")), "label"
            ).withColumn("total", F.lit(total))
            step = stored(skew_lookup(step, jump, ["label"], ["root"]).select("pid", "old", F.col("root").alias("label")), "jumped")
        if before is not None:
            before.close()
        labels, before = step.select("pid", "label"), written
        if step.where(F.col("old") != F.col("label")).isEmpty():
            found = materialise(labels)
            written.close()
            return found


def _numbered(labels: DataFrame) -> DataFrame:
    """(label, number): consecutive numbers in label order, without a global sort."""
    distinct = labels.select(F.col("label").cast("double").alias("value"), F.col("label")).distinct()
    counts = bucketed(distinct, ["value"]).select(
        "label", "value", F.col("value__b").alias("bucket"), F.lit(1).alias("n"), F.lit(1).alias("g")
    )
    return cumulate(counts, ["g"], ["n"]).select("label", F.col("n_before").cast("int").alias("number"))
