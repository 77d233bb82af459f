"""How much does each feature move each prediction?"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import compact, quoted, scratch
from plumbline.operators.ordering import numbered

#: The column that carries a step's place through the scoring.
WALK = "walk__step"
#: Conditions of leaves and rows that are worked on at once.
COLUMNS = 2048
ROWS = 512


def linear(df: DataFrame, cols: Sequence[str], weights: Sequence[float], keep: Sequence[str] = ()) -> DataFrame:
    """Exact attributions of a linear score: weight times distance from the mean."""
    means = df.agg(*[F.avg(quoted(c).cast("double")) for c in cols]).first()
    return df.select(
        *[quoted(k) for k in keep],
        *[((quoted(c) - F.lit(m)) * F.lit(float(w))).alias(c) for c, w, m in zip(cols, weights, means)],
    )


def mean_absolute(phi: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, importance) from one column of attributions per feature."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.avg(F.abs(quoted(c))).alias("importance")) for c in cols])
    return phi.agg(rows.alias("r")).select(F.inline("r"))


@dataclass
class Leaf:
    """One leaf: its value per output and the conditions on the way to it."""

    value: np.ndarray
    features: list[int]
    low: np.ndarray
    high: np.ndarray
    reach: np.ndarray


def read_leaves(model: Any, spark, weighted: bool = False) -> tuple[list[Leaf], np.ndarray]:
    """Leaves of a tree, forest or boosted model, and the mean score; reads the saved node table.

    A condition is an interval (low, high]; ``reach`` is the share of training rows, or of their weight on request, that
    a split on the feature lets through. Features must be numeric, as prepared ones are.
    """
    path = scratch(spark, "trees")
    model.write().overwrite().save(path)
    table = spark.read.parquet(f"{path}/data")
    if "treeID" not in table.columns:
        table = table.select(F.lit(0).alias("treeID"), F.struct(*table.columns).alias("nodeData"))
    trees: dict[int, dict[int, Any]] = {}
    # As many rows as the model has nodes.
    for r in table.collect():
        trees.setdefault(r["treeID"], {})[r["nodeData"]["id"]] = r["nodeData"]
    weights = list(getattr(model, "treeWeights", [1.0]))
    if hasattr(model, "getNumTrees") and "RandomForest" in type(model).__name__:
        weights = [1.0 / len(trees)] * len(trees)
    by_class = "Classification" in type(model).__name__ and "GBT" not in type(model).__name__
    leaves: list[Leaf] = []
    base = 0.0
    for t, nodes in trees.items():
        base = base + _walk(nodes, weights[t], by_class, leaves, weighted)
    return leaves, np.atleast_1d(base)


def _walk(nodes, weight, by_class, leaves, weighted=False) -> np.ndarray:
    def size(n):
        # Statistics hold the weight by class, or the weight, the sum and the summed squares of values.
        return n["rawCount"] if not weighted else sum(n["impurityStats"]) if by_class else n["impurityStats"][0]

    total = size(nodes[0])
    mean = 0.0
    stack = [(0, {})]
    while stack:
        i, path = stack.pop()
        n = nodes[i]
        if n["leftChild"] < 0:
            stats = np.array(n["impurityStats"])
            value = weight * (stats / stats.sum() if by_class else np.array([n["prediction"]]))
            mean = mean + value * size(n) / total
            if path:
                f = sorted(path)
                leaves.append(Leaf(
                    value, f, np.array([path[j][0] for j in f]), np.array([path[j][1] for j in f]),
                    np.array([path[j][2] for j in f]),
                ))
            continue
        j, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
        lo, hi, share = path.get(j, (-np.inf, np.inf, 1.0))
        for child, bounds in ((n["leftChild"], (lo, min(hi, cut))), (n["rightChild"], (max(lo, cut), hi))):
            stack.append((child, {**path, j: (*bounds, share * size(nodes[child]) / size(n))}))
    return mean


@dataclass
class Block:
    """Leaves with equally many conditions, of any tree: one row per leaf, one column per condition or output."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    reach: np.ndarray
    value: np.ndarray


def blocks_of(leaves: list[Leaf]) -> list[Block]:
    """The leaves by their number of conditions, in blocks of some COLUMNS conditions."""
    by_size: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        by_size.setdefault(len(leaf.features), []).append(leaf)
    out = []
    for m, group in sorted(by_size.items()):
        step = max(1, COLUMNS // m)
        for at in range(0, len(group), step):
            part = group[at : at + step]
            out.append(Block(*[np.array([getattr(leaf, f) for leaf in part]) for f in ("features", "low", "high", "reach", "value")]))
    return out


def shares(reach: np.ndarray, met: np.ndarray) -> np.ndarray:
    """Shapley value of each condition (last axis) of a leaf worth 1.

    The game: a feature in the coalition counts as met or not, one outside counts as its training share, which
    is above 0. The weights of coalitions are the integrals of t^s (1-t)^(m-1-s), so a value is the integral over t of the
    product of the other conditions' mixtures: a polynomial of degree m - 1, which Gauss's rule sums without error.
    """
    nodes, weights = np.polynomial.legendre.leggauss((reach.shape[-1] + 1) // 2)
    total = 0.0
    for t, weight in zip((nodes + 1) / 2, weights / 2):
        mixture = reach * (1 - t) + met * t
        total = total + weight * mixture.prod(axis=-1, keepdims=True) / mixture
    return (met - reach) * total


def explain_batch(blocks: list[Block], x: np.ndarray, outputs: int) -> np.ndarray:
    """Attributions (rows, outputs, features) of a block of rows.

    A block of leaves takes one comparison of all its conditions and one gather from a table: conditions met, as bits, to
    shares. Where the patterns of bits are no fewer than a quarter of the rows, the rows' own patterns are worked out instead.
    """
    n = len(x)
    phi = np.zeros((n, outputs, x.shape[1]))
    for b in blocks:
        leaves, m = b.features.shape
        bits = 1 << np.arange(m, dtype=np.int64)
        table = None
        if 4 << m <= n:
            patterns = (np.arange(1 << m)[:, None] & bits) > 0
            table = shares(b.reach, patterns[:, None, :]).reshape(1 << m, leaves * m)
        # Columns of one feature side by side, so that a feature's shares are added in one pass.
        order = np.argsort(b.features.ravel(), kind="stable")
        used, starts = np.unique(b.features.ravel()[order], return_index=True)
        owner = order // m
        for at in range(0, n, ROWS):
            part = x[at : at + ROWS][:, b.features]
            met = (part > b.low) & (part <= b.high)
            if table is None:
                got = shares(b.reach, met).reshape(len(part), leaves * m)[:, order]
            else:
                got = table[(met @ bits)[:, owner], order]
            for o in range(outputs):
                phi[at : at + ROWS, o, used] += np.add.reduceat(got * b.value[owner, o], starts, axis=1)
    return phi


def tree(model: Any, df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), weighted: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(keep..., phi): exact path-dependent Shapley values of every row, output by output.

    ``phi`` has ``outputs * len(cols)`` entries. With the returned mean they add up to
    the score: the margin of a boosted model, class shares of a forest.
    """
    leaves, base = read_leaves(model, df.sparkSession, weighted)
    # As large as the model.
    shared = df.sparkSession.sparkContext.broadcast(blocks_of(leaves))
    outputs, d = len(base), len(cols)

    def explain(batches):
        for pdf in batches:
            if len(pdf):
                phi = explain_batch(shared.value, np.stack(pdf["__x"].to_numpy()), outputs)
                yield pdf.drop(columns="__x").assign(phi=list(phi.reshape(len(pdf), outputs * d)))

    rows = df.select(*[quoted(k) for k in keep], F.array(*[quoted(c).cast("double") for c in cols]).alias("__x"))
    fields = "".join(f"`{k}` {dict(df.dtypes)[k]}, " for k in keep)
    return rows.mapInPandas(explain, f"{fields}phi array<double>"), base


def tree_importance(model: Any, df: DataFrame, cols: Sequence[str], weight: str | None = None) -> DataFrame:
    """(feature, importance): mean absolute attribution.

    Two classes use the second one; more average over the classes. With a ``weight`` column, a row stands for as many, also in the model.
    """
    phi, base = tree(model, df, cols, [] if weight is None else [weight], weight is not None)
    d, outputs = len(cols), len(base)
    used = [1] if outputs == 2 else list(range(outputs))
    w = F.lit(1.0) if weight is None else quoted(weight)
    means = phi.agg(F.array(*[F.sum(w * F.abs(F.col("phi")[i])) / F.sum(w) for i in range(outputs * d)]).alias("m"))
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("feature"),
            (sum((F.col("m")[o * d + j] for o in used), F.lit(0.0)) / len(used)).alias("importance"),
        )
        for j, c in enumerate(cols)
    ])
    return means.select(F.inline(rows))


def walked(
    score: Any, df: DataFrame, cols: Sequence[str], key: str, *, rows: int | None = None, background: int | None = None,
    orders: int = 20, seed: int = 42,
) -> DataFrame:
    """(key, output, feature, phi) as ``sampled``, with a row more for each key: feature null, the mean score of its background rows.

    A walk's order of features is that of their hashes with key and walk. A step is the row whose features so far have been
    changed; its score counts for the feature changed last and against the one changed next, so steps are
    summed by key without meeting in order.
    """
    names = list(cols)
    d = len(names)
    held = df.select(quoted(key).alias("key"), F.array(*[quoted(c).cast("double") for c in names]).alias("values"))

    def by_hash(s: int, most: int) -> DataFrame:
        return held.orderBy(F.xxhash64("key", F.lit(s)), "key").limit(most)

    # Background rows are numbered in hash order, and walks meet theirs by number.
    drawn = held if background is None else by_hash(seed + 1, background)
    base = numbered(drawn, [F.xxhash64("key", F.lit(seed + 1)), F.col("key")], "place").select("place", F.col("values").alias("start"))
    total = held.count()
    met = max(1, total if background is None else min(total, background))
    picked = compact(held if rows is None else by_hash(seed, rows), total if rows is None else min(total, rows))
    draws = picked.withColumn("walk", F.explode(F.sequence(F.lit(0), F.lit(orders - 1)))).withColumn("place", F.pmod(F.xxhash64("key", "walk", F.lit(seed)), F.lit(met)))
    ranked = F.array_sort(F.array(*[F.struct(F.xxhash64("key", "walk", F.lit(seed + 2), F.lit(j)).alias("at"), F.lit(j).alias("j")) for j in range(d)]))
    # Spark judges the draws by the file they come from, which is far smaller: neither side may be broadcast.
    walks = draws.join(base.hint("merge"), "place").withColumn("turn", ranked["j"])
    place = [F.array_position("turn", j) for j in range(d)]
    steps = walks.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    now = [F.when(place[j] <= F.col("step"), F.col("values")[j]).otherwise(F.col("start")[j]).alias(c) for j, c in enumerate(names)]
    fields = F.struct(F.col("key").alias("key"), F.col("step").alias("step"), F.col("turn").alias("turn")).alias(WALK)
    scored = score(steps.select(fields, *now))
    several = dict(scored.dtypes)["score"].startswith("array")
    by_output = F.posexplode("score") if several else F.inline(F.array(F.struct(F.lit(0).alias("pos"), F.col("score").cast("double").alias("col"))))
    each = scored.select(F.col(WALK), by_output)
    step, turn = F.col(f"{WALK}.step"), F.col(f"{WALK}.turn")
    last = F.when(step > 0, F.element_at(turn, F.greatest(step, F.lit(1)))).otherwise(-1)
    after = F.element_at(turn, F.least(step + 1, F.lit(d)))
    parts = F.array_compact(F.array(F.struct(last.alias("j"), F.col("col").alias("s")), F.when(step < d, F.struct(after.alias("j"), (-F.col("col")).alias("s")))))
    sums = each.select(F.col(f"{WALK}.key").alias("key"), F.col("pos").alias("output"), F.inline(parts)).groupBy("key", "output", "j").agg((F.sum("s") / orders).alias("phi"))
    listed = F.array(*[F.lit(c) for c in names])
    return sums.select("key", "output", F.when(F.col("j") >= 0, F.element_at(listed, F.greatest(F.col("j") + 1, F.lit(1)))).alias("feature"), "phi")


def sampled(
    score: Any, df: DataFrame, cols: Sequence[str], key: str, *, rows: int | None = None, background: int | None = None,
    orders: int = 20, seed: int = 42,
) -> DataFrame:
    """(key, feature, phi) for the rows of any model: all of them, or a sample of ``rows`` on request.

    ``score(table)`` adds a ``score`` column to a table of feature columns, and keeps its other columns; where the score is an array of
    numbers, ``output`` tells them apart. Every row is walked ``orders`` times from a background row to itself, one
    feature at a time in a random order; the steps are scored by Spark and averaged, so they add up to the score minus the mean
    score of the background rows met. A background row is drawn for each walk from all rows, or
    from a sample of ``background`` of them on request.
    """
    found = walked(score, df, cols, key, rows=rows, background=background, orders=orders, seed=seed).where("feature is not null")
    return found.select("key", "output", "feature", "phi")


def sampled_importance(phi: DataFrame) -> DataFrame:
    """Mean absolute attribution, over all outputs alike."""
    return phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


def explain_row(phi: DataFrame, cols: Sequence[str], output: int = 0) -> DataFrame:
    """(feature, phi) of the rows given, largest effect first."""
    d = len(cols)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("phi")[output * d + j].alias("phi")) for j, c in enumerate(cols)])
    return phi.select(F.inline(rows)).orderBy(F.desc(F.abs("phi")), "feature")


def probability_of(column: str = "probability", index: int = 1) -> Column:
    return vector_to_array(column)[index]
