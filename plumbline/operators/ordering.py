"""Exact quantiles, ranks and prefix sums without a global sort in one task.

Order statistics are found by brackets: a fixed-size sketch brackets each wanted position, one scan counts
what lies below and inside, brackets with many rows are sketched again, and the few values left
inside are ordered exactly. Ranks need every value, so values are pre-aggregated, cut into
equi-depth buckets and prefix-summed per bucket; only bucket totals are summed globally.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import MEASURES, quoted, stored

ACCURACY = 10_000
# Values are cut into buckets of about this many rows, up to what the sketch resolves.
BUCKET_ROWS = 100_000
FEW_BUCKETS = 64
MAX_BUCKETS = 2048
# A key with more than this fraction of the rows is spread over as many tasks.
HOT = 64
# A bracket with more rows than this is narrowed before its values are ordered, by so many sketches at most.
SPAN_ROWS = 100_000
ROUNDS = 40


def order_statistics(
    df: DataFrame,
    exprs: dict[str, Column],
    positions: dict[str, Sequence[int]] | None = None,
    *,
    fractions: dict[str, Sequence[float]] | None = None,
    counts: dict[str, int] | None = None,
    accuracy: int = ACCURACY,
) -> dict[str, tuple[int, dict[float, float | None]]]:
    """Values at 0-based sorted positions (or at fractions of n-1, linearly interpolated).

    Returns ``{name: (n, {position or fraction: value})}``; nulls are not counted.
    ``counts`` saves a scan when the number of values is known. Only counts, brackets and
    at most two values per position reach the driver.
    """
    names = list(exprs)
    wide = df.select(*[exprs[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    slack = 4.0 / accuracy
    known: dict[tuple[int, float], float] = {}
    if fractions is not None:
        probes = {i: [p + s for p in fractions[n] for s in (-slack, slack)] for i, n in enumerate(names)}
        sizes, known = _sketch(wide, len(names), probes, accuracy)
    elif counts is not None:
        sizes = [counts[n] for n in names]
    else:
        sizes, _ = _sketch(wide, len(names), {}, accuracy)

    # (column, position) -> share of the values at which the sketch is asked
    wanted: dict[tuple[int, int], float] = {}
    asked: dict[str, list[tuple[float, float]]] = {}
    for i, n in enumerate(names):
        asked[n] = []
        if sizes[i] and fractions is not None:
            asked[n] = [(p, p * (sizes[i] - 1)) for p in fractions[n]]
            for p, at in asked[n]:
                wanted.setdefault((i, math.floor(at)), p)
                wanted.setdefault((i, math.ceil(at)), p)
        elif sizes[i]:
            asked[n] = [(k, k) for k in positions[n]]
            for k in positions[n]:
                wanted[(i, k)] = (k + 0.5) / sizes[i]
    found = _select(wide, wanted, sizes, slack, accuracy, known)

    out = {}
    for i, n in enumerate(names):
        values: dict[float, float | None] = {}
        for p, at in asked[n]:
            lo, hi = found[(i, math.floor(at))], found[(i, math.ceil(at))]
            values[p] = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
        if not sizes[i]:
            values = {p: None for p in (fractions or positions)[n]}
        out[n] = (sizes[i], values)
    return out


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of every column."""
    if not cols:
        return {}
    got = order_statistics(
        df, {c: quoted(c) for c in cols}, fractions={c: list(probs) for c in cols}, accuracy=accuracy
    )
    return {c: [got[c][1][p] for p in probs] for c in cols}


def _collect_wide(df: DataFrame, aggs: list[Column]) -> list:
    out: list = []
    for start in range(0, len(aggs), MEASURES):
        out.extend(df.agg(*aggs[start : start + MEASURES]).first())
    return out


def _sketch(
    wide: DataFrame, n: int, probes: dict[int, Sequence[float]], accuracy: int
) -> tuple[list[int], dict[tuple[int, float], float]]:
    """Counts and approximate quantiles of the columns, one digest per column, one scan."""
    inside = {i: sorted({p for p in ps if 0 < p < 1}) for i, ps in probes.items()}
    inside = {i: ps for i, ps in inside.items() if ps}
    aggs = [F.count(f"v{i}") for i in range(n)]
    aggs += [F.percentile_approx(f"v{i}", ps, accuracy) for i, ps in inside.items()]
    row = _collect_wide(wide, aggs)
    values = {}
    for (i, ps), got in zip(inside.items(), row[n:]):
        values.update({(i, p): v for p, v in zip(ps, got or [])})
    return row[:n], values


class Span(NamedTuple):
    """Values of a column between two bounds (None: no bound), both of them in it unless it is open."""

    i: int
    low: float | None
    high: float | None
    open: bool = False

    def holds(self, v: Column) -> Column:
        ok = v.isNotNull()
        if self.low is not None:
            ok = ok & (v > F.lit(self.low) if self.open else v >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (v < F.lit(self.high) if self.open else v <= F.lit(self.high))
        return ok

    @property
    def value(self) -> Column:
        return F.col(f"v{self.i}")


def _select(
    wide: DataFrame, wanted: dict[tuple[int, int], float], sizes: list[int], slack: float, accuracy: int,
    known: dict[tuple[int, float], float],
) -> dict[tuple[int, int], float]:
    """Exact values at (column, position).

    A sketch brackets each position, and one scan counts what lies below and inside. A bracket with more than SPAN_ROWS rows is
    narrowed by a sketch of its own rows, again and again; then the few values left in the brackets are ordered.
    """
    found: dict[tuple[int, int], float] = {}
    todo = list(wanted)
    while todo:
        # A column no larger than the sketch needs no bracket.
        asks = [(i, wanted[i, k] - slack, wanted[i, k] + slack) for i, k in todo if sizes[i] > accuracy]
        missing = {(i, p) for i, lo, hi in asks for p in (lo, hi) if 0 < p < 1 and (i, p) not in known}
        if missing:
            probes: dict[int, list[float]] = {}
            for i, p in missing:
                probes.setdefault(i, []).append(p)
            known = {**known, **_sketch(wide, 0, probes, accuracy)[1]}
        brackets = [
            (known.get((i, wanted[i, k] - slack)), known.get((i, wanted[i, k] + slack))) if sizes[i] > accuracy else (None, None)
            for i, k in todo
        ]
        spans = _merged([(i, *br) for (i, _), br in zip(todo, brackets)])
        cut = [s for s in spans if s.low is not None or s.high is not None]
        counts = iter(_collect_wide(wide, [c for s in cut for c in (F.count(F.when(s.value < F.lit(s.low), 1)) if s.low is not None else F.lit(0), F.count(F.when(s.holds(s.value), 1)))]))
        stood = {s: (next(counts), next(counts)) for s in cut}
        goals: dict[Span, dict[int, tuple[int, int]]] = {}
        large: dict[tuple[int, int], tuple[Span, int, int]] = {}
        for w, (lo, _) in zip(todo, brackets):
            span = next(s for s in spans if w[0] == s.i and _inside(lo, s.low, s.high))
            below, inside = stood.get(span, (0, sizes[w[0]]))
            if inside > SPAN_ROWS and below <= w[1] < below + inside:
                large[w] = (span, below, inside)
            else:
                goals.setdefault(span, {})[w[1] - below] = w
        for w, result in _narrowed(wide, large, accuracy).items():
            if isinstance(result, tuple):
                goals.setdefault(result[0], {})[w[1] - result[1]] = w
            else:
                found[w] = result
        for span, place, v in _at_places(wide, goals):
            found[goals[span][place]] = v
        todo = [w for w in todo if w not in found]
        slack = slack * 100 if slack < 1 else math.inf
    return found


def _narrowed(wide: DataFrame, large: dict[tuple[int, int], tuple[Span, int, int]], accuracy: int) -> dict:
    """For each (column, position) its value, or an open span of at most SPAN_ROWS rows and the rows below it.

    Each round sketches the rows of the spans and counts around the two values that it says lie on either side of the
    position. Both then leave the span, so a value with many rows is found or gone.
    """
    out: dict = {}
    rounds = 0
    while large:
        rounds += 1
        if rounds > ROUNDS:
            raise RuntimeError("order statistics did not settle")
        slack = 4.0 / accuracy
        asks: dict[Span, set[float]] = {}
        at = {}
        for w, (span, below, inside) in large.items():
            p = (w[1] - below + 0.5) / inside
            at[w] = [x for x in (p - slack, p + slack)]
            asks.setdefault(span, set()).update(x for x in at[w] if 0 < x < 1)
        asked = {s: sorted(ps) for s, ps in asks.items() if ps}
        got = _collect_wide(wide, [F.percentile_approx(F.when(s.holds(s.value), s.value), ps, accuracy) for s, ps in asked.items()])
        cuts = {(s, p): v for (s, ps), vs in zip(asked.items(), got) for p, v in zip(ps, vs)}
        edges = sorted({(s.i, v) for (s, _), v in cuts.items()})
        numbers = _collect_wide(wide, [F.count(F.when(c, 1)) for i, v in edges for c in (F.col(f"v{i}") < F.lit(v), F.col(f"v{i}") <= F.lit(v))])
        upto = {e: (numbers[2 * n], numbers[2 * n + 1]) for n, e in enumerate(edges)}
        left = {}
        for w, (span, below, inside) in large.items():
            (i, k), low, high, start, stop = w, span.low, span.high, below, below + inside
            for v in (cuts.get((span, p)) for p in at[w]):
                if v is None:
                    continue
                less, with_v = upto[i, v]
                if less <= k < with_v:
                    out[w] = v
                elif with_v <= k and with_v >= start:
                    low, start = v, with_v
                elif k < less <= stop:
                    high, stop = v, less
            if w in out:
                continue
            # What an open span leaves out of a closed one at its other end is settled by the position.
            span = Span(i, low, high, True) if (low, high) != (span.low, span.high) else span
            if span.open and not large[w][0].open:
                ends = [v for v in (low, high) if v is not None and v in (large[w][0].low, large[w][0].high)]
                if ends:
                    more = _collect_wide(wide, [F.count(F.when(c, 1)) for v in ends for c in (F.col(f"v{i}") < F.lit(v), F.col(f"v{i}") <= F.lit(v))])
                    for n, v in enumerate(ends):
                        if more[2 * n] <= k < more[2 * n + 1]:
                            out[w] = v
                        elif v == low:
                            start = more[2 * n + 1]
                        else:
                            stop = more[2 * n]
                if w in out:
                    continue
            if stop - start <= SPAN_ROWS:
                out[w] = (span, start)
            else:
                left[w] = (span, start, stop - start)
        large = left
    return out


def _merged(spans: list[tuple]) -> list[Span]:
    """Disjoint (column, low, high) spans covering the given ones; None is open."""
    out: list[Span] = []
    for i, lo, hi in sorted(set(spans), key=lambda x: (x[0], -math.inf if x[1] is None else x[1])):
        if out and out[-1].i == i and (out[-1].high is None or lo is None or lo <= out[-1].high):
            top = None if hi is None or out[-1].high is None else max(hi, out[-1].high)
            out[-1] = Span(i, out[-1].low, top)
        else:
            out.append(Span(i, lo, hi))
    return out


def _inside(lo, a, b) -> bool:
    if lo is None:
        return a is None
    return (a is None or a <= lo) and (b is None or lo <= b)


def _at_places(wide: DataFrame, goals: dict[Span, dict[int, Any]]) -> list[tuple]:
    """(span, place, value): the values at the wanted places of every span.

    Only values inside a span leave the scan, counted per distinct value first. A span's values meet in one task: there are
    at most SPAN_ROWS of them, or as many as a sketch holds.
    """
    if not goals:
        return []
    spans = list(goals)
    # Spans of two positions may overlap after narrowing, so a row can count for several.
    marks = F.array_compact(F.array(*[F.when(s.holds(s.value), F.struct(F.lit(n).alias("s"), s.value.alias("v"))) for n, s in enumerate(spans)]))
    counts = wide.select(F.explode(marks).alias("m")).groupBy("m.s", "m.v").agg(F.count(F.lit(1)).alias("n"))
    listed = F.element_at(
        F.array(*[F.array(*[F.lit(g) for g in goals[s]]).cast("array<bigint>") for s in spans]), F.col("s") + 1
    )
    upto = F.sum("n").over(Window.partitionBy("s").orderBy("v"))
    hits = (
        counts.withColumn("upto", upto)
        .withColumn("hit", F.filter(listed, lambda g: (g < F.col("upto")) & (g >= F.col("upto") - F.col("n"))))
        .where(F.size("hit") > 0)
        .select("s", "v", "hit")
        .collect()
    )
    return [(spans[h["s"]], g, h["v"]) for h in hits for g in h["hit"]]


def bucketed(df: DataFrame, cols: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add ``<col>__b``: an equi-depth bucket that never separates equal values.

    Without ``buckets``, their number follows the rows, so a bucket stays one task's work.
    """
    def sketch(parts: int) -> list:
        probs = [i / parts for i in range(1, parts)]
        return _collect_wide(
            df, [f for c in cols for f in (F.count(quoted(c)), F.percentile_approx(quoted(c).cast("double"), probs, ACCURACY))]
        )

    parts = FEW_BUCKETS
    row = sketch(parts)
    if max(buckets or 0, -(-max(row[::2]) // BUCKET_ROWS)) > parts:
        # A large table is worth a second, finer look.
        parts = MAX_BUCKETS
        row = sketch(parts)
    splits = []
    for n, cuts in zip(row[::2], row[1::2]):
        wanted = buckets or max(8, -(-n // BUCKET_ROWS))
        step = max(1, parts // wanted)
        cuts = (cuts or [])[step - 1 :: step]
        inner = sorted({v for v in cuts if v is not None and math.isfinite(v)}) or [0.0]
        splits.append([-math.inf, *inner, math.inf])
    return Bucketizer(
        splitsArray=splits,
        inputCols=list(cols),
        outputCols=[f"{c}__b" for c in cols],
        handleInvalid="keep",
    ).transform(df)


def cumulate(counts: DataFrame, groups: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Add ``<s>_before``: total of ``s`` over smaller values in the group.

    ``counts`` has one row per (groups..., bucket, value). The window runs inside one
    bucket; bucket totals (at most MAX_BUCKETS per group) are prefix-summed and broadcast.
    """
    inside = Window.partitionBy(*groups, "bucket").orderBy("value").rowsBetween(
        Window.unboundedPreceding, -1
    )
    across = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        counts.groupBy(*groups, "bucket")
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(*groups, "bucket", *[F.coalesce(F.sum(s).over(across), F.lit(0)).alias(f"{s}_start") for s in sums])
    )
    out = counts
    for s in sums:
        out = out.withColumn(f"{s}_in", F.coalesce(F.sum(s).over(inside), F.lit(0)))
    out = out.join(F.broadcast(starts), [*groups, "bucket"])
    return out.select(
        *counts.columns, *[(F.col(f"{s}_in") + F.col(f"{s}_start")).alias(f"{s}_before") for s in sums]
    )


def ranked(long: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups..., value, n, avg_rank, total) from rows (groups..., bucket, value)."""
    counts = long.groupBy(*groups, "bucket", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("total"))
    return (
        cumulate(counts, groups, ["n"])
        .join(F.broadcast(totals), list(groups))
        .select(
            *groups, "value", "n", "total",
            (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("avg_rank"),
        )
    )


def numbered(df: DataFrame, order: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``, the place of each row from 0 on, in the given order.

    Rows are dealt by range and written once; a row's place is the number of rows in earlier ranges, one number a range,
    and its place in its own.
    """
    keys = [c.alias(f"{name}__{i}") for i, c in enumerate(order)]
    names = [f"{name}__{i}" for i in range(len(keys))]
    parts = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.select("*", *keys).repartitionByRange(parts, *names).sortWithinPartitions(*names).drop(*names)
    # The lower 33 bits of this id count the rows of a partition.
    held = stored(dealt.withColumn(f"{name}__part", F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "numbered")
    before = F.coalesce(F.sum("n").over(Window.orderBy(f"{name}__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range, so it is small at any size of the table.
    starts = held.groupBy(f"{name}__part").agg(F.count(F.lit(1)).alias("n")).select(f"{name}__part", before.alias(f"{name}__before"))
    return held.join(F.broadcast(starts), f"{name}__part").select(*[quoted(c) for c in df.columns], (F.col(f"{name}__before") + F.col(name)).alias(name))


def skew_lookup(df: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left-join a keyed table that also carries ``n`` (rows per key) and ``total``.

    A key with more than 1/64 of the rows is hot; there are fewer than 64 per group, so
    hot keys are broadcast and their rows are spread over salts instead of one task.
    """
    hot = table.where(F.col("n") * HOT > F.col("total"))
    cold = table.where(F.col("n") * HOT <= F.col("total"))
    marked = df.join(
        F.broadcast(hot.select(*keys, *[F.col(v).alias(f"{v}__hot") for v in values], F.lit(True).alias("__hot"))),
        list(keys), "left",
    ).withColumn(
        "__salt",
        F.when(F.col("__hot"), F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(HOT)) + 1)
        .otherwise(F.lit(0)).cast("bigint"),
    )
    cold = cold.select(*keys, *values).withColumn("__salt", F.lit(0).cast("bigint"))
    joined = marked.join(cold, [*keys, "__salt"], "left")
    return joined.select(
        *[quoted(c) for c in df.columns],
        *[F.coalesce(F.col(f"{v}__hot"), F.col(v)).alias(v) for v in values],
    )
