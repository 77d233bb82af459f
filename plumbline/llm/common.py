"""Tables between steps, and connected components of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import quoted, scratch

ROUNDS = 200


def picked(df: DataFrame, columns: dict[str, str], types: dict[str, str] | None = None) -> DataFrame:
    """Only the named columns, under the operator's own names, so no other column can clash."""
    types = types or {}
    return df.select(*[(quoted(c).cast(types[n]) if n in types else quoted(c)).alias(n) for n, c in columns.items()])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written once as Parquet in the shared folder, and read again from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): one root for each connected component.

    Every round ranks the nodes anew by hash, moves each to the lowest of itself and its
    neighbours, and keeps the links between different places. Hubs are reduced by the map-side
    minimum; a round leaves about half of the nodes of a path and one node of a clique, so the
    tables shrink geometrically. The moves are then chained from the last round to the first.
    A root is some node of its component, the same one in every run.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        if len(moves) == ROUNDS:
            raise RuntimeError("components did not settle")
        rank = lambda c, seed=len(moves): F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("rank"), F.col(c).alias("node"))
        both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), rank("b").alias("to")), F.struct(F.col("b").alias("node"), rank("a").alias("to")))))
        lowest = both.groupBy("node").agg(F.min("to").alias("to"))
        move = stored(lowest.select("node", F.least("to", rank("node"))["node"].alias("moved")), "moves")
        moves.append(move)
        near, far = (move.select(F.col("node").alias(c), F.col("moved").alias(f"{c}_moved")) for c in ("a", "b"))
        after = edges.join(near, "a").join(far, "b").where("a_moved <> b_moved")
        edges = stored(after.select(F.least("a_moved", "b_moved").alias("a"), F.greatest("a_moved", "b_moved").alias("b")).distinct(), "links")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = moves[-1].select("node", F.col("moved").alias("root"))
    for move in reversed(moves[:-1]):
        later = placed.select(F.col("node").alias("moved"), "root")
        placed = move.join(later, "moved", "left").select("node", F.coalesce("root", "moved").alias("root"))
    return stored(placed, "roots")
