"""Connected components of an edge table, by contraction: no edge list comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (node, component), component being the smallest node that is reachable.

    Each round sends every node to the smallest of itself and its neighbours and
    replaces the ends of all edges by where they went; stars vanish at once and the
    graph at least halves. Loops, repeated edges and either direction are fine; nulls are dropped.
    """
    left = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to"))
        move = materialise(move, "moves")
        moves.append(move)
        ends = left.join(move.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = materialise(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not moves:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = moves[0].select("node", F.col("to").alias("component"))
    for move in moves[1:]:
        step = move.select(F.col("node").alias("component"), "to")
        out = out.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out
