"""Reachability, layers and trees. Frontiers stay distributed; the driver sees only whether one is empty."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def written(df: DataFrame, name: str) -> DataFrame:
    """Lineage cut that survives lost executors: a table in the shared folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/factloom"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of reached nodes that are kept before they are written as one.
PARTS = 6


def reverse_reach(edges: DataFrame, targets: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, distance: everything that reaches a target (node) along edges (caller, callee); targets have distance 0."""
    back = written(edges.select(F.col("callee").alias("node"), F.col("caller").alias("up")).where("node <> up").distinct(), "edges")
    seen = written(targets.select("node").distinct().withColumn("distance", F.lit(0)), "reached")
    frontier, depth, parts = seen, 0, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(back, "node").select(F.col("up").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = written(step.withColumn("distance", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        seen, parts = seen.unionByName(frontier), parts + 1
        if parts == PARTS:
            seen, parts = written(seen, "reached"), 1
    return seen


def two_distances(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """node, distance over any edges and proven_distance over proven ones alone (null: reached by advice only).

    edges: caller, callee, proven. One fixpoint over pairs of node and what has borne it out so far: a proven edge leads on from both, an advised
    one only from what advice may reach.
    """
    pair = lambda c, proven: F.struct(F.col(c).alias("node"), proven.alias("proven"))
    kinds = F.when(F.col("proven"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    doubled = edges.select("caller", "callee", F.explode(kinds).alias("by")).select(pair("caller", F.col("by")).alias("caller"), pair("callee", F.col("by")).alias("callee"))
    start = targets.select("node", F.explode(F.array(F.lit(True), F.lit(False))).alias("by")).select(pair("node", F.col("by")).alias("node"))
    reach = reverse_reach(doubled, start).select("node.*", "distance")
    return reach.groupBy("node").agg(F.min(F.when(~F.col("proven"), F.col("distance"))).alias("distance"), F.min(F.when(F.col("proven"), F.col("distance"))).alias("proven_distance"))


def arriving_edges(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """node, distance, callee, provenance, resolution: the edges by which each reached node comes one step nearer; a row each."""
    near = reach.select(F.col("node").alias("callee"), (F.col("distance") + 1).alias("distance"))
    pairs = edges.select("caller", "callee", "provenance", "resolution").distinct().join(near, "callee")
    own = reach.select(F.col("node").alias("caller"), "distance")
    return pairs.join(own, ["caller", "distance"]).select(F.col("caller").alias("node"), "distance", "callee", "provenance", "resolution")


def affected(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """Each reached node but the targets: node, distance, proven_distance, advised_only, n_via, provenance and resolution of the edges that arrive."""
    told = arriving_edges(reach, edges).groupBy("node").agg(F.count_distinct("callee").alias("n_via"), F.array_sort(F.collect_set("provenance")).alias("provenance"), F.array_sort(F.collect_set("resolution")).alias("resolution"))
    return reach.where("distance > 0").join(told, "node").select("node", "distance", "proven_distance", F.col("proven_distance").isNull().alias("advised_only"), "n_via", "provenance", "resolution")


def arriving(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """node, distance, via: for every reached node but the targets, the callees one step nearer that it calls."""
    near = reach.select(F.col("node").alias("callee"), (F.col("distance") + 1).alias("distance"))
    pairs = edges.select("caller", "callee").distinct().join(near, "callee")
    hit = pairs.join(reach.select(F.col("node").alias("caller"), "distance"), ["caller", "distance"])
    return hit.groupBy(F.col("caller").alias("node"), "distance").agg(F.array_sort(F.collect_set("callee")).alias("via"))


def layers(nodes: DataFrame, needs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, layer) by peeling what needs nothing left, and the rest, which is empty unless there is a cycle.

    nodes: id; needs: id, on. Layer 0 needs nothing.
    """
    left, edges = written(nodes.select("id").distinct(), "left"), written(needs.select("id", "on").distinct(), "needs")
    done, k = left.limit(0).withColumn("layer", F.lit(0)), 0
    while True:
        free = written(left.join(edges, "id", "left_anti").withColumn("layer", F.lit(k)), "layer")
        if free.isEmpty():
            return done, left
        done, k = done.unionByName(free), k + 1
        left = written(left.join(free, "id", "left_anti"), "left")
        edges = written(edges.join(free.select(F.col("id").alias("on")), "on", "left_anti"), "needs")


def children(tree: DataFrame) -> DataFrame:
    """node, children (sorted) from rows (node, parent); leaves have none."""
    kids = tree.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.array_sort(F.collect_set("node")).alias("children"))
    return tree.select("node").distinct().join(kids, "node", "left").select("node", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def roots(tree: DataFrame) -> DataFrame:
    return tree.where("parent is null").select("node").distinct()


def _next_siblings(tree: DataFrame) -> DataFrame:
    """node, parent, next: the node after it below the same parent. Siblings lie in sorted ranges, so a parent of many is not one task's."""
    ranged = written(tree.repartitionByRange("parent", "node").withColumn("part", F.spark_partition_id()), "siblings")
    here = F.struct("parent", "node")
    firsts = ranged.groupBy("part").agg(F.min(here).alias("first"))
    follows = firsts.select("part", F.lead("first").over(W.orderBy("part")).alias("after"))  # one row a range
    own = ranged.withColumn("then", F.lead(here).over(W.partitionBy("part").orderBy("parent", "node")))
    then = F.coalesce("then", "after")
    return own.join(follows, "part").select("node", "parent", F.when(then["parent"].eqNullSafe(F.col("parent")), then["node"]).alias("next"))


def preorder(tree: DataFrame) -> DataFrame:
    """node, place (from 1, parents before their children, siblings in order), depth (0: a root) of rows (node, parent); nodes are unique.

    The walk around the trees enters and leaves each node; every step knows the next, and pointers double until all reach the end, in about
    log2(2 n) rounds of joins. Rows do not grow with depth. A parent that is no node makes its child a root; nodes on cycles and below them
    never reach the end and have no row.
    """
    there = tree.select(F.col("node").alias("parent")).withColumn("there", F.lit(True))
    placed = _next_siblings(tree.select("node", "parent").join(there, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("parent")))
    eldest = placed.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("child"))
    step = lambda node, leaves: F.struct(node.alias("node"), F.lit(leaves).alias("leaves"))
    node, child, after, up = F.col("node"), F.col("child"), F.col("next"), F.col("parent")
    enters = F.struct(step(node, False).alias("at"), F.when(child.isNotNull(), step(child, False)).otherwise(step(node, True)).alias("to"), F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("level"))
    leaves = F.struct(step(node, True).alias("at"), F.when(after.isNotNull(), step(after, False)).when(up.isNotNull(), step(up, True)).alias("to"), F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("level"))
    walk = written(placed.join(eldest, "node", "left").select(F.inline(F.array(enters, leaves))), "walk")
    left = walk.count()
    while left:  # as often as the number of steps can be halved
        onward = walk.select(F.col("at").alias("to"), F.col("to").alias("to2"), F.col("entered").alias("entered2"), F.col("level").alias("level2"))
        done, open_ = walk.where("to is null"), walk.where("to is not null")
        moved = open_.join(onward, "to").select("at", F.col("to2").alias("to"), (F.col("entered") + F.col("entered2")).alias("entered"), (F.col("level") + F.col("level2")).alias("level"))
        walk, left = written(done.unionByName(moved), "walk"), left // 2
        if left and walk.where("to is not null").isEmpty():
            break
    ended = walk.where("to is null and not at.leaves")
    total = ended.agg(F.count("*").alias("total"))  # one row
    return ended.join(F.broadcast(total)).select("at.node", (F.col("total") - F.col("entered") + 1).alias("place"), (-F.col("level")).alias("depth"))
