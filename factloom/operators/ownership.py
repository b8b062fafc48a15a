"""Which unit owns a path: longest-prefix joins without a theta join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import ancestors, glob_regex


def owner(paths: DataFrame, units: DataFrame, tie: Column | None = None) -> DataFrame:
    """paths (path, ...) left joined to the unit (id, prefix, ...) of the longest prefix, as ``unit_id``.

    Paths are exploded to their ancestors and joined by equality, so the join is a hash join however many units
    there are. Of units with one prefix the greatest ``tie`` wins; by default the smallest id.
    """
    prefixes = units.select("prefix", "id", (tie if tie is not None else F.lit(0)).alias("tie"))
    best = prefixes.groupBy("prefix").agg(F.min(F.struct((-F.col("tie")).alias("tie"), F.col("id"))).alias("unit"))
    keys = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    owned = keys.join(best, "prefix").groupBy("path").agg(F.max_by("unit.id", F.length("prefix")).alias("unit_id"))
    return paths.join(owned, "path", "left")


def _globbed(paths: DataFrame, globs: list[tuple[str, str]]) -> DataFrame:
    """path, id, specificity (characters before the first glob sign), ord of every glob (id, pattern) that a path matches.

    Globs are authored and few: one filter each over one pass of the paths.
    """
    hits = [F.when(F.col("path").rlike(glob_regex(p)), F.struct(F.lit(i).alias("id"), F.lit(len(re.split(r"[*?\[]", p)[0])).alias("specificity"), F.lit(k).alias("ord"))) for k, (i, p) in enumerate(globs)]
    return paths.select("path").distinct().select("path", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("path", "hit.*")


def owner_with_globs(paths: DataFrame, units: DataFrame, globs: list[tuple[str, str]], tie: Column | None = None) -> DataFrame:
    """As ``owner``, but a glob (id, pattern) owns what it matches if more characters stand before its first sign than the literal
    owner's prefix has; of equal globs the earlier one."""
    literal = owner(paths, units, tie)
    if not globs:
        return literal
    lengths = units.groupBy(F.col("id").alias("unit_id")).agg(F.max(F.length("prefix")).alias("known"))
    best = _globbed(paths, globs).groupBy("path").agg(F.max_by(F.struct("id", "specificity"), F.struct("specificity", -F.col("ord"))).alias("glob"))
    both = literal.join(lengths, "unit_id", "left").join(best, "path", "left")
    better = F.col("glob.specificity") > F.coalesce("known", F.lit(-1))
    return both.select(*[F.col(c) for c in paths.columns], F.when(better, F.col("glob.id")).otherwise(F.col("unit_id")).alias("unit_id"))


def glob_counts(paths: DataFrame, globs: list[tuple[str, str]]) -> DataFrame:
    """id, n: paths that each glob matches; 0 where there are none."""
    ids = paths.sparkSession.createDataFrame([(i,) for i, _ in globs], "id string")
    found = _globbed(paths, globs).groupBy("id").agg(F.count("*").alias("n"))
    return ids.join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def artifact_counts(paths: DataFrame, units: DataFrame) -> DataFrame:
    """id, n: paths at or below each unit's prefix, ancestors' units counting them as well; 0 where there are none."""
    keys = paths.select("path").distinct().select(F.explode(ancestors(F.col("path"))).alias("prefix"))
    counts = keys.groupBy("prefix").agg(F.count("*").alias("n"))
    return units.select("id", "prefix").join(counts, "prefix", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def nearest(paths: DataFrame, units: DataFrame, k: int = 3) -> DataFrame:
    """path, rank, unit_id: the k units that share most leading components; if none shares one, the first k by id."""
    # a unit shares n components with a path exactly if its n-th ancestor is one of the path's
    heads = units.select("id", F.explode(ancestors(F.col("prefix"))).alias("head")).where("head <> ''").distinct()
    # those behind the first k ids of a head are behind these in every path too, so a hot head brings k rows a path
    heads = heads.withColumn("r", F.row_number().over(W.partitionBy("head").orderBy("id"))).where(F.col("r") <= k).drop("r")
    keys = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("head")).where("head <> ''")
    shared = keys.join(heads, "head").groupBy("path", "id").agg(F.max(F.size(F.split("head", "/"))).alias("shared"))
    order = W.partitionBy("path").orderBy(F.desc("shared"), "id")
    some = shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("path", "rank", F.col("id").alias("unit_id"))
    first = units.select("id").distinct().orderBy("id").limit(k).agg(F.array_sort(F.collect_list("id")).alias("ids"))  # one row of k ids
    none = paths.select("path").distinct().join(shared.select("path").distinct(), "path", "left_anti").join(F.broadcast(first))
    rest = none.select("path", F.posexplode("ids").alias("rank", "unit_id")).withColumn("rank", F.col("rank") + 1)
    return some.unionByName(rest)


def drifted(units: DataFrame, present: DataFrame) -> DataFrame:
    """Units whose prefix is neither a present path nor above one."""
    there = present.select(F.explode(ancestors(F.col("path"))).alias("prefix")).distinct()
    return units.join(there, "prefix", "left_anti")


def deepest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """path, id of the longest prefix (id, prefix) at or above each path; of equal ones the greatest id."""
    keys = paths.select("path").distinct().select("path", F.explode(ancestors(F.col("path"))).alias("prefix"))
    best = prefixes.groupBy("prefix").agg(F.max("id").alias("id"))
    return keys.join(best, "prefix").groupBy("path").agg(F.max_by("id", F.length("prefix")).alias("id"))
