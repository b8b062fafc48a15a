"""Differences of two snapshots, and what a change obliges to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import glob_regex


def diff(base: DataFrame, head: DataFrame, keys: list[str]) -> DataFrame:
    """keys and op (added, removed, same) of the distinct keys of both sides; one shuffle, nulls equal nulls."""
    both = base.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("h")).unionByName(head.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("h")))
    seen = both.groupBy(*keys).agg(F.max("b").alias("b"), F.max("h").alias("h"))
    return seen.select(*keys, F.when(F.col("b") == 0, "added").when(F.col("h") == 0, "removed").otherwise("same").alias("op"))


def symmetric_difference(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """key and ``side``: which of the two tables alone has it."""
    op = diff(left, right, [key]).where("op <> 'same'")
    return op.select(key, F.when(F.col("op") == "removed", names[0]).otherwise(names[1]).alias("side"))


def _below(path: Column, scope: str) -> Column:
    scope = scope.rstrip("/")
    return F.lit(True) if not scope else (path == scope) | path.startswith(f"{scope}/")


def missing_companions(delta: DataFrame, obligations: list[dict], changed: DataFrame) -> DataFrame:
    """obligation, requirement of every obligation that the delta fires and whose companion did not change.

    obligations: dicts with id, kind, scope (a path and what is below it; empty: everything), name (glob, * crosses anything) and
    requirement (a path or glob that a changed path must match). They are authored, few, and become one filter each over one pass of the delta
    and of the changes. delta: family, scope, name; changed: path.
    """
    spark = delta.sparkSession
    fired = F.array_compact(
        F.array(
            *[
                F.when((F.col("family") == o["kind"]) & _below(F.col("scope"), o.get("scope") or "") & F.col("name").rlike(glob_regex(o.get("name") or "*")), F.lit(o["id"]))
                for o in obligations
            ]
        )
    )
    ids = delta.select(F.explode(fired).alias("obligation")).distinct()
    asked = spark.createDataFrame([(o["id"], o["requirement"]) for o in obligations], "obligation string, requirement string")
    wanted = sorted({o["requirement"] for o in obligations})
    hit = F.array_compact(F.array(*[F.when((F.col("path") == r) | F.col("path").rlike(glob_regex(r)), F.lit(r)) for r in wanted]))
    met = changed.select(F.explode(hit).alias("requirement")).distinct()
    return asked.join(ids, "obligation", "left_semi").join(met, "requirement", "left_anti").select("obligation", "requirement")


def merged_obligations(manual: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Union with precedence: a manual entry wins over a derived one, a later manual one over an earlier."""
    ranked = manual.withColumn("origin", F.lit("manual")).withColumn("rank", F.lit(1)).unionByName(derived.withColumn("origin", F.lit("derived")).withColumn("rank", F.lit(0)))
    best = ranked.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in ranked.columns if c not in (*keys, "rank", "ord")]), F.struct("rank", "ord")).alias("row"))
    return best.select(*keys, "row.*")
