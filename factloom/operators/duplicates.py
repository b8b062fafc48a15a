"""Names defined in several modules, and declared sets that excuse them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_names(symbols: DataFrame, public_only: bool = False) -> DataFrame:
    """name, n_modules, modules (sorted, distinct), evidence (module, line) for names in two modules or more."""
    kept = symbols.where(~F.col("name").startswith("_")) if public_only else symbols
    grouped = kept.groupBy("name").agg(
        F.array_sort(F.collect_set("module")).alias("modules"),
        F.array_sort(F.collect_list(F.struct("module", "line"))).alias("evidence"),
    )
    return grouped.where(F.size("modules") >= 2).select("name", F.size("modules").cast("long").alias("n_modules"), "modules", "evidence")


def unclaimed(duplicates: DataFrame, claims: DataFrame) -> DataFrame:
    """Duplicates without a claim (name, modules) for exactly their set of modules."""
    key = lambda df: df.select("name", F.array_join(F.array_sort(F.array_distinct("modules")), "\x00").alias("module_set"))
    marked = duplicates.withColumn("module_set", F.array_join("modules", "\x00"))
    return marked.join(key(claims).distinct(), ["name", "module_set"], "left_anti").drop("module_set")
