"""What a turn or a report is told of findings and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affected(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """rows (path, ...) about one of the changed paths (path)."""
    return rows.join(changed.select("path").distinct(), "path", "left_semi")


def affected_duplicates(duplicates: DataFrame, changed: DataFrame) -> DataFrame:
    """duplicates (name, modules) as path, kind, message: once for each changed module that defines the name."""
    others = F.array_except("modules", F.array("path"))
    message = F.concat("path", F.lit(": public symbol '"), "name", F.lit("' is also defined in "), F.array_join(others, ", "))
    each = duplicates.select("name", "modules", F.explode("modules").alias("path"))
    return affected(each.select("path", F.lit("duplicate-symbol").alias("kind"), message.alias("message")), changed)


def status_rows(rows: DataFrame) -> DataFrame:
    """Each path, kind and message once, in that order."""
    return rows.select("path", "kind", "message").distinct().orderBy("path", "kind", "message")


def changed_below(changed: DataFrame, paths: list[str]) -> DataFrame:
    """Changed paths that are one of ``paths`` or below it; without paths, all."""
    wanted = [p.strip("/") for p in paths if p.strip("/")]
    if not wanted:
        return changed
    keep = F.lit(False)
    for p in wanted:
        keep = keep | (F.col("path") == p) | F.col("path").startswith(p + "/")
    return changed.where(keep)


def by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def totals(findings: DataFrame) -> DataFrame:
    """One row: errors, warnings, and whether there is no error. No findings are no errors."""
    counted = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counted.withColumn("ok", F.col("errors") == 0)


def sources_of(rows: DataFrame, block: str, source: str) -> DataFrame:
    """The different sources of each block, sorted."""
    return rows.groupBy(block).agg(F.array_sort(F.collect_set(source)).alias("sources"))


def summary(units: DataFrame, unowned: DataFrame, items: DataFrame, shown: int = 5) -> DataFrame:
    """topic, n, shown: units, those not on disk, unowned paths with the first few, and work items by status.

    units: id, exists. unowned: path. items: status (null: unknown). The ids of units not on disk, which are authored, meet in one place.
    """
    missing = units.where("not exists")
    first = unowned.select("path").orderBy("path").limit(shown).agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("head"))  # one row
    more = F.when(F.col("n") > shown, F.concat(F.lit(", +"), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    left = unowned.agg(F.count("*").alias("n")).join(F.broadcast(first)).select(F.lit("unowned").alias("topic"), "n", F.concat("head", more).alias("shown"))
    one = lambda df, topic, told: df.agg(F.count("*").alias("n"), told.alias("shown")).select(F.lit(topic).alias("topic"), "n", "shown")
    status = items.groupBy(F.concat(F.lit("status "), F.coalesce("status", F.lit("unknown"))).alias("topic")).agg(F.count("*").alias("n")).select("topic", "n", F.lit("").alias("shown"))
    return one(units, "units", F.lit("")).unionByName(one(missing, "not on disk", F.array_join(F.array_sort(F.collect_list("id")), ", "))).unionByName(left).unionByName(status)
