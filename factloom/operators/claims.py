"""Claims held against facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tiers(claims: DataFrame, facts: DataFrame, keys: list[str], closed: bool) -> DataFrame:
    """Claims with ``tier``: confirmed by a fact; else contradicted in a closed family and unconfirmed in an open one."""
    known = facts.select(*keys).distinct().withColumn("known", F.lit(True))
    return claims.join(known, keys, "left").withColumn("tier", F.when(F.col("known"), "confirmed").otherwise("contradicted" if closed else "unconfirmed")).drop("known")


def unresolved(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    return claims.join(facts.select(*keys).distinct(), keys, "left_anti")


def verify_values(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims (subject, value) with ``verdict``: ok, mismatch or unknown subject. facts: subject, value, one row each."""
    known = facts.select("subject", F.col("value").alias("actual"))
    verdict = F.when(F.col("actual").isNull(), "unknown").when(F.col("actual") == F.col("value"), "ok").otherwise("mismatch")
    return claims.join(known, "subject", "left").withColumn("verdict", verdict).drop("actual")


def with_exists(claims: DataFrame, disk: DataFrame) -> DataFrame:
    """claims (path, ...) with ``exists``, from every path on disk, not only the scanned files."""
    there = disk.select("path").distinct().withColumn("there", F.lit(True))
    return claims.join(there, "path", "left").withColumn("exists", F.coalesce("there", F.lit(False))).drop("there")


def fresh(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """rows (path, kind, message) with their fingerprint, without those already seen (fingerprint)."""
    text = F.concat_ws("\x00", "path", "kind", "message")
    return rows.withColumn("fingerprint", F.substring(F.sha2(text, 256), 1, 16)).join(seen.select("fingerprint").distinct(), "fingerprint", "left_anti")


def page_drift(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and state (missing, changed, orphan) of generated pages that are not as expected. Both: path, content."""
    one = expected.select("path", F.sha2("content", 256).alias("want"))
    other = actual.select("path", F.sha2("content", 256).alias("have"))
    state = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "orphan").otherwise("changed")
    return one.join(other, "path", "full").where(~F.col("want").eqNullSafe(F.col("have"))).select("path", state.alias("state"))
