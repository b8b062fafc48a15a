"""Selection, introspection, caps, digests and ordering of relations."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty


class QueryError(ValueError):
    """A selector or kind that cannot be."""


def parse_selectors(selectors: list[str]) -> list[tuple[str, str]]:
    """FIELD=VALUE split at the first '='; the field must not be empty, the value may."""
    out = []
    for one in selectors:
        field, equals, value = one.partition("=")
        if not equals or not field:
            raise QueryError(f"selector must be FIELD=VALUE: {one!r}")
        out.append((field, value))
    return out


def spelled(df: DataFrame, field: str) -> Column:
    """A column's values as JSON spells scalars: true, false, null."""
    kind = df.schema[field].dataType
    text = F.to_json(F.col(field)) if isinstance(kind, Ty.ArrayType | Ty.MapType | Ty.StructType) else F.col(field).cast("string")
    return F.coalesce(text, F.lit("null"))


def select_rows(df: DataFrame, selectors: list[tuple[str, str]]) -> DataFrame:
    """Rows for which every selector holds; a field that the relation lacks never does."""
    tests = [spelled(df, f) == v if f in df.columns else F.lit(False) for f, v in selectors]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def schema_of(spark: SparkSession, kinds: dict[str, DataFrame]) -> DataFrame:
    """kind, n, fields (sorted, comma-joined) of each relation; an empty relation shows no fields."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n", F.when(F.col("n") > 0, ",".join(sorted(df.columns))).otherwise("").alias("fields")) for k, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def capped(df: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The first rows by ``order``, with the number of all rows and whether some are not shown."""
    total = df.agg(F.count("*").alias("total"))  # one row
    return df.orderBy(*order).limit(cap).join(F.broadcast(total)).withColumn("truncated", F.col("total") > cap)


def expired(waivers: DataFrame, as_of: str) -> DataFrame:
    """Waivers whose ``expires`` is an ISO date before ``as_of``; what is no text date is never expired."""
    return waivers.where(F.try_to_date("expires", "yyyy-MM-dd") < F.lit(as_of).cast("date"))


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Errors, warnings, infos and the rest; then check and message."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)
    return findings.orderBy(rank, "check_id", "message")


#: Distinct rows that one leaf of a digest's tree holds, about.
LEAF = 4096


def digest(df: DataFrame, columns: list[str], leaf: int = LEAF) -> DataFrame:
    """One row: ``sha256:`` and the hash of all rows, the same however they are partitioned; order says nothing, repeats do.

    A tree: rows become hashes with their counts (equal rows are counted before they are shuffled), hashes that begin alike make a leaf, and
    leaves are joined in order of their beginnings, four digits at a step, so no group holds more than about ``leaf`` or 65,536 hashes. How many
    digits a leaf has follows from the number of distinct rows alone: the fewest for which 16 ** digits leaves hold ``leaf`` rows each.
    """
    row = F.concat_ws("\t", *[spelled(df, c) for c in columns])
    hashed = df.select(F.sha2(row, 256).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    distinct, digits = hashed.count(), 0
    while leaf * 16**digits < distinct:
        digits += 1
    told = hashed.select(F.substring("h", 1, digits).alias("part"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("told"))
    while True:
        joined = told.groupBy("part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("told")), "\n"), 256).alias("h"))
        if not digits:
            whole = joined.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("h"))
            return whole.select(F.concat(F.lit("sha256:"), F.col("h")).alias("digest"))
        digits = max(0, digits - 4)
        told = joined.select(F.substring("part", 1, digits).alias("part"), F.concat_ws(":", "part", "h").alias("told"))


def tree_of(digests: dict[str, str | None]) -> str | None:
    """One digest of several named ones; none if one of them is none."""
    if any(v is None for v in digests.values()):
        return None
    return "sha256:" + hashlib.sha256("\n".join(f"{k}\t{v}" for k, v in sorted(digests.items())).encode()).hexdigest()


def section(name: str, df: DataFrame, order: list[str], cap: int | None) -> DataFrame:
    """Rows of one list as section, cap, key (an order shared by all lists) and row (JSON)."""
    # numbers are padded, so that texts sort as they do
    text = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.lpad(F.col(c).cast("string"), 20, "0") if isinstance(df.schema[c].dataType, Ty.IntegralType) else F.col(c).cast("string"))
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.select(F.lit(name).alias("section"), F.lit(cap).cast("int").alias("cap"), F.array(*map(text, order)).alias("key"), row.alias("row"))


#: Parts that a section is dealt to before its first rows are told.
PARTS = 32


def first_of_each(rows: DataFrame) -> DataFrame:
    """section, rank, row, total, truncated: the first rows of each section up to its cap, and how many there are.

    Counting and cutting are one pass: each part of a section numbers and counts its own rows and keeps its first ones; what is left of
    the parts is numbered again. Without a cap all rows stay.
    """
    part = F.pmod(F.xxhash64("row"), F.lit(PARTS))
    own = Window.partitionBy("section", "part")
    kept = rows.withColumn("part", part).withColumn("own", F.row_number().over(own.orderBy("key", "row"))).withColumn("own_total", F.count("*").over(own)).where("cap is null or own <= greatest(cap, 1)")
    whole = Window.partitionBy("section")
    every = kept.withColumn("rank", F.row_number().over(whole.orderBy("key", "row"))).withColumn("total", F.sum(F.when(F.col("own") == 1, F.col("own_total"))).over(whole))
    return every.where("cap is null or rank <= cap").select("section", "rank", "row", "total", F.coalesce(F.col("total") > F.col("cap"), F.lit(False)).alias("truncated"))
