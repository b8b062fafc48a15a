"""Resolution of imports and references to definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors


def first_lines(edges: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """One row for each key with its smallest line; nulls in keys are values like others."""
    return edges.groupBy(*keys).agg(F.min(line).alias(line))


def first_by(edges: DataFrame, keys: list[str], order: list[str], take: list[str]) -> DataFrame:
    """The columns ``take`` of the first row of each key by ``order``; an aggregate, so hot keys combine before the shuffle."""
    best = edges.groupBy(*keys).agg(F.min_by(F.struct(*take), F.struct(*order)).alias("first"))
    return best.select(*keys, *[F.col("first")[c].alias(c) for c in take])


def resolve_targets(imports: DataFrame, module_paths: DataFrame) -> DataFrame:
    """imports (target, ...) with ``target_path``, null where the dotted name is not first-party."""
    known = module_paths.groupBy("dotted").agg(F.min("path").alias("target_path"))
    return imports.join(known, imports["target"] == known["dotted"], "left").drop("dotted")


def unique_only(definitions: DataFrame, key: str) -> DataFrame:
    """Definitions whose key nothing else has."""
    alone = definitions.groupBy(key).agg(F.count("*").alias("times")).where("times = 1").select(key)
    return definitions.join(alone, key, "left_semi")


def resolve_references(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """references (qualified, simple) with ``line`` and ``by`` of the one definition they mean.

    A qualified name that is defined decides alone: more than one such definition means no edge, even
    if the simple name is unique. Only a qualified name nobody defines falls back to the simple name.
    definitions: qualified, simple, line.
    """
    long = definitions.groupBy("qualified").agg(F.count("*").alias("q_times"), F.min("line").alias("q_line"))
    short = definitions.groupBy("simple").agg(F.count("*").alias("s_times"), F.min("line").alias("s_line"))
    both = references.join(long, "qualified", "left").join(short, "simple", "left")
    by = F.when(F.col("q_times") == 1, "qualified").when(F.col("q_times") > 1, None).when(F.col("s_times") == 1, "simple")
    line = F.when(by == "qualified", F.col("q_line")).when(by == "simple", F.col("s_line"))
    return both.select(*references.columns, line.alias("line"), by.alias("by"))


def forbidden_edges(edges: DataFrame, rules: DataFrame, module_units: DataFrame, unit_prefixes: DataFrame) -> DataFrame:
    """module, target, forbidden: first-party edges that a rule of the importer's own unit forbids.

    edges: module, target, target_path; module_units: path, unit; unit_prefixes: unit, prefix. The first
    forbidden unit by id is named; edges inside one unit and to the root are fine.
    """
    own = module_units.select(F.col("path").alias("module"), F.col("unit").alias("own"))
    other = module_units.select(F.col("path").alias("target_path"), F.col("unit").alias("other"))
    barred = rules.join(unit_prefixes, rules["forbidden"] == unit_prefixes["unit"]).where("prefix <> ''").select(rules["unit"].alias("own"), "forbidden", "prefix")
    placed = edges.where("target_path is not null").join(own, "module").join(other, "target_path").where("not (own <=> other)")
    keyed = placed.select("module", "target", "own", F.explode(ancestors(F.col("target_path"))).alias("prefix"))
    return keyed.join(barred, ["own", "prefix"]).groupBy("module", "target").agg(F.min("forbidden").alias("forbidden"))


def leaves_only(violations: DataFrame, separator: str = ".") -> DataFrame:
    """Without edges whose target is a strict ancestor of another violating target of the same module."""
    up = F.transform(F.sequence(F.lit(1), F.size(F.split("target", f"[{separator}]")) - 1), lambda n: F.call_function("substring_index", F.col("target"), F.lit(separator), n))
    above = violations.where(F.instr("target", separator) > 0).select("module", F.explode(up).alias("target")).distinct()
    return violations.join(above, ["module", "target"], "left_anti")
