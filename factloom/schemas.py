"""Schemas of the fact relations; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_END = "{0}_module string, {0}_class string, {0}_symbol string, {0}_path string, {0}_line int"

SCHEMAS = {
    "files": "path string",
    "disk_paths": "path string, is_dir boolean",
    "symbols": "module string, name string, kind string, line int",
    "imports": "module string, target string, target_path string, line int",
    "calls": f"{_END.format('caller')}, {_END.format('callee')}, resolution string",
    "doc_claims": "source string, line int, path string, fragment string, kind string, exists boolean",
    "html_claims": "source string, line int, path string, fragment string, kind string, exists boolean",
    "wiki_claims": "source string, line int, concept string, kind string, path string, path_kind string, exists boolean",
    "generated_claims": "source string, line int, kind string, subject string, value string",
    "structural_claims": "source string, line int, kind string, subject string, object string, concept string",
    "malformed_claims": "source string, line int, detail string",
    "tasks": "id string, status string, package string, dev_type string, priority string, archived boolean",
    "units": "id string, path string, kind string, owner string, purpose string, canonical_placement string, status string, allowed_children array<string>, must_update_if_changed array<string>, evidence array<string>, ord int",
    "rules": "unit string, forbidden string",
    "deprecated_paths": "id string, path string, status string, replacement string, reason string",
    "work_items": "id string, phase string, title string, status string, depends_on array<string>, trellis_tasks array<string>, theme string, deliverables array<string>, exit_criteria array<string>",
    "document_roles": "role string, path string, authority string, owner string, updates_when array<string>",
    "obligations": "kind string, scope string, name string, requirement string, origin string",
    "skipped": "family string, entry string",
    "findings": "severity string, check_id string, message string, evidence array<struct<path:string,line:int,detail:string>>, recommendation string, meta string, emit_ord int",
}

#: Families whose absence proves nothing (taken from code) and those that are complete (declared).
OPEN_FAMILIES = ("symbols", "imports", "calls")
CLOSED_FAMILIES = ("units", "work_items", "document_roles", "policies")

#: What an open family may miss, so that absence proves nothing.
OPEN_GAPS = {
    "symbols": ("names bound by assignment or execution", "definitions inside functions"),
    "imports": ("modules imported by name at run time",),
    "calls": ("calls through values, attributes of unknown objects and reflection", "calls from other languages and from outside the files in scope"),
}


def empty(spark: SparkSession, relation: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[relation])


def rows(spark: SparkSession, relation: str, values: list[tuple]) -> DataFrame:
    return spark.createDataFrame(values, SCHEMAS[relation])


def family_world(spark: SparkSession) -> DataFrame:
    """family, closed: whether a fact that is missing from the family is known not to hold."""
    return spark.createDataFrame([(f, False) for f in OPEN_FAMILIES] + [(f, True) for f in CLOSED_FAMILIES], "family string, closed boolean")
