"""Authored YAML as relations. Files are small and authored; loading and validation stay on the driver."""

from __future__ import annotations

import json
import re
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import rows

STATUSES = ("active", "planned", "deprecated", "removed", "external")


class DeclarationError(ValueError):
    """An authored file that does not say what it must."""


class _Strict(yaml.SafeLoader):
    pass


def _mapping(loader: _Strict, node: yaml.MappingNode, deep: bool = False) -> dict:
    seen = set()
    for key, _ in node.value:
        name = loader.construct_object(key, deep=deep)
        if name in seen:
            raise DeclarationError(f"duplicate key {name!r} at line {key.start_mark.line + 1}")
        seen.add(name)
    return loader.construct_mapping(node, deep)


_Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, _mapping)


def load(text: str) -> dict[str, Any]:
    """The document's mapping; an empty file is an empty one. Repeated keys are errors."""
    try:
        found = yaml.load(text, _Strict)
    except yaml.YAMLError as e:
        raise DeclarationError(str(e)) from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise DeclarationError("the document must be a mapping")
    return found


def _text(entry: dict, name: str, where: str) -> str:
    value = entry.get(name)
    if not isinstance(value, str) or not value.strip():
        raise DeclarationError(f"{where}: {name} must be a non-empty string")
    return value.strip()


def structure(spark: SparkSession, document: dict) -> dict[str, DataFrame]:
    """units, rules and deprecated_paths of a structure map."""
    if not isinstance(document.get("version"), int) or document.get("kind") != "structure_map":
        raise DeclarationError("a structure map needs an integer version and kind structure_map")
    units = document.get("units")
    if not isinstance(units, dict) or not units:
        raise DeclarationError("a structure map needs units")
    default = (document.get("defaults") or {}).get("status", "active")
    out = []
    for i, (name, entry) in enumerate(units.items()):
        if not isinstance(entry, dict):
            raise DeclarationError(f"unit {name}: must be a mapping")
        status = entry.get("status", default)
        if status not in STATUSES:
            raise DeclarationError(f"unit {name}: unknown status {status!r}")
        children = list(entry.get("allowed_children") or [])
        for child in children:
            if child not in units:
                raise DeclarationError(f"unit {name}: unknown child {child!r}")
        fields = [_text(entry, f, f"unit {name}") for f in ("path", "kind", "owner", "purpose", "canonical_placement")]
        out.append((str(name), *fields, status, children, list(entry.get("must_update_if_changed") or []), list(entry.get("evidence") or []), i))
    rules = []
    for name, entry in (document.get("dependency_rules") or {}).items():
        for target in [*(entry.get("may_depend_on") or []), *(entry.get("must_not_depend_on") or [])]:
            if name not in units or target not in units:
                raise DeclarationError(f"dependency rule {name}: unknown unit")
        rules += [(name, t) for t in entry.get("must_not_depend_on") or []]
    old = [(k, _text(v, "path", f"deprecated path {k}"), v.get("status", "deprecated"), v.get("replacement"), v.get("reason")) for k, v in (document.get("deprecated_paths") or {}).items()]
    return {"units": rows(spark, "units", out), "rules": rows(spark, "rules", rules), "deprecated_paths": rows(spark, "deprecated_paths", old)}


def program(spark: SparkSession, document: dict) -> DataFrame:
    """work_items of a plan: ids well-formed and unique, dependencies known. Cycles are for ``graph.layers``."""
    if not isinstance(document.get("version"), int) or document.get("kind") != "program_plan":
        raise DeclarationError("a program plan needs an integer version and kind program_plan")
    default = (document.get("defaults") or {}).get("status")
    out, ids = [], set()
    items = document.get("work_items")
    if not isinstance(items, list) or not items:
        raise DeclarationError("a program plan needs work_items")
    for entry in items:
        if not isinstance(entry, dict):
            raise DeclarationError("a work item must be a mapping")
        name = _text(entry, "id", "work item")
        if not re.fullmatch(r"program:P\d+:[a-z0-9-]+", name) or name in ids:
            raise DeclarationError(f"work item {name!r}: malformed or repeated id")
        ids.add(name)
        status = entry.get("status", default)
        if not isinstance(status, str) or not status.strip():
            raise DeclarationError(f"work item {name}: needs a status, its own or a default")
        lists = [list(entry.get(k) or []) for k in ("depends_on", "trellis_tasks", "deliverables", "exit_criteria")]
        out.append((name, _text(entry, "phase", name), _text(entry, "title", name), status.strip(), lists[0], lists[1], entry.get("theme"), lists[2], lists[3]))
    for name, *_, needs, _t, _h, _d, _e in out:
        if missing := [x for x in needs if x not in ids]:
            raise DeclarationError(f"work item {name}: unknown dependency {missing[0]!r}")
    return rows(spark, "work_items", out)


def documents(spark: SparkSession, document: dict) -> DataFrame:
    """document_roles of a manifest."""
    if not isinstance(document.get("version"), int) or document.get("kind") != "document_role_manifest":
        raise DeclarationError("a manifest needs an integer version and kind document_role_manifest")
    default = (document.get("defaults") or {}).get("authority", "supporting")
    out = []
    for role, entry in (document.get("documents") or {}).items():
        authority = entry.get("authority", default)
        if authority not in ("authoritative", "supporting"):
            raise DeclarationError(f"document {role}: unknown authority {authority!r}")
        triggers = list(entry.get("updates_when") or [])
        if not triggers:
            raise DeclarationError(f"document {role}: updates_when must not be empty")
        out.append((role, _text(entry, "path", role), authority, _text(entry, "owner", role), triggers))
    missing = [r for r in document.get("required_roles") or [] if r not in {x[0] for x in out}]
    if missing:
        raise DeclarationError(f"required role {missing[0]!r} is not declared")
    return rows(spark, "document_roles", out)


def waivers(spark: SparkSession, document: dict) -> tuple[DataFrame, list[str]]:
    """id, reason, owner, expires (null unless written as text), and what is wrong with entries."""
    out, wrong = [], []
    entries = document.get("waivers") or []
    if not isinstance(entries, list):
        return spark.createDataFrame([], "id string, reason string, owner string, expires string"), ["waivers must be a list"]
    for i, entry in enumerate(entries):
        absent = [k for k in ("id", "reason", "owner", "expires") if not isinstance(entry, dict) or not entry.get(k)]
        if absent:
            wrong.append(f"waiver {i}: {', '.join(absent)} missing")
            continue
        expires = entry["expires"] if isinstance(entry["expires"], str) else None
        if expires is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", expires):
            wrong.append(f"waiver {entry['id']}: expires is not an ISO date")
        out.append((str(entry["id"]), str(entry["reason"]), str(entry["owner"]), expires))
    return spark.createDataFrame(out, "id string, reason string, owner string, expires string"), wrong


def preset_texts(spark: SparkSession, folders: list[Path]) -> DataFrame:
    """place, name, body (JSON; the YAML's own text where it does not load) of the .yml files of folders, the first going before the others."""
    out = []
    for place, folder in enumerate(folders):
        for path in sorted(folder.glob("*.yml")) if folder.is_dir() else []:
            text = path.read_text(errors="replace")
            try:
                text = json.dumps(load(text), default=str)
            except DeclarationError:
                pass
            out.append((place, path.stem, text))
    return spark.createDataFrame(out, "place int, name string, body string")


def policy_rows(spark: SparkSession, document: dict) -> DataFrame:
    """id, severity, status, enforcement (planned, gated or advisory) of declared policies."""
    entries = [(str(k), *((v.get("severity"), v.get("status")) if isinstance(v, dict) else (None, None))) for k, v in (document.get("policies") or {}).items()]
    told = spark.createDataFrame([(i, *(None if x is None else str(x) for x in rest)) for i, *rest in entries], "id string, severity string, status string")
    return told.withColumn("enforcement", F.when(F.col("status") == "planned", "planned").when(F.col("severity") == "error", "gated").otherwise("advisory"))
