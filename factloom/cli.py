"""python -m factloom.cli COMMAND: questions to a repository's facts."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.presets import listed
from .operators.select import QueryError
from .plans.catalog import Catalog
from .schemas import OPEN_GAPS
from .sources.declared import DeclarationError


def _print(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), sort_keys=True, ensure_ascii=False))


def main(argv: list[str] | None = None) -> int:
    """Exit codes: check 1 if there is an error, query and schema 2 for one that cannot be, else 0."""
    parser = argparse.ArgumentParser(prog="factloom")
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("inventory", "summary", "schema", "chapters", "pack", "mermaid", "provenance", "policies", "calibrate"):
        commands.add_parser(name)
    commands.add_parser("tree").add_argument("--nested", action="store_true")
    commands.add_parser("preflight").add_argument("--task")
    delta = commands.add_parser("delta")
    delta.add_argument("--ref", default="HEAD")
    check = commands.add_parser("check")
    check.add_argument("--as-of")
    status = commands.add_parser("status")
    status.add_argument("paths", nargs="*")
    status.add_argument("--since")
    query = commands.add_parser("query")
    query.add_argument("kind")
    query.add_argument("--select", action="append", default=[])
    preset = commands.add_parser("preset")
    preset.add_argument("name", nargs="?")
    preset.add_argument("--context", default="example")
    preset.add_argument("--shared")
    impact = commands.add_parser("impact")
    impact.add_argument("target")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("factloom").getOrCreate()
    try:
        catalog = Catalog(spark, args.root)
        if catalog.config_error is not None and args.command != "check":
            raise DeclarationError(catalog.config_error)
        if args.command == "check":
            found = catalog.check(args.as_of).cache()
            _print(found)
            return int(not found.where("severity = 'error'").isEmpty())
        if args.command == "query":
            _print(catalog.query(args.kind, args.select))
        elif args.command == "schema":
            _print(catalog.schema())
        elif args.command == "impact":
            print(json.dumps({"open_world": {"is_lower_bound": True, "misses": list(OPEN_GAPS["calls"])}}, sort_keys=True))
            _print(catalog.impact(args.target).orderBy("distance", "node"))
        elif args.command == "delta":
            _print(catalog.delta(args.ref).drop("call_key").orderBy("family", "scope", "name"))
        elif args.command in ("preflight", "provenance"):
            print(json.dumps(catalog.context_pack(args.task) if args.command == "preflight" else catalog.provenance(), sort_keys=True, ensure_ascii=False, indent=2))
        elif args.command == "status":
            rows, state = catalog.status(args.paths, args.since)
            print(f"baseline: {state}")
            _print(rows)
        elif args.command == "summary":
            _print(catalog.summary())
        elif args.command == "inventory":
            for piece in catalog.inventory_pieces():
                print(piece, end="")
            print()
        elif args.command == "policies":
            _print(catalog.policies().orderBy("id"))
        elif args.command == "calibrate":
            _print(catalog.calibration().orderBy("kind", "subject", "object", "source", "line"))
        elif args.command == "preset" and args.name is None:
            _print(listed(catalog.presets(args.shared)).select("name", "description", "place").orderBy("name"))
        elif args.command == "preset":
            units, rules = catalog.rendered(args.name, args.context, args.shared)
            _print(units.orderBy("ord"))
            _print(rules.orderBy("unit", "forbidden"))
        elif args.command == "tree":
            _print(catalog.nested_tree().orderBy("place") if args.nested else catalog.tree().orderBy("node"))
        elif args.command == "chapters":
            _print(catalog.chapters().orderBy("id"))
        elif args.command == "pack":
            for name, df in catalog.pack().items():
                print(f"# {name}")
                _print(df)
        else:
            print(catalog.mermaid(), end="")
    except (QueryError, DeclarationError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
