"""Calls that another program has found, from its tables of nodes and edges; advice, never proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import written

#: Kinds of stored edges that are calls.
CALL_KINDS = ("calls", "instantiates")
KEYS = ("caller_path", "caller_class", "caller_symbol", "callee_path", "callee_class", "callee_symbol", "resolution")


def relative(path: Column, root: str) -> Column:
    """A path below ``root`` as the catalog spells it; null for what lies outside or is empty."""
    below = root.rstrip("/") + "/"
    plain = F.replace(F.when(path.startswith("file://"), F.substr(path, F.lit(8))).otherwise(path), F.lit("\\"), F.lit("/"))
    own = F.when(plain.startswith("./"), F.regexp_replace(plain, r"^(\./)+", "")).otherwise(plain)
    inner = F.when(plain.startswith(below), F.substr(plain, F.lit(len(below) + 1))).when(~plain.startswith("/"), own)
    return F.when((inner != "") & (inner != "..") & ~inner.startswith("../"), inner)


def line_number(line: Column) -> Column:
    """A line as a number; 0 for what is none or negative."""
    return F.greatest(F.lit(0), F.coalesce(F.trim(line.cast("string")).try_cast("int"), F.lit(0)))


def owner_class(qualified: Column, kind: Column, name: Column) -> Column:
    """The class of a method, from its qualified name; empty for everything else."""
    parts = F.split(F.replace(qualified, F.lit("::"), F.lit(".")), r"\.")
    is_method = (kind == "method") & (F.size(parts) >= 2) & (F.element_at(parts, -1) == name)
    return F.when(is_method, F.try_element_at(parts, F.lit(-2))).otherwise("")


def stored_calls(nodes: DataFrame, edges: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Calls between symbols of known files, each once with its smallest line.

    nodes: id, qualified_name, kind, name, file_path. edges: source, target, kind, line, provenance.
    files: path. Edges whose ends have no name or lie in no known file are left out.
    """
    own = nodes.select("id", relative(F.col("file_path"), root).alias("path"), owner_class(F.col("qualified_name"), F.col("kind"), F.col("name")).alias("class"), F.trim("name").alias("symbol"))
    known = own.where("symbol <> ''").join(files.select("path").distinct(), "path", "left_semi")
    end = lambda side, on: known.select(F.col("id").alias(on), *[F.col(c).alias(f"{side}_{c}") for c in ("path", "class", "symbol")])
    kind = F.when(F.coalesce("provenance", F.lit("")) == "", F.col("kind")).otherwise(F.concat_ws(":", "kind", "provenance"))
    made = edges.where(F.col("kind").isin(*CALL_KINDS)).select("source", "target", kind.alias("resolution"), line_number(F.col("line")).alias("line"))
    return made.join(end("caller", "source"), "source").join(end("callee", "target"), "target").groupBy(*KEYS).agg(F.min("line").alias("line"))


def impact_edges(calls: DataFrame, advised: DataFrame) -> DataFrame:
    """Both kinds of calls as callee, caller, source, provenance and resolution."""
    node = lambda e: F.concat_ws("::", f"{e}_path", f"{e}_class", f"{e}_symbol").alias(e)
    told = lambda df, source, provenance: df.select(node("callee"), node("caller"), F.lit(source).alias("source"), F.lit(provenance).alias("provenance"), "resolution").distinct()
    return told(calls, "parsed", "deterministic").unionByName(told(advised, "stored", "advisory"))


#: Where edges stand in a document, and the names that the parts of an edge go by, in the order they are asked for.
CONTAINERS = ("edges", "calls", "callEdges", "links")
NESTED = {
    "path": ("path", "file", "file_path", "filePath", "filename", "uri"),
    "symbol": ("symbol", "name", "function", "method", "label"),
    "class": ("class", "cls", "class_name", "className"),
    "line": ("line", "line_number", "lineNumber", "startLine"),
}
FLAT = {
    "path": ("{0}_path", "{0}_file", "{0}_file_path", "{0}Path", "{0}File"),
    "symbol": ("{0}_symbol", "{0}_name", "{0}_function", "{0}_method", "{0}Symbol", "{0}Name"),
    "class": ("{0}_class", "{0}_cls", "{0}_class_name", "{0}Class"),
    "line": ("{0}_line", "{0}_line_number", "{0}Line"),
}
RESOLUTION = ("resolution", "resolution_tag", "resolutionTag", "kind", "type")


def _object(value: Column, names: tuple[str, ...]) -> Column:
    """These fields of a variant that is an object, as variants (null: not there), all taken in one pass; null for what is no object."""
    return F.try_variant_get(value, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def _first(fields: str, names: tuple[str, ...]) -> Column:
    """The first of these fields that is there, whatever it holds."""
    return F.coalesce(*[F.col(fields)[n] for n in names])


def _said(found: Column, *kinds: str) -> Column:
    """A variant of one of these kinds as a text, trimmed; null for others."""
    return F.trim(F.when(F.schema_of_variant(found).isin(*kinds), F.try_variant_get(found, "$", "string")))


def _text(found: Column) -> Column:
    """A variant that is a text, trimmed; null for what is none or blank."""
    return F.nullif(_said(found, "STRING"), F.lit(""))


def _number(found: Column) -> Column:
    """A variant that is a positive whole number, also written as text; else null."""
    number = _said(found, "STRING", "BIGINT", "INT", "SMALLINT", "TINYINT").try_cast("long")
    return F.when((number > 0) & (number <= 2147483647), number.cast("int"))


def edges_from_json(documents: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Calls in documents (source, payload) of untyped JSON: edges (source, KEYS, line) and what was left out (source, entry, reason).

    A document is a list of edges or holds one under a container's name, or under graph.edges; an edge names its ends in objects of their own or in
    fields of its own. Edges whose ends lie outside ``root`` or lack a path or a symbol are told with a reason, as are documents
    that are no JSON or hold no list. Of edges of a document that are equal but for the line the first counts.
    """
    # the parser stops at the end of the first value; a field after the document, whose name no document knows, shows that it was all
    mark = F.concat(F.lit("end "), F.md5("payload"))
    framed = F.try_parse_json(F.concat(F.lit('{"doc":'), F.col("payload"), F.lit(',"'), mark, F.lit('":1}')))
    whole = documents.select("source", mark.alias("mark"), F.try_variant_get(framed, "$", "map<string,variant>").alias("framed"))
    parsed = whole.select("source", F.when(F.try_element_at("framed", F.col("mark")).isNotNull() & (F.size("framed") == 2), F.try_element_at("framed", F.lit("doc"))).alias("doc"))
    doc = F.col("doc")
    listed = lambda path: F.try_variant_get(doc, path, "array<variant>")
    rows = F.coalesce(listed("$"), *[listed(f"$.{c}") for c in CONTAINERS], listed("$.graph.edges"))
    told = parsed.select("source", F.when(doc.isNull(), "invalid-json").when(rows.isNull(), "unsupported-schema").alias("unread"), rows.alias("rows"))
    # an outer one: for others a filter on the rows would be pushed down to where the document is parsed, and parse it again
    exploded = told.select("source", "unread", F.posexplode_outer("rows").alias("entry", "edge"))
    roles = ("caller", "callee")
    flat = {(r, part): tuple(n.format(r) for n in FLAT[part]) for r in roles for part in FLAT}
    inner = tuple(n for names in NESTED.values() for n in names)
    # step by step, so that no field is looked up twice
    opened = exploded.select("source", "unread", "entry", _object(F.col("edge"), (*roles, *RESOLUTION, *(n for names in flat.values() for n in names))).alias("own"))
    nested = opened.select("source", "unread", "entry", "own", *[_object(F.col("own")[r], inner).alias(r) for r in roles])
    found = nested.select(
        "source",
        "unread",
        "entry",
        F.col("own").isNotNull().alias("is_object"),
        _first("own", RESOLUTION).alias("resolution"),
        *[_first(r, NESTED[part]).alias(f"{r}_{part}_in") for r in roles for part in NESTED],
        *[_first("own", flat[r, part]).alias(f"{r}_{part}_by") for r in roles for part in FLAT],
    )
    read = lambda r, part: F.coalesce(*[(_number if part == "line" else _text)(F.col(f"{r}_{part}_{how}")) for how in ("in", "by")])
    raw = found.select("source", "unread", "entry", "is_object", F.coalesce(_text(F.col("resolution")), F.lit("heuristic")).alias("resolution"), *[read(r, part).alias(f"{r}_{part if part != 'path' else 'raw'}") for r in roles for part in NESTED])
    defaults = {f"{r}_class": F.coalesce(f"{r}_class", F.lit("")) for r in roles} | {f"{r}_line": F.coalesce(f"{r}_line", F.lit(0)) for r in roles}
    ends = raw.withColumns(defaults | {f"{r}_path": relative(F.col(f"{r}_raw"), root) for r in roles})
    reason = F.when(F.col("entry").isNull(), F.col("unread")).when(~F.col("is_object"), "not-object")
    for role in ("caller", "callee"):
        for wrong, said in ((f"{role}_raw", "missing-path"), (f"{role}_path", "outside-repo"), (f"{role}_symbol", "missing-symbol")):
            reason = reason.when(F.col(wrong).isNull(), f"{role} {said}")
    # written once for both results; a filter on the reason would else be pushed down into every lookup
    judged = written(ends.select("source", "entry", *KEYS, F.col("caller_line").alias("line"), reason.alias("reason")), "edges")
    good = judged.where("reason is null and entry is not null").groupBy("source", *KEYS).agg(F.min_by("line", "entry").alias("line"))
    return good, judged.where("reason is not null").select("source", "entry", "reason")
