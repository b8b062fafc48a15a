"""Symbols, imports and calls from Python events, resolved with joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, parent

_KEY = ["caller_path", "caller_class", "caller_symbol", "callee_path", "callee_class", "callee_symbol"]


def symbols(events: DataFrame) -> DataFrame:
    """module, name, kind, line of direct module-level classes and functions; repeated ones are kept."""
    return events.where("kind in ('class', 'function')").select(F.col("path").alias("module"), F.col("symbol").alias("name"), "kind", "line")


def skipped(events: DataFrame, family: str) -> DataFrame:
    return events.where("kind in ('failed', 'unreadable')").select(F.lit(family).alias("family"), F.col("path").alias("entry"))


def module_names(paths: DataFrame) -> DataFrame:
    """path, dotted, in_package, is_package of .py files (path): the unbroken chain of packages above each names it.

    Packages are read off the file set, never the disk.
    """
    packages = paths.where("path = '__init__.py' or endswith(path, '/__init__.py')").select(parent(F.col("path")).alias("dir")).distinct()
    up = paths.select("path", F.posexplode(ancestors(parent(F.col("path")))).alias("depth", "dir"))
    chain = up.join(packages, "dir").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("depth", "dir"))).alias("c"))
    run = F.filter("c", lambda x, i: x["depth"] == i)
    names = F.filter(F.transform(run, lambda x: F.substring_index(x["dir"], "/", -1)), lambda x: x != "")
    base = F.regexp_replace(F.substring_index("path", "/", -1), r"\.py$", "")
    joined = paths.select("path").join(chain, "path", "left").select("path", F.coalesce(F.reverse(names), F.array().cast("array<string>")).alias("names"), (F.coalesce(F.size(run), F.lit(0)) > 0).alias("in_package"), base.alias("base"))
    dotted = F.array_join(F.when(F.col("base") == "__init__", F.col("names")).otherwise(F.concat("names", F.array("base"))), ".")
    return joined.select("path", dotted.alias("dotted"), "in_package", (F.col("base") == "__init__").alias("is_package"))


def _package(strip: Column) -> Column:
    """The package a relative import starts from."""
    return F.when(strip, F.col("dotted")).when(F.instr("dotted", ".") > 0, F.regexp_replace("dotted", r"\.[^.]*$", "")).otherwise("")


def _absolute(package: Column, spare: int) -> Column:
    """module and level to a dotted name; null where the import climbs too far (``spare`` levels more are let through)."""
    parts = F.when(package == "", F.array().cast("array<string>")).otherwise(F.split(package, r"\."))
    kept = F.size(parts) - (F.col("level") - 1)
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(kept, F.lit(0))), ".")
    full = F.when(F.coalesce("module", F.lit("")) == "", base).when(base == "", F.col("module")).otherwise(F.concat_ws(".", base, F.col("module")))
    return F.when(F.col("level") == 0, F.coalesce("module", F.lit(""))).when(F.col("level") <= F.size(parts) + spare, full)


def imports(events: DataFrame) -> DataFrame:
    """module, target, target_path (null: external), line (first): modules named by imports anywhere in a file."""
    names = module_names(events.select("path").distinct())
    known = names.groupBy("dotted").agg(F.min("path").alias("target_path"))
    placed = events.join(names.select("path", "dotted"), "path")
    base = _absolute(_package(F.col("path").endswith("__init__.py")), 0)
    plain = placed.where("kind = 'import'").select("path", F.col("name").alias("target"), "line")
    whole = placed.where("kind = 'from' and module is not null").select("path", base.alias("target"), "line").where("target is not null")
    part = placed.where("kind = 'from_name'").withColumn("base", base).where("base is not null")
    sub = part.select("path", F.when(F.col("base") == "", F.col("name")).otherwise(F.concat_ws(".", "base", "name")).alias("target"), "line").join(known.select(F.col("dotted").alias("target")), "target", "left_semi")
    every = plain.unionByName(whole).unionByName(sub).groupBy(F.col("path").alias("module"), "target").agg(F.min("line").alias("line"))
    return every.join(known, every["target"] == known["dotted"], "left").select("module", "target", "target_path", "line")


def calls(events: DataFrame) -> DataFrame:
    """First-party calls from functions and methods of package modules to what they can be proved to mean.

    A name bound locally means nothing else; then an imported symbol, then a definition of the module; self.m is
    a method of the class; m.f a definition of an imported module. One row for each pair of ends, the first in path and source order.
    """
    readable = events.where("kind <> 'unreadable'").select("path").distinct()
    named = module_names(readable).where("in_package")
    good = named.join(events.where("kind = 'parsed'").select("path"), "path", "left_semi")
    scope = events.join(good, "path")
    defs = scope.where("kind in ('class', 'function')").groupBy("path", "dotted", "name").agg(F.min("line").alias("def_line"))
    last = scope.where("kind = 'class'").groupBy("path", F.col("symbol").alias("class")).agg(F.max("line").alias("body"))
    methods = scope.where("kind = 'method'").join(last, ["path", "class"]).where("level = body").groupBy("path", "class", F.col("symbol").alias("attr")).agg(F.min("line").alias("method_line"))
    modules = good.groupBy("dotted").agg(F.max("path").alias("to_path"))

    base = _absolute(_package(F.col("is_package")), 1)
    named_from = scope.where("kind = 'from_name'").withColumn("base", base).where("base is not null and base <> ''")
    local = F.coalesce("attr", "name")
    sub = named_from.select("path", local.alias("local"), "ord", F.concat_ws(".", "base", "name").alias("dotted")).join(modules, "dotted").select("path", "local", "ord", F.lit("module").alias("what"), "dotted", F.lit(None).cast("string").alias("symbol"))
    symbol = named_from.select("path", local.alias("local"), "ord", F.col("base").alias("dotted"), F.col("name").alias("symbol"))
    symbol = symbol.join(defs.select("dotted", F.col("name").alias("symbol")).distinct(), ["dotted", "symbol"]).select("path", "local", "ord", F.lit("symbol").alias("what"), "dotted", "symbol")
    whole = scope.where("kind = 'import'").select("path", F.coalesce("attr", F.substring_index("name", ".", 1)).alias("local"), "ord", F.col("name").alias("dotted"))
    whole = whole.join(modules, "dotted").select("path", "local", "ord", F.lit("module").alias("what"), "dotted", F.lit(None).cast("string").alias("symbol"))
    both = sub.unionByName(symbol).unionByName(whole)
    # of several bindings of a name the last in source order holds; a submodule goes before a symbol of one statement
    bound = both.groupBy("path", "local").agg(F.max_by(F.struct("what", "dotted", "symbol"), F.struct("ord", F.col("what") == "module")).alias("b")).select("path", "local", "b.*")

    made = scope.where("kind = 'call'").select("path", F.col("dotted").alias("caller_module"), F.col("class").alias("caller_class"), F.col("symbol").alias("caller_symbol"), F.col("line").alias("caller_line"), "ord", "name", "attr", "shadowed")
    made = made.join(bound.select("path", F.col("local").alias("name"), "what", F.col("dotted").alias("to"), F.col("symbol").alias("to_symbol")), ["path", "name"], "left")
    own = defs.select("path", "name", F.col("def_line").alias("own_line"))
    made = made.join(own, ["path", "name"], "left").join(methods.select("path", F.col("class").alias("caller_class"), "attr", "method_line"), ["path", "caller_class", "attr"], "left")
    there = defs.select(F.col("dotted").alias("to"), F.col("name").alias("wanted"), F.col("path").alias("there_path"), F.col("def_line").alias("there_line"))
    made = made.withColumn("wanted", F.coalesce("to_symbol", "attr")).join(there, ["to", "wanted"], "left")
    bare = F.col("attr").isNull() & ~F.col("shadowed")
    end = lambda module, owner, symbol, path, line, how: F.struct(module.alias("callee_module"), owner.alias("callee_class"), symbol.alias("callee_symbol"), path.alias("callee_path"), line.alias("callee_line"), F.lit(how).alias("resolution"))
    none = F.lit("")
    found = F.coalesce(
        F.when(bare & (F.col("what") == "symbol") & F.col("there_line").isNotNull(), end(F.col("to"), none, F.col("wanted"), F.col("there_path"), F.col("there_line"), "imported_symbol")),
        F.when(bare & F.col("own_line").isNotNull(), end(F.col("caller_module"), none, F.col("name"), F.col("path"), F.col("own_line"), "direct")),
        F.when((F.col("name") == "self") & (F.col("caller_class") != "") & F.col("method_line").isNotNull(), end(F.col("caller_module"), F.col("caller_class"), F.col("attr"), F.col("path"), F.col("method_line"), "self_method")),
        F.when(F.col("attr").isNotNull() & ~F.col("shadowed") & (F.col("what") == "module") & F.col("there_line").isNotNull(), end(F.col("to"), none, F.col("attr"), F.col("there_path"), F.col("there_line"), "module_attribute")),
    )
    edges = made.withColumn("end", found).where("end is not null").select(F.col("path").alias("caller_path"), "caller_module", "caller_class", "caller_symbol", "caller_line", "ord", "end.*")
    rest = ["caller_module", "caller_line", "callee_module", "callee_line", "resolution"]
    first = edges.groupBy(*_KEY).agg(F.min_by(F.struct(*rest), "ord").alias("first"))
    return first.select("first.caller_module", "caller_class", "caller_symbol", "caller_path", "first.caller_line", "first.callee_module", "callee_class", "callee_symbol", "callee_path", "first.callee_line", "first.resolution")
