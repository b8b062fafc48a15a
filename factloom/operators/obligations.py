"""Rules about changes as a table: which of them a delta fires, and whose companion did not change.

A rule has id, kind (symbol_added, ...), scope (a path and what is below it; empty: everything), name (glob, null: any), call_key (an exact
call, null: by scope and name), requirement (a path or glob), origin and ord. Rules meet facts by equality: an exact call by its key, a literal
name by scope and name, and only globs by scope alone, with the pattern checked on what meets. A rule needs one
fact, so all of these are semi-joins that stop at the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, glob_anchor, glob_pattern, is_glob, normalise
from .graph import written

RULES = "id string, kind string, scope string, name string, call_key string, requirement string, origin string, ord long"
KINDS = tuple(f"{family}_{op}" for family in ("symbol", "import", "call") for op in ("added", "removed"))


def call_key(*parts: Column | str) -> Column:
    """An exact call as one string: caller's path, class and symbol, then the callee's."""
    return F.concat_ws("\x00", *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts])


def manual_rules(spark: SparkSession, entries: object) -> tuple[DataFrame, list[str]]:
    """Rules of authored couplings, in order, and what is wrong with the others."""
    if entries is None:
        entries = []
    if not isinstance(entries, list):
        return spark.createDataFrame([], RULES), ["`fact_couplings` must be a list"]
    rows, wrong = [], []
    for i, entry in enumerate(entries):
        problem = _problem(entry)
        if problem:
            wrong.append(f"fact_couplings[{i}]: {problem}")
            continue
        when = entry["when_fact"]
        rows += [(f"fact_couplings[{i}]", when["kind"], when["scope"], when.get("name"), None, r, "manual", len(rows) + k) for k, r in enumerate(entry["requires"])]
    rules = spark.createDataFrame(rows, RULES)
    return rules.withColumns({c: normalise(F.col(c)) for c in ("scope", "requirement")}), wrong


def _problem(entry: object) -> str | None:
    text = lambda x: isinstance(x, str) and bool(x.strip())
    when = entry.get("when_fact") if isinstance(entry, dict) else None
    requires = entry.get("requires") if isinstance(entry, dict) else None
    tests = [
        (isinstance(entry, dict), "not a mapping"),
        (isinstance(when, dict), "`when_fact` is not a mapping"),
        (isinstance(when, dict) and when.get("kind") in KINDS, f"`when_fact.kind` is none of {', '.join(KINDS)}"),
        (isinstance(when, dict) and isinstance(when.get("scope"), str) and when["scope"] != "", "`when_fact.scope` is no text"),
        (isinstance(when, dict) and (when.get("name") is None or text(when["name"])), "`when_fact.name` is empty or no text"),
        (isinstance(requires, list) and bool(requires), "`requires` is no list or empty"),
        (isinstance(requires, list) and all(map(text, requires)), "`requires` holds what is no text"),
    ]
    return next((said for good, said in tests if not good), None)


def derived_rules(claims: DataFrame) -> DataFrame:
    """Rules from structural claims of live documents (source, line, kind, subject, object): the document must change with what it names.

    A symbol that is defined, public symbols of a Python file that is contained, and exact calls; claims of methods and folders give none.
    """
    part = lambda c, i: F.try_element_at(F.split(c, "::"), F.lit(i))
    six = call_key(*[part(F.col(c), i) for c in ("subject", "object") for i in (1, 2, 3)])
    symbol = claims.where("kind = 'defines'").where((F.size(F.split("subject", "::")) == 3) & (part(F.col("subject"), 2) == "") & (part(F.col("subject"), 1) != "") & (part(F.col("subject"), 3) != ""))
    file = claims.where("kind = 'contains' and not contains(subject, '::') and endswith(subject, '.py')")
    call = claims.where("kind = 'calls'").where((F.size(F.split("subject", "::")) == 3) & (F.size(F.split("object", "::")) == 3))
    none = F.lit(None).cast("string")
    shape = lambda df, family, scope, name, key: df.select("source", "line", F.explode(F.array(F.lit(f"{family}_added"), F.lit(f"{family}_removed"))).alias("rule_kind"), scope.alias("scope"), name.alias("name"), key.alias("call_key"))
    every = shape(symbol, "symbol", part(F.col("subject"), 1), part(F.col("subject"), 3), none)
    every = every.unionByName(shape(file, "symbol", F.col("subject"), F.lit("[!_]*"), none))
    every = every.unionByName(shape(call, "call", part(F.col("subject"), 1), part(F.col("object"), 3), six))
    return every.select(
        F.concat_ws(":", "source", "line").alias("id"), F.col("rule_kind").alias("kind"), "scope", "name", "call_key", F.col("source").alias("requirement"), F.lit("live_doc_anchor").alias("origin"), F.col("line").cast("long").alias("ord")
    )


def effective(manual: DataFrame, derived: DataFrame) -> DataFrame:
    """One rule for each kind, scope, name, requirement and call: a manual one before a derived one, the last of manual and the first of derived ones."""
    rank = F.when(F.col("origin") == "manual", F.struct(F.lit(1).alias("manual"), F.col("ord").alias("place"))).otherwise(F.struct(F.lit(0).alias("manual"), (-F.col("ord")).alias("place")))
    every = manual.unionByName(derived).withColumn("key", F.struct("kind", "scope", F.coalesce("name", F.lit("")).alias("n"), "requirement", F.coalesce("call_key", F.lit("")).alias("c")))
    return every.groupBy("key").agg(F.max_by(F.struct(*manual.columns), F.struct(rank, F.col("id"))).alias("rule")).select("rule.*")


def meeting(globs: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of a glob (glob and ``on``; with its pattern) and a text (text and ``on``) that holds the glob's longest literal run at its place.

    A text is looked up once for each place that some glob's run has, not for each glob. Globs whose first and last characters are stars have no such
    run: they meet every text with equal ``on``.
    """
    key = ["back", "skip", "size", "whole"]
    asked = globs.select(*on, "glob").distinct().select(*on, "glob", glob_pattern(F.col("glob")).alias("pattern"), glob_anchor(F.col("glob")).alias("anchor")).select(*on, "glob", "pattern", "anchor.*")
    places = F.broadcast(asked.select(*key).distinct())  # as many as globs have shapes
    n = F.length("text")
    held = texts.select(*on, "text").distinct().join(places, (n >= F.col("skip") + F.col("size")) & ((F.col("whole") < 0) | (F.col("whole") == n)))
    at = F.when(F.col("back"), n - F.col("skip") - F.col("size")).otherwise(F.col("skip")) + 1
    return asked.join(held.withColumn("run", F.substr("text", at, F.col("size"))), [*on, *key, "run"]).select(*on, "glob", "pattern", "text")


def matched(globs: DataFrame, texts: DataFrame, on: list[str]) -> DataFrame:
    """The globs (glob and ``on``) that match some text with equal ``on``, each once. An inner join, so that a run of very many texts can be split."""
    return meeting(globs, texts, on).where(F.rlike("text", F.col("pattern"))).select(*on, "glob").distinct()


def fired(rules: DataFrame, delta: DataFrame) -> DataFrame:
    """The rules that some fact of the delta (family, scope, name, call_key) fires."""
    # written once each: every shape of rule reads both
    rules = written(rules, "rules")
    rest = rules.where("call_key is null")
    at = delta.select(F.col("family").alias("f"), F.explode(ancestors(F.col("scope"))).alias("at"), F.col("name").alias("called"))
    facts = written(at.join(rest.select(F.col("kind").alias("f"), F.col("scope").alias("at")).distinct(), ["f", "at"], "left_semi").distinct(), "facts")
    exact = delta.where("call_key is not null").select(F.col("family").alias("f"), F.col("call_key").alias("k")).distinct()
    by_call = rules.where("call_key is not null").join(exact, (F.col("kind") == F.col("f")) & (F.col("call_key") == F.col("k")), "left_semi")
    same = (F.col("kind") == F.col("f")) & (F.col("scope") == F.col("at"))
    anyone = rest.where("name is null").join(facts.select("f", "at").distinct(), same, "left_semi")
    named = rest.where(~is_glob(F.col("name"))).join(facts, same & (F.col("name") == F.col("called")), "left_semi")
    # rules of one kind, scope and pattern are checked once
    asked = rest.where(is_glob(F.col("name"))).select("kind", "scope", F.col("name").alias("glob"))
    hit = matched(asked, facts.select(F.col("f").alias("kind"), F.col("at").alias("scope"), F.col("called").alias("text")), ["kind", "scope"]).withColumnRenamed("glob", "name")
    globbed = rest.where(is_glob(F.col("name"))).join(hit, ["kind", "scope", "name"], "left_semi").select(*rest.columns)
    return by_call.unionByName(anyone).unionByName(named).unionByName(globbed)


def unmet(rules: DataFrame, changed: DataFrame) -> DataFrame:
    """The rules whose requirement no changed path (path) is or matches."""
    rules = written(rules, "fired")
    asked = rules.select("requirement").distinct()
    paths = changed.select(F.col("path").alias("p")).distinct()
    literal = asked.join(paths, F.col("requirement") == F.col("p"), "left_semi")
    globs = matched(asked.where(is_glob(F.col("requirement"))).select(F.col("requirement").alias("glob")), paths.select(F.col("p").alias("text")), [])
    return rules.join(literal.union(globs).distinct(), "requirement", "left_anti").select(*rules.columns)
