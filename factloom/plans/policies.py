"""Policies: each is a query that gives rows of ``findings``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, glob_regex, parent, under
from ..operators import claims as C
from ..operators import delta as D
from ..operators import duplicates as DU
from ..operators import graph as G
from ..operators import matching as M
from ..operators import obligations as B
from ..operators import ownership as O
from ..operators import resolve as R
from ..sources.text_claims import LIVE, live_documents

GLOB_SIGNS = r"[*?\[]"
_EVIDENCE = "array<struct<path:string,line:int,detail:string>>"


def _at(path: Column | str, line: Column | None = None, detail: Column | None = None) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return F.array(F.struct(p.alias("path"), (F.lit(None) if line is None else line).cast("int").alias("line"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))


def _findings(df: DataFrame, severity: str, check: str, message: Column, evidence: Column, recommendation: Column | None = None, meta: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(severity).alias("severity"), F.lit(check).alias("check_id"), message.alias("message"), evidence.cast(_EVIDENCE).alias("evidence"), (none if recommendation is None else recommendation).alias("recommendation"), (none if meta is None else meta).alias("meta"))


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def literal_units(units: DataFrame) -> DataFrame:
    return units.where(~F.col("path").rlike(GLOB_SIGNS)).select("id", F.when(F.col("path") == ".", "").otherwise(F.regexp_replace("path", "^[.]/|/$", "")).alias("prefix"), "status", (-F.col("ord")).alias("tie"))


def glob_units(units: DataFrame) -> list[tuple[str, str]]:
    """(id, pattern) of the units that are globs, as authored: a structure map is small."""
    return [(r.id, r.path.removeprefix("./")) for r in units.where(F.col("path").rlike(GLOB_SIGNS)).orderBy("ord").select("id", "path").collect()]


def missing_structure_owner(files: DataFrame, units: DataFrame) -> DataFrame:
    """Files that no unit owns, with the three units nearest to each."""
    placed = literal_units(units)
    orphans = O.owner_with_globs(files.select("path"), placed, glob_units(units), F.col("tie")).where("unit_id is null").select("path")
    near = O.nearest(orphans, placed).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit_id"))), lambda x: x["unit_id"]), ", ").alias("near"))
    joined = orphans.join(near, "path", "left")
    return _findings(joined, "error", "missing-structure-owner", _say("no unit owns ", F.col("path")), _at("path"), _say("nearest units: ", F.coalesce("near", F.lit("none"))), F.to_json(F.struct("path", "near")))


def structure_drift(units: DataFrame, disk: DataFrame) -> DataFrame:
    """Active literal units below the root whose path is not there."""
    active = literal_units(units).where("status = 'active' and prefix <> ''").where(~F.col("prefix").rlike(r"[*?\[]"))
    gone = active.join(disk.select(F.col("path").alias("prefix")).distinct(), "prefix", "left_anti")
    return _findings(gone, "error", "structure-drift", _say("unit ", F.col("id"), " names a path that is not there: ", F.col("prefix")), _at("prefix"))


def deprecated_path_used(files: DataFrame, deprecated: DataFrame) -> DataFrame:
    used = O.deepest_prefix(files.select("path"), deprecated.select("id", F.regexp_replace("path", "/$", "").alias("prefix")))
    named = used.join(deprecated.select("id", "replacement"), "id")
    return _findings(named, "error", "deprecated-path-used", _say(F.col("path"), " is below the deprecated path ", F.col("id")), _at("path"), F.when(F.col("replacement").isNotNull(), _say("use ", F.col("replacement"))))


def stale_claims(claims: DataFrame, check: str = "stale-claim", kinds: tuple[str, ...] = ("link",)) -> DataFrame:
    """References that lead nowhere; of Markdown only links, of HTML both kinds."""
    gone = claims.where(~F.col("exists") & F.col("kind").isin(*kinds))
    return _findings(gone, "warning", check, _say(F.col("source"), " refers to ", F.col("path"), ", which is not there"), _at("source", F.col("line")))


def stale_wiki_claims(claims: DataFrame, declared: list[str]) -> DataFrame:
    """Literal canonical sources that the configuration does not declare, and code references that lead nowhere."""
    known = reduce(lambda a, p: a | F.col("path").rlike(glob_regex(p)), declared, F.lit(False))
    undeclared = claims.where((F.col("kind") == "canonical_source") & (F.col("path_kind") == "literal") & ~known)
    gone = claims.where("kind <> 'concept_page' and not exists")
    one = _findings(undeclared, "warning", "stale-wiki-claim", _say(F.col("path"), " is called a canonical source but not declared"), _at("source", F.col("line")))
    return one.unionByName(_findings(gone, "warning", "stale-wiki-claim", _say(F.col("source"), " names ", F.col("path"), ", which is not there"), _at("source", F.col("line"))))


def _occurrences(evidence: Column) -> Column:
    return F.transform(evidence, lambda e: F.struct(e["module"].alias("path"), e["line"].cast("int").alias("line"), F.lit(None).cast("string").alias("detail")))


def duplicates(symbols: DataFrame, scope: str = "src/") -> DataFrame:
    """Public names below ``scope`` that several modules define."""
    return DU.duplicate_names(symbols.where(F.col("module").startswith(scope)), public_only=True)


def duplicate_symbol(symbols: DataFrame, scope: str = "src/") -> DataFrame:
    found = duplicates(symbols, scope)
    return _findings(found, "warning", "duplicate-symbol", _say(F.col("name"), " is defined in ", F.col("n_modules"), " modules"), _occurrences(F.col("evidence")), None, F.to_json(F.struct("name", "modules")))


def duplicate_implementation(symbols: DataFrame, claims: DataFrame, scope: str = "src/") -> DataFrame:
    """claims: symbol, relationship, owner, reason, modules. A malformed claim excuses nothing and is an error itself."""
    whole = F.lit(True)
    for c in ("symbol", "relationship", "owner", "reason"):
        whole = whole & F.coalesce(F.trim(c) != "", F.lit(False))
    whole = whole & F.coalesce(F.size("modules") >= 2, F.lit(False))
    found = DU.unclaimed(DU.duplicate_names(symbols.where(F.col("module").startswith(scope))), claims.where(whole).select(F.col("symbol").alias("name"), "modules"))
    told = _findings(found, "error", "duplicate-implementation", _say(F.col("name"), " is defined in ", F.col("n_modules"), " modules and no claim covers them"), _occurrences(F.col("evidence")), None, F.to_json(F.struct("name", "modules")))
    wrong = _findings(claims.where(~whole), "error", "claim-schema-invalid", _say("malformed duplicate claim: ", F.coalesce("symbol", F.lit("without a symbol"))), F.array())
    return told.unionByName(wrong)


def dependency_direction(imports: DataFrame, units: DataFrame, rules: DataFrame) -> DataFrame:
    placed = literal_units(units)
    paths = imports.select(F.col("module").alias("path")).union(imports.select("target_path")).where("path is not null").distinct()
    owned = O.owner(paths, placed, F.col("tie")).select("path", F.col("unit_id").alias("unit"))  # rules are of literal units; globs own files only
    bad = R.leaves_only(R.forbidden_edges(imports, rules, owned, placed.select(F.col("id").alias("unit"), "prefix")))
    lined = bad.join(imports.groupBy("module", "target").agg(F.min("line").alias("line"), F.min("target_path").alias("target_path")), ["module", "target"])
    evidence = F.array(F.struct(F.col("module").alias("path"), F.col("line").cast("int").alias("line"), F.lit(None).cast("string").alias("detail")), F.struct(F.col("target_path").alias("path"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("detail")))
    return _findings(lined, "error", "dependency-direction", _say(F.col("module"), " must not import ", F.col("target"), " of unit ", F.col("forbidden")), evidence)


def fact_coupling(delta: DataFrame, rules: DataFrame, changed: DataFrame, wrong: list[str], malformed: DataFrame) -> DataFrame:
    """Rules (operators.obligations) that the delta (family, scope, name, call_key) fires and whose requirement did not change.

    What is wrong with authored couplings, and malformed lines of live documents (source, line, detail), are errors as well.
    """
    bad = delta.sparkSession.createDataFrame([(w,) for w in wrong], "told string")
    out = _findings(bad, "error", "fact-coupling", _say("malformed coupling: ", F.col("told")), _at(F.lit("claims.yml")))
    out = out.unionByName(_findings(malformed, "error", "fact-coupling", _say("malformed declaration in a live document: ", F.col("detail")), _at("source", F.col("line"), F.col("detail"))))
    if rules.isEmpty():
        return out
    missing = B.unmet(B.fired(rules, delta), changed)
    said = _say("a ", F.col("kind"), " fact under ", F.col("scope"), F.when(F.col("name").isNotNull(), _say(" matching ", F.col("name"))).otherwise(""), " asks for a change of ", F.col("requirement"), ", which did not change")
    place = F.when(F.col("origin") == "manual", F.lit("claims.yml")).otherwise(F.col("requirement"))
    line = F.when(F.col("origin") != "manual", F.col("ord"))
    told = _findings(missing, "error", "fact-coupling", said, _at(place, line, F.col("id")), None, F.to_json(F.struct("kind", "scope", F.coalesce("name", F.lit("")).alias("name"), F.col("requirement").alias("requires"), "origin")))
    return told.unionByName(out)


def generated_drift(claims: DataFrame, pages: DataFrame, units: DataFrame, items: DataFrame) -> DataFrame:
    """Generated pages without claims, and claims of unit paths and item states that are not so."""
    facts = units.select(F.lit("unit").alias("kind"), F.col("id").alias("subject"), F.col("path").alias("value")).union(items.select(F.lit("roadmap"), "id", "status"))
    key = F.concat_ws("\x00", "kind", "subject")
    judged = C.verify_values(claims.withColumn("name", F.col("subject")).withColumn("subject", key), facts.select(key.alias("subject"), "value")).where("verdict <> 'ok'")
    told = _findings(judged, "error", "generated-wiki-drift", _say(F.col("kind"), " ", F.col("name"), ": ", F.col("verdict")), _at("source", F.col("line")))
    bare = pages.join(claims.select("source").distinct(), "source", "left_anti")
    return told.unionByName(_findings(bare, "error", "generated-wiki-drift", _say(F.col("source"), " has no claims"), _at("source")))


def node_universe(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """node: symbols, ends of calls and every path above them."""
    address = lambda path, owner, symbol: F.concat_ws("::", path, owner, symbol)
    ends = [calls.select(F.col(f"{e}_path").alias("path"), address(F.col(f"{e}_path"), F.col(f"{e}_class"), F.col(f"{e}_symbol")).alias("node")) for e in ("caller", "callee")]
    own = symbols.select(F.col("module").alias("path"), address(F.col("module"), F.lit(""), F.col("name")).alias("node"))
    every = own.unionByName(ends[0]).unionByName(ends[1])
    return every.select("node").union(every.select(F.explode(ancestors(F.col("path"))))).where("node <> ''").distinct()


def call_pairs(calls: DataFrame) -> DataFrame:
    address = lambda e: F.concat_ws("::", f"{e}_path", f"{e}_class", f"{e}_symbol")
    return calls.select(address("caller").alias("subject"), address("callee").alias("object")).distinct()


def repair_targets(stale: DataFrame, delta: DataFrame) -> DataFrame:
    """source, line, kind, old, new, action of claims that lead nowhere: what they may mean now, null if nothing added is like it.

    stale: source, line, kind, subject, object. A symbol claim is matched if its symbol was removed, a call claim if its call was; claims of
    methods, folders and files have no target.
    """
    part = lambda c, i: F.try_element_at(F.split(c, "::"), F.lit(i))
    three = lambda c: F.size(F.split(c, "::")) == 3
    symbols = stale.where("kind <> 'calls'").where(three("subject") & (part("subject", 2) == "") & (part("subject", 1) != "") & (part("subject", 3) != "")).select(*stale.columns, part("subject", 1).alias("module"), part("subject", 3).alias("name"))
    gone = delta.where("family = 'symbol_removed'").groupBy(F.col("scope").alias("module"), "name").agg(F.min("detail").alias("of_kind"))
    asked = symbols.join(gone, ["module", "name"], "left").withColumn("id", F.concat_ws("\x00", "source", F.col("line").cast("string"), "subject"))
    added = delta.where("family = 'symbol_added'").select(F.col("scope").alias("module"), "name", F.col("detail").alias("kind"))
    best = M.similar_symbols(asked.where("of_kind is not null").select("id", "name", "module", F.col("of_kind").alias("kind")), added)
    told = asked.join(best.select("id", F.concat_ws("::", "module", F.lit(""), "name").alias("new")), "id", "left")
    one = told.select("source", "line", "kind", F.col("subject").alias("old"), "new", F.lit("retarget-subject-node").alias("action"))
    six = [part(c, i).alias(n) for n, (c, i) in zip(M.CALL, [(c, i) for c in ("subject", "object") for i in (1, 2, 3)], strict=True)]
    calls = stale.where("kind = 'calls'").where(three("subject") & three("object")).select(F.concat_ws("\x00", "source", F.col("line").cast("string"), "subject", "object").alias("id"), *stale.columns, *six)
    keyed = lambda op: delta.where(F.col("family") == f"call_{op}").select(*[F.split("call_key", "\x00")[i].alias(n) for i, n in enumerate(M.CALL)])
    matched = M.similar_calls(calls.join(keyed("removed"), list(M.CALL), "left_semi").select("id", *M.CALL), keyed("added"))
    address = lambda e: F.concat_ws("::", *[F.col(f"{e}_{c}") for c in ("path", "class", "symbol")])
    named = matched.select("id", F.concat_ws(" -> ", address("caller"), address("callee")).alias("new"))
    other = calls.join(named, "id", "left").select("source", "line", "kind", F.concat_ws(" -> ", "subject", "object").alias("old"), "new", F.lit("retarget-call-edge").alias("action"))
    return one.unionByName(other)


def stale_anchors(claims: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Structural claims that no node or call bears out."""
    lone = C.unresolved(claims.where("kind <> 'calls'"), nodes.select(F.col("node").alias("subject")), ["subject"])
    return lone.unionByName(C.unresolved(claims.where("kind = 'calls'"), pairs, ["subject", "object"]).select(*lone.columns))


def code_anchor(claims: DataFrame, nodes: DataFrame, pairs: DataFrame, delta: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Structural claims that no node or call bears out, and what each may mean now by a delta that is made if it is needed."""
    both = G.written(stale_anchors(claims, nodes, pairs), "stale")
    if delta is None or both.isEmpty():
        both = both.withColumn("repair", F.lit(None).cast("string"))
    else:
        target = repair_targets(both, delta()).groupBy("source", "line").agg(F.min(F.to_json(F.struct("old", "new", "action"), {"ignoreNullFields": "false"})).alias("repair"))
        both = both.join(target, ["source", "line"], "left")
    return _findings(both, "warning", "code-anchor", _say(F.col("kind"), " ", F.col("subject"), F.when(F.col("object") != "", _say(" -> ", F.col("object"))).otherwise(""), " is not borne out"), _at("source", F.col("line")), None, F.col("repair"))


def plan_cycles(items: DataFrame) -> DataFrame:
    """Work items that wait for each other."""
    _, stuck = G.layers(items.select("id"), items.select("id", F.explode("depends_on").alias("on")))
    return _findings(stuck, "error", "program-plan-loads", _say("work item ", F.col("id"), " waits for itself"), F.array())


def load_errors(spark: SparkSession, errors: list[tuple[str, str]]) -> DataFrame:
    """Authored files that do not load, as findings: (check, message)."""
    return _findings(spark.createDataFrame(errors, "check string, told string"), "error", F.col("check"), F.col("told"), F.array())


def policy_registry(symbols: DataFrame, policies: DataFrame, folder: str) -> DataFrame:
    """Policies declared but not implemented (planned ones may wait), and the other way round."""
    made = symbols.where((F.col("kind") == "function") & F.col("name").startswith("check_") & under(F.col("module"), F.lit(folder))).select(F.expr("substring(name, 7)").alias("id"))
    planned = policies.where("status = 'planned'").select("id")
    side = D.symmetric_difference(made, policies.select("id"), "id", ("not declared", "not implemented"))
    told = side.join(planned.withColumn("side", F.lit("not implemented")), ["id", "side"], "left_anti")
    return _findings(told, "error", "policy-registry", _say("policy ", F.col("id"), " is ", F.col("side")), F.array())


def expired_waivers(waivers: DataFrame, as_of: str) -> DataFrame:
    from ..operators.select import expired

    return _findings(expired(waivers, as_of), "error", "waiver-schema-invalid", _say("waiver ", F.col("id"), " has expired"), F.array())


def unmatched_sources(files: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """Declared source patterns that match nothing: errors if authoritative, else warnings."""
    spark = files.sparkSession
    out = []
    for authority, severity in (("authoritative", "error"), ("supporting", "warning")):
        wanted = patterns.get(authority) or []
        marks = files.agg(*[F.max(F.col("path").rlike(glob_regex(p, crosses=False))).alias(f"p{i}") for i, p in enumerate(wanted)]).first() if wanted else ()
        missing = [(p,) for p, hit in zip(wanted, marks, strict=True) if not hit]
        out.append(_findings(spark.createDataFrame(missing, "pattern string"), severity, "declared-source-missing", _say("nothing matches ", F.col("pattern")), F.array()))
    return out[0].unionByName(out[1])


def live_sources(disk: DataFrame, patterns: list[str]) -> DataFrame:
    """Declared patterns of live documents that cannot name one, and those that do not name one that is there."""
    spark = disk.sparkSession
    good = [p for p in patterns if p.endswith(LIVE)]
    there = live_documents(disk.where("not is_dir"), good)
    marks = there.agg(*[F.max(F.col("path").rlike(glob_regex(p))).alias(f"p{i}") for i, p in enumerate(good)]).first() if good else ()
    frame = lambda some: spark.createDataFrame([(p,) for p in some], "pattern string")
    wrong = _findings(frame([p for p in patterns if p not in good]), "error", "anchor-live-document-invalid", _say("no live document can end as ", F.col("pattern")), _at(F.lit("config.yml"), detail=F.col("pattern")))
    gone = _findings(frame([p for p, hit in zip(good, marks, strict=True) if not hit]), "error", "anchor-live-document-missing", _say("no live document matches ", F.col("pattern")), _at(F.lit("config.yml"), detail=F.col("pattern")))
    return wrong.unionByName(gone)


#: The roles that a manifest of documents must require.
CANONICAL_ROLES = ("config", "policy_set", "program_plan", "structure_map", "waivers")


def document_set(roles: DataFrame, disk: DataFrame, authoritative: list[str], supporting: list[str], required: list[str] | None = None) -> DataFrame:
    """Canonical roles that are not required, documents that are not there, and of the others those whose authority the configuration contradicts."""
    there = disk.select("path").distinct()
    gone = roles.join(there, "path", "left_anti")
    of = lambda patterns: reduce(lambda a, p: a | F.col("path").rlike(glob_regex(p)), patterns, F.lit(False))
    # a role that neither list names is not judged
    other = roles.join(there, "path", "left_semi").where(F.when(of(authoritative), "authoritative").when(of(supporting), "supporting") != F.col("authority"))
    one = _findings(gone, "error", "document-set-complete", _say("document ", F.col("role"), " is not there: ", F.col("path")), _at("path"))
    out = one.unionByName(_findings(other, "error", "document-set-complete", _say("document ", F.col("role"), " has another authority in the configuration"), _at("path")))
    if required is not None:
        bare = roles.sparkSession.createDataFrame([(r,) for r in CANONICAL_ROLES if r not in required], "role string")
        out = out.unionByName(_findings(bare, "error", "document-set-complete", _say("canonical document role ", F.col("role"), " is not required"), _at(F.lit("documents.yml"))))
    return out


def task_context(disk: DataFrame, root: str, adapter: str | None = "trellis", needed: tuple[str, ...] = ("task.json", "prd.md")) -> DataFrame:
    """Folders at any depth below the tasks' root that hold a task.json but lack a needed file; an error if the root is not there.

    Only for the adapter that keeps tasks in folders.
    """
    if adapter != "trellis":
        return _findings(disk.limit(0), "warning", "trellis-task-context-missing", F.col("path"), _at("path"))
    root = root.removeprefix("./").rstrip("/") + "/tasks"
    bare = disk.where(F.col("is_dir") & (F.col("path") == root)).agg(F.count("*").alias("n")).where("n = 0")
    tasks = disk.where(~F.col("is_dir") & F.col("path").startswith(f"{root}/") & (F.substring_index("path", "/", -1) == "task.json")).select(parent(F.col("path")).alias("path"))
    asked = tasks.select("path", F.explode(F.array(*map(F.lit, needed))).alias("name")).withColumn("file", F.concat_ws("/", "path", "name"))
    gone = asked.join(disk.select(F.col("path").alias("file")), "file", "left_anti")
    out = _findings(gone, "warning", "trellis-task-context-missing", _say(F.col("path"), " has no ", F.col("name")), _at(F.concat_ws("/", "path", F.lit("task.json"))))
    return out.unionByName(_findings(bare, "error", "trellis-tasks-root-missing", _say("there is no folder of tasks: ", F.lit(root)), _at(F.lit("config.yml"))))


def report(parts: list[DataFrame]) -> DataFrame:
    """All findings in the fixed order of their policies, and within one by severity and message."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).when(F.col("severity") == "info", 2).otherwise(3)
    every = reduce(DataFrame.unionByName, [p.withColumn("emit_ord", F.lit(i)) for i, p in enumerate(parts)])
    return every.orderBy("emit_ord", rank, "check_id", "message")


def without_waived(findings: DataFrame, waivers: DataFrame) -> DataFrame:
    """Opt-in: findings whose check no waiver names. Reports keep all findings."""
    return findings.join(waivers.select(F.col("id").alias("check_id")).distinct(), "check_id", "left_anti")
