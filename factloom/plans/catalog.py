"""A repository's fact relations as lazily built DataFrames, and the questions asked of them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import cached_property, reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import ancestors, parent, under
from ..operators import claims as C
from ..operators import delta as D
from ..operators import graph as G
from ..operators import matching as M
from ..operators import obligations as B
from ..operators import ownership as O
from ..operators import presets as R
from ..operators import select as S
from ..operators import status as ST
from ..schemas import empty, family_world
from ..sources import advisory as A
from ..sources import declared
from ..sources import languages as L
from ..sources import repository as repo
from ..sources import text_claims as T
from . import policies as P

#: Where a repository declares itself, below its control folder.
CONTROL = ".facts"
KINDS = ("units", "symbols", "imports", "calls", "doc_claims", "wiki_claims", "html_claims", "tasks", "work_items")
#: What the rows of a kind are sorted by; all their other columns follow.
_END = [f"{e}_{c}" for e in ("caller", "callee") for c in ("path", "class", "symbol")]
ORDER = {"symbols": ["module", "line", "name", "kind"], "imports": ["module", "line", "target"], "calls": _END, "doc_claims": ["source", "line", "path", "fragment", "kind"], "html_claims": ["source", "line", "path", "fragment", "kind"], "wiki_claims": ["source", "line", "concept", "kind", "path"]}


class Catalog:
    """Views over one repository. Each relation is parsed once, cached and shared by whatever asks for it."""

    def __init__(self, spark: SparkSession, root: str, control: str = CONTROL, exclude_under: tuple[str, ...] = ()):
        self.spark, self.root, self.control, self.exclude = spark, root, control, exclude_under
        self.config_error: str | None = None
        try:
            self.config = self._yaml("config.yml")
            self.languages = L.chosen(self.config.get("languages"))
        except (declared.DeclarationError, KeyError) as e:  # told by check() as its only finding
            self.config, self.config_error, self.languages = {}, str(e.args[0]), L.chosen(None)
        self.wiki = self.config.get("wiki") or {}
        book = self.wiki.get("book_root")
        book = "wiki" if book is None else book.removeprefix("./").rstrip("/")
        self.derived = tuple([book] if book else ())
        self._deltas: dict[str, DataFrame] = {}
        self.roots = tuple((self.config.get("workspace") or {}).get("roots") or ["."])

    def _yaml(self, name: str) -> dict[str, Any]:
        path = Path(self.root) / self.control / name
        return declared.load(path.read_text()) if path.exists() else {}

    @cached_property
    def files(self) -> DataFrame:
        found = repo.files(self.spark, self.root, self.roots, self.derived, self.control)
        for prefix in self.exclude:  # before extraction: resolution sees the smaller set
            found = found.where(~under(F.col("path"), F.lit(prefix)))
        return found.cache()

    @cached_property
    def disk(self) -> DataFrame:
        return repo.disk_paths(self.spark, self.root).cache()

    @cached_property
    def contents(self) -> DataFrame:
        return repo.contents(self.spark, self.root, self.files, sorted({*repo.TEXT_SUFFIXES, *L.extensions(self.languages)})).cache()

    @cached_property
    def events(self) -> DataFrame:
        return L.events(self.contents, self.languages).cache()

    @cached_property
    def structure(self) -> dict[str, DataFrame]:
        document = self._yaml("structure.yml")
        return declared.structure(self.spark, document) if document else {k: empty(self.spark, k) for k in ("units", "rules", "deprecated_paths")}

    @cached_property
    def relations(self) -> dict[str, Callable[[], DataFrame]]:
        return {
            "files": lambda: self.files,
            "units": lambda: self.structure["units"],
            "symbols": lambda: L.symbols(self.events, self.languages),
            "imports": lambda: L.imports(self.events, self.languages),
            "calls": lambda: L.calls(self.events, self.languages),
            "doc_claims": lambda: T.doc_claims(self.contents, self.disk, (*self._unread(), *(self.config.get("skip_docs") or ())), self.derived),
            "wiki_claims": lambda: T.wiki_claims(self.contents, self.disk, self.wiki.get("path", f"{self.control}/wiki"), self.derived),
            "html_claims": lambda: T.html_claims(self.contents, self.disk, self._sources("authoritative") + self._sources("supporting"), self.derived),
            "tasks": lambda: repo.tasks(self.contents, (self.config.get("workflow") or {}).get("root", ".trellis"))[0],
            "work_items": lambda: declared.program(self.spark, doc) if (doc := self._yaml("program.yml")) else empty(self.spark, "work_items"),
            "skipped": lambda: L.skipped(self.events),
        }

    @cached_property
    def anchors(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Structural claims to resolve, those of live documents (which make rules of change), and what is wrong in these.

        ``anchors: {live_documents: [patterns]}`` of the configuration names the live documents; they are read strictly, pages on code leniently.
        Without it every page with claims is live.
        """
        patterns = self._live()
        if patterns is None:
            claims, wrong = T.structural_claims(self.contents, strict=True)
            claims = G.written(claims, "claims")
            return claims, claims, wrong.cache()
        live, wrong = T.live_claims(self.contents, patterns)
        live = G.written(live, "claims")
        code, _ = T.structural_claims(self.contents.where(under(F.col("path"), F.lit(self.wiki.get("path", f"{self.control}/wiki").rstrip("/") + "/code"))))
        return G.written(code.unionByName(live).distinct(), "claims"), live, wrong.cache()

    def _live(self) -> list[str] | None:
        patterns = (self.config.get("anchors") or {}).get("live_documents")
        return None if patterns is None else [p for p in patterns if isinstance(p, str)] if isinstance(patterns, list) else []

    def _unread(self) -> tuple[str, ...]:
        """Folders whose pages make no claims: tasks, workspaces of the workflow, and pages on code, whose prose only advises."""
        return (".trellis/tasks/", ".trellis/workspace/", f"{self.control}/wiki/code/")

    def _sources(self, authority: str) -> list[str]:
        return list((self.config.get("constraint_sources") or {}).get(authority) or [])

    def table(self, name: str) -> DataFrame:
        if name not in self.relations:
            raise S.QueryError(f"unknown kind {name!r}; there are {', '.join(self.relations)}")
        if name not in self.__dict__:
            # what much is built on is written, which cuts its lineage; the others are cached
            made = self.relations[name]()
            self.__dict__[name] = G.written(made, name) if name in ("symbols", "imports", "calls") else made.cache()
        return self.__dict__[name]

    def register(self) -> None:
        """Every relation as a temporary view, for SQL."""
        for name in self.relations:
            self.table(name).createOrReplaceTempView(name)
        family_world(self.spark).createOrReplaceTempView("family_world")

    def query(self, kind: str, selectors: list[str]) -> DataFrame:
        if kind not in KINDS:
            raise S.QueryError(f"unknown kind {kind!r}; there are {', '.join(KINDS)}")
        return S.select_rows(self.table(kind), S.parse_selectors(selectors))

    def schema(self) -> DataFrame:
        return S.schema_of(self.spark, {k: self.table(k) for k in KINDS})

    @cached_property
    def advised(self) -> tuple[DataFrame, DataFrame]:
        """Calls that another program left in the control folder as calls.json, and what of it was left out."""
        path = Path(self.root) / self.control / "calls.json"
        payload = [(f"{self.control}/calls.json", path.read_text(errors="replace"))] if path.exists() else []
        edges, skipped = A.edges_from_json(self.spark.createDataFrame(payload, "source string, payload string"), str(Path(self.root).resolve()))
        return edges.cache(), skipped

    def impact(self, target: str) -> DataFrame:
        """What reaches the target (a path, a symbol, Class.method or module.symbol) over parsed and advised calls.

        node, distance, proven_distance (over parsed calls alone, null if only advice leads there), advised_only, n_via, provenance and
        resolution of the arriving calls, is_lower_bound: what is missing here may still be affected (schemas.OPEN_GAPS).
        """
        parsed = self.table("calls")
        ends = [f"{e}_{c}" for e in ("caller", "callee") for c in ("path", "class", "symbol")]
        calls = parsed.select(*ends, "caller_module", "callee_module", "resolution")
        told = self.advised[0].select(*ends, *[F.replace(F.regexp_replace(f"{e}_path", r"\.[^.]*$", ""), F.lit("/"), F.lit(".")).alias(f"{e}_module") for e in ("caller", "callee")], "resolution")
        pairs = A.impact_edges(calls, told).withColumn("proven", F.col("provenance") == "deterministic").cache()
        calls = calls.unionByName(told)
        end = lambda e: calls.select(F.concat_ws("::", f"{e}_path", f"{e}_class", f"{e}_symbol").alias("node"), *[F.col(f"{e}_{c}").alias(c) for c in ("module", "class", "symbol", "path")])
        nodes = end("caller").union(end("callee")).distinct()
        if target.endswith(".py") or "/" in target:
            wanted = nodes.where(F.col("path") == target.removeprefix("./"))
        else:
            names = ("symbol", F.concat_ws(".", "class", "symbol"), F.concat_ws(".", "module", "symbol"), F.concat_ws(".", "module", "class", "symbol"))
            wanted = nodes.where(F.lit(target).isin(*[F.col(n) if isinstance(n, str) else n for n in names]))
        reach = G.written(G.two_distances(pairs, wanted.select("node")), "impact")
        return G.affected(reach, pairs).withColumn("is_lower_bound", F.lit(True))

    def delta(self, ref: str = "HEAD") -> DataFrame:
        """family (symbol_added, ...), scope, name, detail (kind of a symbol, path of an import) and call_key between a commit and the working tree.

        Symbols are known by module, name and kind, imports with where they lead, calls by both ends; without a baseline all is added.
        """
        if ref in self._deltas:
            return self._deltas[ref]
        before = repo.contents_at(self.spark, self.root, ref, L.extensions(self.languages))
        base = L.events(before, self.languages).cache() if before is not None else self.events.limit(0)
        none = F.lit(None).cast("string")
        shapes = {
            "symbol": (L.symbols, ["module", "name", "kind"], ("module", "name"), F.col("kind"), none),
            "import": (L.imports, ["module", "target", "target_path"], ("module", "target"), F.col("target_path"), none),
            "call": (L.calls, list(M.CALL), ("caller_path", "callee_symbol"), none, B.call_key(*M.CALL)),
        }
        parts = []
        for family, (extract, keys, (scope, name), detail, key) in shapes.items():
            op = D.diff(extract(base, self.languages), extract(self.events, self.languages), keys).where("op <> 'same'")
            parts.append(op.select(F.concat_ws("_", F.lit(family), "op").alias("family"), F.col(scope).alias("scope"), F.col(name).alias("name"), detail.alias("detail"), key.alias("call_key")))
        self._deltas[ref] = G.written(reduce(DataFrame.unionByName, parts), "delta")
        return self._deltas[ref]

    def status(self, paths: list[str] | None = None, since: str | None = None) -> tuple[DataFrame, str]:
        """What the changed files bring up (path, kind, message) and how the baseline stands: ok, no-baseline, stale-baseline or error.

        Changed is what differs from the last commit and, with ``since``, from that commit; ``paths`` narrow it. It never raises.
        """
        try:
            state = "ok" if repo.head_commit(self.root) else "no-baseline"
            changed = repo.changed_paths(self.spark, self.root)
            if since and state == "ok" and not repo.ref_resolves(self.root, since):
                state = "stale-baseline"
            elif since:
                changed = changed.union(repo.changed_paths(self.spark, self.root, since)).distinct()
            changed = ST.changed_below(changed, paths or [])
            found = P.missing_structure_owner(self.files, self.structure["units"]).unionByName(P.deprecated_path_used(self.files, self.structure["deprecated_paths"]))
            told = found.select(F.col("evidence")[0]["path"].alias("path"), F.col("check_id").alias("kind"), "message")
            rows = ST.status_rows(ST.affected(told, changed).unionByName(ST.affected_duplicates(P.duplicates(self.table("symbols")), changed))).cache()
            rows.count()  # what fails, fails here
            return rows, state
        except Exception:  # a turn must not fail by what advises it
            return self.spark.createDataFrame([], "path string, kind string, message string"), "error"

    def summary(self) -> DataFrame:
        """topic, n, shown of the inventory."""
        units, there = self.structure["units"], self.disk.select(F.col("path").alias("at")).distinct().withColumn("there", F.lit(True))
        known = P.literal_units(units).join(there, F.col("prefix") == F.col("at"), "left").select("id", ((F.col("prefix") == "") | F.coalesce("there", F.lit(False))).alias("exists"))
        globs = P.glob_units(units)
        if globs:
            known = known.unionByName(O.glob_counts(self.files, globs).select("id", (F.col("n") > 0).alias("exists")))
        unowned = O.owner_with_globs(self.files.select("path"), P.literal_units(units), globs, F.col("tie")).where("unit_id is null")
        return ST.summary(known, unowned, self.table("work_items"))

    def check(self, as_of: str | None = None) -> DataFrame:
        """All policies' findings in their fixed order. Authored files that do not load are findings, and the policies that need them wait."""
        if self.config_error is not None:
            return P.report([P.load_errors(self.spark, [("config-load-error", self.config_error)])])
        errors: list[tuple[str, str]] = []

        def loaded(check: str, make: Callable[[], Any], otherwise: Any) -> Any:
            try:
                return make()
            except declared.DeclarationError as e:
                errors.append((check, str(e)))
                return otherwise

        structure = loaded("structure-map-loads", lambda: self.structure, None)
        program = loaded("program-plan-loads", lambda: self.table("work_items"), None)
        roles = loaded("document-set-complete", lambda: declared.documents(self.spark, doc) if (doc := self._yaml("documents.yml")) else empty(self.spark, "document_roles"), None)
        policies = loaded("policy-load-error", lambda: self._yaml("policies.yml").get("policies") or {}, None)
        claims, live, malformed = self.anchors
        claims_doc = loaded("claims-load-error", lambda: self._yaml("claims.yml"), {})
        excuses = [(c.get("symbol"), c.get("relationship"), c.get("owner"), c.get("reason"), list(c.get("modules") or [])) for c in claims_doc.get("duplicate_relationships") or []]
        excuse = self.spark.createDataFrame(excuses, "symbol string, relationship string, owner string, reason string, modules array<string>")
        manual, wrong_rules = B.manual_rules(self.spark, claims_doc.get("fact_couplings"))
        anchored = not claims.isEmpty()
        rules = G.written(B.effective(manual, B.derived_rules(live)), "rules") if anchored or not manual.isEmpty() else manual
        symbols, imports, calls = (self.table(t) for t in ("symbols", "imports", "calls"))
        waivers, wrong = declared.waivers(self.spark, loaded("waiver-load-error", lambda: self._yaml("waivers.yml"), {}))
        authoritative, supporting = self._sources("authoritative"), self._sources("supporting")
        workflow = self.config.get("workflow") or {}
        parts = [
            P.load_errors(self.spark, errors),
            P.unmatched_sources(self.disk, {"authoritative": authoritative, "supporting": supporting}),
            P.live_sources(self.disk, self._live() or []),
            P.task_context(self.disk, workflow.get("root") or ".trellis", workflow.get("adapter")),
        ]
        if structure is not None:
            parts += [P.missing_structure_owner(self.files, structure["units"]), P.structure_drift(structure["units"], self.disk), P.deprecated_path_used(self.files, structure["deprecated_paths"])]
        if program is not None:
            parts.append(P.plan_cycles(program))
        if roles is not None:
            required = self._yaml("documents.yml").get("required_roles") or [] if (Path(self.root) / self.control / "documents.yml").exists() else None
            parts.append(P.document_set(roles, self.disk, authoritative, supporting, required))
        parts += [
            P.stale_claims(self.table("doc_claims")),
            P.stale_claims(self.table("html_claims"), "stale-html-claim", ("link", "code")),
            P.duplicate_symbol(symbols),
            P.duplicate_implementation(symbols, excuse),
        ]
        if structure is not None:
            parts.append(P.dependency_direction(imports, structure["units"], structure["rules"]))
        parts.append(P.stale_wiki_claims(self.table("wiki_claims"), authoritative + supporting))
        if rules is manual:  # nothing asks what has changed
            parts.append(P.fact_coupling(self.spark.createDataFrame([], "family string, scope string, name string, call_key string"), rules, self.disk, wrong_rules, malformed))
        else:
            parts.append(G.written(P.fact_coupling(self.delta(), rules, repo.changed_paths(self.spark, self.root), wrong_rules, malformed), "findings"))
        if structure is not None and program is not None:
            made, blocks = T.generated_claims(self.contents.where(under(F.col("path"), F.lit(self._book()))) if self._book() else self.contents.limit(0))
            parts.append(P.generated_drift(made, blocks.select("source"), structure["units"], program))
        if anchored:
            parts.append(G.written(P.code_anchor(claims, P.node_universe(symbols, calls), P.call_pairs(calls), self.delta), "findings"))
        if policies:
            named = [(str(k), v.get("status") if isinstance(v, dict) else None) for k, v in policies.items()]
            parts.append(P.policy_registry(symbols, self.spark.createDataFrame(named, "id string, status string"), self._yaml("policies.yml").get("implemented_under") or "policies"))
        if as_of:
            parts.append(P.expired_waivers(waivers, as_of))
        if wrong:
            rows = self.spark.createDataFrame([("error", "waiver-schema-invalid", w, [], None, None) for w in wrong], "severity string, check_id string, message string, evidence array<struct<path:string,line:int,detail:string>>, recommendation string, meta string")
            parts.append(rows)
        return P.report(parts)

    def tree(self) -> DataFrame:
        """node, kind, path, parent, unit_id of packages, modules, classes, functions and methods below the product roots."""
        roots = self.wiki.get("product_roots") or ["src"]
        inside = F.lit(False)
        for r in roots:
            inside = inside | under(F.col("path"), F.lit("" if r == "." else r))
        symbols = self.table("symbols").select(F.col("module").alias("path"), F.concat_ws("::", "module", F.lit(""), "name").alias("node"), "kind")
        methods = [self.table("calls").where(f"{e}_class <> ''").select(F.col(f"{e}_path").alias("path"), F.concat_ws("::", f"{e}_path", f"{e}_class", f"{e}_symbol").alias("node"), F.lit("method").alias("kind"), F.concat_ws("::", f"{e}_path", F.lit(""), f"{e}_class").alias("parent")) for e in ("caller", "callee")]
        own = symbols.withColumn("parent", F.col("path")).unionByName(methods[0]).unionByName(methods[1])
        modules = own.select("path").distinct().select("path", F.col("path").alias("node"), F.lit("module").alias("kind"), F.regexp_replace("path", "/?[^/]*$", "").alias("parent"))
        packages = modules.select(F.explode(ancestors(parent(F.col("path")))).alias("path")).where("path <> ''").distinct()
        packages = packages.select("path", F.col("path").alias("node"), F.lit("package").alias("kind"), parent(F.col("path")).alias("parent"))
        every = own.unionByName(modules).unionByName(packages).where(inside).groupBy("node").agg(F.min("kind").alias("kind"), F.min("path").alias("path"), F.min("parent").alias("parent"))
        owned = O.owner(every, P.literal_units(self.structure["units"]).where(~F.col("prefix").rlike(r"[*?\[]")))
        top = every.select(F.col("node").alias("parent")).withColumn("there", F.lit(True))
        return owned.join(top, "parent", "left").select("node", "kind", "path", F.when(F.col("there"), F.col("parent")).alias("parent"), "unit_id")

    def nested_tree(self) -> DataFrame:
        """The tree's rows with place and depth, each node before what it holds."""
        tree = G.written(self.tree(), "tree")
        return tree.join(G.preorder(tree), "node")

    def chapters(self) -> DataFrame:
        """id, path, owner of the declared units that own some node of the tree."""
        owning = self.tree().where("unit_id is not null").select(F.col("unit_id").alias("id")).distinct()
        return self.structure["units"].join(owning, "id", "left_semi").select("id", "path", "owner")

    def pack(self) -> dict[str, DataFrame]:
        """Six projections of the product: dependencies, symbols, ownership, concepts, evidence and roadmap."""
        roots = self.wiki.get("product_roots") or ["src"]
        inside = lambda c: reduce(lambda a, r: a | under(F.col(c), F.lit(r)), roots, F.lit(False))
        wiki = self.table("wiki_claims")
        return {
            "dependencies": self.table("imports").where(inside("module") & F.col("target_path").isNotNull()).select("module", "target_path").distinct().orderBy("module", "target_path"),
            "symbols": self.table("symbols").where(inside("module")).orderBy("module", "line", "name"),
            "ownership": self.structure["units"].select("id", "path", "owner", "status").orderBy("id"),
            "concepts": wiki.where("kind = 'concept_page'").select("concept", "path").distinct().orderBy("concept", "path"),
            "evidence": wiki.where("kind = 'evidence' and exists").select("concept", "path").distinct().orderBy("concept", "path"),
            "roadmap": self.table("work_items").select("id", "phase", "title", "status").orderBy("id"),
        }

    def provenance(self) -> dict[str, str | None]:
        """Digests of all facts and of the declared policies, each by itself and none if it cannot be had."""

        def safe(make: Callable[[], str | None]) -> str | None:
            try:
                return make()
            except Exception:  # it says of a run what it saw, and must not end it
                return None

        def facts() -> str | None:
            return S.tree_of({k: S.digest(self.table(k), sorted(self.table(k).columns)).first()[0] for k in KINDS})

        def policies() -> str | None:
            document = self._yaml("policies.yml")
            return "sha256:" + hashlib.sha256(json.dumps(document, sort_keys=True, default=str).encode()).hexdigest() if document else None

        return {"inventory_hash": safe(facts), "policy_version": safe(policies)}

    def context_pack(self, task: str | None = None) -> dict[str, Any]:
        """What to read before work: the task and, if there is one, what its changed files touch; what to repair; provenance.

        Lists are cut at their caps and say how many rows there are: affected units, symbols of these units to use again (80, by module, line and
        name), claims to repair (20) and advised calls (80).
        """
        found = self.table("tasks").where(F.col("id") == task).limit(1).collect() if task else []
        roots = self.wiki.get("product_roots") or ["src"]
        placed = P.literal_units(self.structure["units"])
        owned = O.owner(repo.changed_paths(self.spark, self.root).select("path").distinct(), placed, F.col("tie")).where("unit_id is not null").select(F.col("unit_id").alias("id")).distinct()
        units = self.structure["units"].join(owned, "id", "left_semi").select("id", "path", "owner")
        inside = reduce(lambda a, r: a | under(F.col("prefix"), F.lit("" if r == "." else r)), roots, F.lit(False))
        scopes = placed.join(owned, "id", "left_semi").where("prefix <> ''").where(inside).select(F.col("prefix").alias("scope")).distinct()
        reuse = self.table("symbols").select("*", F.explode(ancestors(F.col("module"))).alias("scope")).join(scopes, "scope", "left_semi").select("module", "name", "kind", "line").distinct()
        claims, _, _ = self.anchors
        stale = G.written(P.stale_anchors(claims, P.node_universe(self.table("symbols"), self.table("calls")), P.call_pairs(self.table("calls"))), "stale")
        sections = [S.section("repair_targets", P.repair_targets(stale, self.delta()), ["source", "line", "old"], 20), S.section("advised_calls", self.advised[0].drop("source"), [*M.CALL, "resolution"], 80)]
        if found:
            sections += [S.section("reuse_candidates", reuse, ["module", "line", "name"], 80), S.section("affected_units", units, ["id"], None)]
        lists = {name: {"rows": [], "total": 0, "truncated": False} for name in ("repair_targets", "advised_calls", *(("reuse_candidates", "affected_units") if found else ()))}
        for r in S.first_of_each(reduce(DataFrame.unionByName, sections)).orderBy("section", "rank").collect():  # bounded by the caps and the units
            lists[r["section"]] = {"rows": [*lists[r["section"]]["rows"], json.loads(r["row"])], "total": r["total"], "truncated": r["truncated"]}
        return {"kind": "context_pack", "task": found[0].asDict() if found else None, "read_first": sorted(self._sources("authoritative")), "supporting": sorted(self._sources("supporting")), **lists, "provenance": self.provenance()}

    def _book(self) -> str:
        return self.derived[0] if self.derived else ""

    def inventory_pieces(self) -> Iterator[str]:
        """The inventory's text in pieces: the driver holds one partition of one kind at a time."""
        yield "{"
        for i, kind in enumerate(sorted(KINDS)):
            df = self.table(kind)
            first = ORDER.get(kind, [])
            rows = df.orderBy(*first, *[c for c in df.columns if c not in first])
            yield ("," if i else "") + f'\n  "{kind}": ['
            some = False
            for r in rows.toLocalIterator():
                text = json.dumps(r.asDict(recursive=True), indent=2, sort_keys=True)
                yield ("," if some else "") + "\n    " + text.replace("\n", "\n    ")
                some = True
            yield "\n  ]" if some else "]"
        yield "\n}"

    def inventory(self) -> str:
        """All blocks as JSON with sorted keys and rows, the same bytes for the same facts."""
        return "".join(self.inventory_pieces())

    def policies(self) -> DataFrame:
        return declared.policy_rows(self.spark, self._yaml("policies.yml"))

    def calibration(self) -> DataFrame:
        """kind, subject, object, concept, tier, source, line of every claim of the corpus that another program left in the control folder.

        The corpus is ``cache/semantic`` there: never listed, checked or part of a digest. A claim that no node or call bears out is
        unconfirmed, since both families are open; its concept is never confirmed.
        """
        place = f"{self.control}/cache/semantic"
        pages = self.disk.where(~F.col("is_dir") & under(F.col("path"), F.lit(place)))
        claims, _ = T.structural_claims(repo.contents(self.spark, self.root, pages, (".md",)))
        claims = G.written(claims, "claims")
        tree = G.written(self.tree().select(F.col("node").alias("subject")), "tree")
        pairs = P.call_pairs(self.table("calls")).join(tree, "subject", "left_semi")
        there = C.tiers(claims.where("kind <> 'calls'"), tree, ["subject"], closed=False)
        called = C.tiers(claims.where("kind = 'calls'"), pairs, ["subject", "object"], closed=False)
        return there.unionByName(called).select("kind", "subject", "object", "concept", "tier", "source", "line")

    def presets(self, shared: str | None = None) -> DataFrame:
        """The repository's presets and those of a shared folder, with what is wrong with any and whether they can only advise here."""
        folders = [Path(self.root) / self.control / "presets", *([Path(shared)] if shared else [])]
        return R.with_advisory(R.presets(declared.preset_texts(self.spark, folders)), R.ecosystems(self.disk))

    def rendered(self, name: str, context: str = "example", shared: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Planned units and rules of a preset for a context."""
        found = self.presets(shared)
        one = R.chosen(found, name).first()
        if one is None or one["wrong"]:
            raise S.QueryError(f"preset {name!r} {one['wrong']}" if one else f"unknown preset {name!r}; there are {', '.join(r['name'] for r in R.listed(found).orderBy('name').collect())}")
        return R.rendered(found.where((F.col("name") == name) & (F.col("place") == one["place"])), context)

    def mermaid(self) -> str:
        edges = self.pack()["dependencies"].collect()
        names = {p: f"n{i}" for i, p in enumerate(sorted({x for r in edges for x in r}))}
        lines = [f'  {n}["{p.replace(chr(34), chr(39))}"]' for p, n in names.items()] + [f"  {names[r[0]]} --> {names[r[1]]}" for r in edges]
        return "\n".join(["graph LR", *lines]) + "\n"
