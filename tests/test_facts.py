"""Fact operators on small relations; names carry the survey's ids."""

from __future__ import annotations

import random
import subprocess

import pytest
from factloom.functions import paths as P
from factloom.functions import text as T
from factloom.operators import claims as C
from factloom.operators import code as K
from factloom.operators import delta as D
from factloom.operators import duplicates as DU
from factloom.operators import graph as G
from factloom.operators import matching as M
from factloom.operators import obligations as B
from factloom.operators import ownership as O
from factloom.operators import resolve as R
from factloom.operators import select as S
from factloom.operators import status as ST
from factloom.plans import policies as PO
from factloom.plans.catalog import Catalog
from factloom.sources import advisory as A
from factloom.sources import declared
from factloom.sources import languages as L
from factloom.sources import text_claims as TC
from factloom.streaming.injector import budget
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def values(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns))
    return row.select(expression).first()[0]


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def units(spark, **prefixes):
    return spark.createDataFrame([(k, v) for k, v in prefixes.items()], "id string, prefix string")


def test_p7_p8_under_is_safe_for_siblings(spark):
    for path, root, want in (("a/b", "a", True), ("ab", "a", False), ("a", "a", True), ("x", "", True)):
        assert values(spark, P.under(F.col("p"), F.col("r")), p=path, r=root) is want


def test_t8_t3_normalise_and_collapse(spark):
    for raw, want in ((" ./a\\b/ ", "a/b"), (".", ""), ("./", ""), ("a", "a")):
        assert values(spark, P.normalise(F.col("p")), p=raw) == want
    for raw, want in (("a/../b", "b"), ("../x", None), ("a/./b//c", "a/b/c"), ("a/../../b", None)):
        assert values(spark, P.collapse(F.col("p")), p=raw) == want


def test_h7_two_glob_dialects(spark):
    for path, pattern, crosses, want in (("a/b.md", "*.md", True, True), ("a/b.md", "*.md", False, False), ("a/b/c.md", "a/**/*.md", False, True), ("a.md\n", "*.md", True, False), ("x1", "x[0-9]", True, True), ("xa", "x[!0-9]", True, True), ("a+b", "a+b", True, True)):
        assert values(spark, P.matches(F.col("p"), pattern, crosses), p=path) is want, (path, pattern)


def test_h8_lines_split_like_python(spark):
    for text in ("a\nb\n", "a\r\nb\rc", "", "a\x0bb\x0cc\x1cd\x85e f", "\n\n", "x"):
        assert values(spark, T.split_lines(F.col("t")), t=text) == text.splitlines()


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10**6))
def test_j1_longest_prefix_against_a_model(spark, seed):
    draw = random.Random(seed)
    name = lambda: "/".join(draw.choice("abc") for _ in range(draw.randrange(1, 5)))
    files, prefixes = {name() for _ in range(30)}, {f"u{i}": name() for i in range(6)} | {"root": ""}
    got = {r.path: r.unit_id for r in O.owner(paths(spark, *files), units(spark, **prefixes)).collect()}
    for f in files:
        fits = [(len(p), [-ord(c) for c in k], k) for k, p in prefixes.items() if p == "" or f == p or f.startswith(p + "/")]
        longest = max(n for n, *_ in fits)
        assert got[f] == min(k for n, _, k in fits if n == longest)


def test_j4_h3_counts_overlap_and_ownership_does_not(spark):
    found = units(spark, root="", src="src", pol="src/policies")
    files = paths(spark, "README.md", "src/cli.py", "src/policies/rule.py")
    assert {r.id: r.n for r in O.artifact_counts(files, found).collect()} == {"root": 3, "src": 2, "pol": 1}
    assert O.owner(files, found).where("unit_id is null").count() == 0


def test_h4_ties(spark):
    two = spark.createDataFrame([("b", "x", 0), ("a", "x", 1)], "id string, prefix string, ord int")
    assert O.owner(paths(spark, "x/f"), two).first()["unit_id"] == "a"
    assert O.owner(paths(spark, "x/f"), two, -F.col("ord")).first()["unit_id"] == "b"
    assert O.deepest_prefix(paths(spark, "x/f"), two).first()["id"] == "b"


def test_w4_nearest(spark):
    got = O.nearest(paths(spark, "src/bar.py", "zz"), units(spark, ctl=".facts", foo="src/foo", bar="src", q="q/r")).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.path, []).append(r.unit_id)
    assert by == {"src/bar.py": ["bar", "foo"], "zz": ["bar", "ctl", "foo"]}


def test_a1_a2_j15_duplicates_and_exact_claims(spark):
    rows = [("src/a.py", "f", "function", 1), ("src/b.py", "f", "function", 9), ("src/b.py", "_g", "class", 2), ("src/a.py", "_g", "function", 3), ("src/a.py", "h", "function", 4), ("src/a.py", "h", "function", 5)]
    symbols = spark.createDataFrame(rows, "module string, name string, kind string, line int")
    assert [r.name for r in DU.duplicate_names(symbols, True).collect()] == ["f"]
    both = DU.duplicate_names(symbols)
    claim = lambda *m: spark.createDataFrame([("f", list(m))], "name string, modules array<string>")
    assert {r.name for r in DU.unclaimed(both, claim("src/b.py", "src/a.py")).collect()} == {"_g"}
    assert {r.name for r in DU.unclaimed(both, claim("src/a.py", "src/c.py")).collect()} == {"f", "_g"}


def test_j7_h15_unique_references(spark):
    defs = spark.createDataFrame([("A.S", "S", 1), ("B.S", "S", 2), ("C.T", "T", 3), ("C.T", "T", 4), ("D.U", "U", 5)], "qualified string, simple string, line int")
    refs = spark.createDataFrame([("x.S", "S"), ("B.S", "S"), ("C.T", "T"), ("y.U", "U")], "qualified string, simple string")
    assert {r.qualified: (r.line, r.by) for r in R.resolve_references(refs, defs).collect()} == {"x.S": (None, None), "B.S": (2, "qualified"), "C.T": (None, None), "y.U": (5, "simple")}


def test_c9_leaves_only(spark):
    bad = spark.createDataFrame([("m", "p", "u"), ("m", "p.s", "u"), ("m", "p.t", "u"), ("n", "p", "u"), ("m", "ps", "u")], "module string, target string, forbidden string")
    assert {(r.module, r.target) for r in R.leaves_only(bad).collect()} == {("m", "p.s"), ("m", "p.t"), ("n", "p"), ("m", "ps")}


def test_d1_d5_diff_with_nulls(spark):
    one = spark.createDataFrame([("a", None), ("b", "x"), ("b", "x")], "k string, t string")
    two = spark.createDataFrame([("a", "y"), ("b", "x")], "k string, t string")
    assert {(r.k, r.t, r.op) for r in D.diff(one, two, ["k", "t"]).collect()} == {("a", None, "removed"), ("a", "y", "added"), ("b", "x", "same")}


def test_d8_manual_obligations_win(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "k string, owner string, ord int")
    got = D.merged_obligations(make(("a", "one", 0), ("a", "two", 1)), make(("a", "x", 9), ("b", "y", 0)), ["k"]).collect()
    assert {(r.k, r.owner, r.origin) for r in got} == {("a", "two", "manual"), ("b", "y", "derived")}


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 10**6))
def test_g1_a14_h19_reach_against_a_model(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(12), draw.randrange(12)) for _ in range(22)]
    got = {r.node: r.distance for r in G.reverse_reach(spark.createDataFrame(edges, "caller long, callee long"), spark.createDataFrame([(0,)], "node long")).collect()}
    want, frontier = {0: 0}, {0}
    while frontier:
        frontier = {a for a, b in edges if b in frontier and a not in want}
        want |= {a: max(want.values()) + 1 for a in frontier}
    assert got == want


def test_g3_layers_and_cycles(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    needs = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b"), ("d", "c")], "id string, on string")
    done, rest = G.layers(nodes, needs)
    assert {r.id: r.layer for r in done.collect()} == {"a": 0, "b": 1, "c": 1, "d": 2} and rest.isEmpty()
    _, rest = G.layers(nodes, needs.union(spark.createDataFrame([("b", "d")], "id string, on string")))
    assert {r.id for r in rest.collect()} == {"b", "d"}


def test_j11_h18_tiers(spark):
    claims = spark.createDataFrame([("f",), ("z",)], "node string")
    facts = spark.createDataFrame([("f",)], "node string")
    assert {r.node: r.tier for r in C.tiers(claims, facts, ["node"], False).collect()} == {"f": "confirmed", "z": "unconfirmed"}
    assert {r.tier for r in C.tiers(claims, facts, ["node"], True).collect()} == {"confirmed", "contradicted"}


def test_j12_d11_values_and_pages(spark):
    claims = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "subject string, value string")
    facts = spark.createDataFrame([("a", "1"), ("b", "2")], "subject string, value string")
    assert {r.subject: r.verdict for r in C.verify_values(claims, facts).collect()} == {"a": "ok", "b": "mismatch", "c": "unknown"}
    page = lambda *rows: spark.createDataFrame(list(rows), "path string, content string")
    assert {(r.path, r.state) for r in C.page_drift(page(("a", "x"), ("b", "x"), ("c", "x")), page(("a", "x"), ("b", "y"), ("d", "x"))).collect()} == {("b", "changed"), ("c", "missing"), ("d", "orphan")}


def test_p2_p3_selectors(spark):
    assert S.parse_selectors(["k=v", "k=a=b", "k="]) == [("k", "v"), ("k", "a=b"), ("k", "")]
    for wrong in ("=v", "kv"):
        with pytest.raises(S.QueryError):
            S.parse_selectors([wrong])
    df = spark.createDataFrame([(True, None), (False, "x")], "b boolean, s string")
    count = lambda *s: S.select_rows(df, S.parse_selectors(list(s))).count()
    assert (count("b=true"), count("s=null"), count("b=false", "s=x"), count("other=1"), count()) == (1, 1, 1, 0, 2)


def test_h13_c20_only_text_dates_expire(spark):
    document = declared.load("waivers:\n- {id: a, reason: r, owner: o, expires: '2020-01-01'}\n- {id: b, reason: r, owner: o, expires: 2020-01-01}\n- {id: c}\n")
    rows, wrong = declared.waivers(spark, document)
    assert [r.id for r in S.expired(rows, "2021-01-01").collect()] == ["a"] and len(wrong) == 1


def test_s23_strict_yaml(spark):
    with pytest.raises(declared.DeclarationError):
        declared.load("a: 1\na: 2\n")
    assert declared.load("") == {}
    plan = "version: 1\nkind: program_plan\nwork_items:\n- {id: 'program:P1:a', phase: p, title: t, status: planned}\n- {id: 'program:P1:b', phase: p, title: t, status: done, depends_on: ['%s']}\n"
    assert declared.program(spark, declared.load(plan % "program:P1:a")).count() == 2
    with pytest.raises(declared.DeclarationError):
        declared.program(spark, declared.load(plan % "zz"))


SOURCE = '''import os, pkg.b
from pkg.b import g, K as L
from . import b as bb
from .b import *
from ...x import y
def f(x, h):
    g(); h(); bb.g(); L(); os.getcwd(); f(1, 2)
    def inner():
        late()
    if x:
        def deep():
            bb.K()
    pkg = 1
    pkg.b()
async def late(): pass
class C:
    def m(self):
        self.n(); self.zz()
    def n(self): bb.g()
'''


def events(spark):
    files = [("pkg/__init__.py", ""), ("pkg/a.py", SOURCE), ("pkg/b.py", "def g(): pass\nclass K: pass\ndef g(): pass\n"), ("loose.py", "import pkg.a\ndef q(): pass\n"), ("bad.py", "def ("), ("gone.py", None)]
    return L.events(spark.createDataFrame(files, "path string, content string"), L.chosen(None))


def test_s8_s27_symbols_imports_and_skipped(spark):
    e = events(spark).cache()
    assert [tuple(r) for r in K.symbols(e).where("module = 'pkg/a.py'").orderBy("line").collect()] == [("pkg/a.py", "f", "function", 6), ("pkg/a.py", "late", "function", 15), ("pkg/a.py", "C", "class", 16)]
    assert {tuple(r) for r in K.imports(e).collect()} == {("loose.py", "pkg.a", "pkg/a.py", 1), ("pkg/a.py", "os", None, 1), ("pkg/a.py", "pkg.b", "pkg/b.py", 1)}
    assert {r.entry for r in K.skipped(e, "symbols").collect()} == {"bad.py", "gone.py"}


def test_g9_j6_h9_h12_calls(spark):
    got = {(r.caller_class, r.caller_symbol, r.callee_path, r.callee_class, r.callee_symbol, r.callee_line, r.resolution) for r in K.calls(events(spark)).collect()}
    assert got == {
        ("", "f", "pkg/a.py", "", "f", 6, "direct"),
        ("", "f", "pkg/a.py", "", "late", 15, "direct"),
        ("", "f", "pkg/b.py", "", "K", 2, "imported_symbol"),
        ("", "f", "pkg/b.py", "", "g", 1, "imported_symbol"),
        ("C", "m", "pkg/a.py", "C", "n", 19, "self_method"),
        ("C", "n", "pkg/b.py", "", "g", 1, "module_attribute"),
    }


def test_g5_h1_package_names(spark):
    got = {r.path: (r.dotted, r.in_package) for r in K.module_names(paths(spark, "a/__init__.py", "a/b/__init__.py", "a/b/c.py", "a/x/y.py", "z.py")).collect()}
    assert got == {"a/__init__.py": ("a", True), "a/b/__init__.py": ("a.b", True), "a/b/c.py": ("a.b.c", True), "a/x/y.py": ("y", False), "z.py": ("z", False)}


MARKDOWN = """# T
See [a](../src/a.py "title") and ![no](img.png) and [web](https://x/y.md) and [f](b.md#part).
```
[fenced](c.md)
```
Code `src/a.py` and `x/none.md` and `plain` and [up](../../out.md).
"""


def test_s9_t1_t2_t3_doc_claims(spark):
    pages = spark.createDataFrame([("docs/p.md", MARKDOWN)], "path string, content string")
    disk = spark.createDataFrame([("src/a.py", False), ("docs/b.md", False), ("docs", True)], "path string, is_dir boolean")
    got = {tuple(r) for r in TC.doc_claims(pages, disk).collect()}
    assert got == {
        ("docs/p.md", 2, "src/a.py", "", "link", True),
        ("docs/p.md", 2, "docs/b.md", "part", "link", True),
        ("docs/p.md", 6, "src/a.py", "", "code", True),
        ("docs/p.md", 6, "x/none.md", "", "code", False),
    }


def test_s10_t5_html_claims(spark):
    page = '<p><code>src/a.py</code></p>\n<pre><code>src/b.py</code></pre>\n<a href="b.html#x">l</a><pre><a href="src/open.py">'
    pages = spark.createDataFrame([("d/i.html", page), ("e/i.html", page)], "path string, content string")
    got = {(r.source, r.line, r.path, r.kind) for r in TC.html_claims(pages, paths(spark, "src/a.py"), ["d/*"]).collect()}
    assert got == {("d/i.html", 1, "src/a.py", "code"), ("d/i.html", 3, "d/b.html", "link"), ("d/i.html", 3, "d/src/open.py", "link")}


def test_s11_w3_wiki_sections(spark):
    page = "# X\n## Canonical Sources\n- `src/a.py` and [no](b.md)\n## Concepts\n[c](c.md) `src/z.py`\nEvidence:\n- `src/*.py` `read/write`\n## Other\n`src/q.py`\n"
    pages = spark.createDataFrame([("w/x.md", page), ("o/x.md", page)], "path string, content string")
    disk = spark.createDataFrame([("src/a.py", False)], "path string, is_dir boolean")
    got = {(r.line, r.concept, r.kind, r.path, r.path_kind, r.exists) for r in TC.wiki_claims(pages, disk, "w").collect()}
    assert got == {(3, "x", "canonical_source", "src/a.py", "literal", True), (5, "x", "concept_page", "w/c.md", "literal", False), (7, "x", "evidence", "src/*.py", "glob", True)}


def test_s12_s13_s14_t7_claims_fences(spark):
    page = "```atlas:claims\ndefines: a -> b -> ./x.py::::f\ncalls: x.py::::f -> y.py::C::m\ncontains: x.py\nnonsense\ncalls: ../x -> y\nunit: u -> src/u\n```\n```py\ndefines: q -> z.py\n```\n"
    pages = spark.createDataFrame([("c.md", page), ("d.md", "x")], "path string, content string")
    claims, wrong = TC.structural_claims(pages)
    assert {(r.line, r.kind, r.subject, r.object, r.concept) for r in claims.collect()} == {(2, "defines", "x.py::::f", "", "a -> b"), (3, "calls", "x.py::::f", "y.py::C::m", ""), (4, "contains", "x.py", "", "")}
    assert {r.line for r in wrong.collect()} == {5, 6, 7}
    made, blocks = TC.generated_claims(pages)
    assert [tuple(r)[2:] for r in made.collect()] == [("unit", "u", "src/u")] and {(r.source, r.has_block) for r in blocks.collect()} == {("c.md", True), ("d.md", False)}


def test_c16_couplings(spark):
    delta = spark.createDataFrame([("symbol_added", "pkg/policies/x.py", "check_new", None)], "family string, scope string, name string, call_key string")
    rule = {"when_fact": {"kind": "symbol_added", "scope": "./pkg/policies/", "name": "check_*"}, "requires": ["./pkg/app.py"]}
    none = spark.createDataFrame([], "source string, line int, detail string")

    def told(entries, changed):
        rules, wrong = B.manual_rules(spark, entries)
        return [r.check_id for r in PO.fact_coupling(delta, rules, changed, wrong, none).collect()]

    assert told([rule], paths(spark, "other")) == ["fact-coupling"]
    assert told([rule], paths(spark, "pkg/app.py")) == []
    assert told([{"id": "bad"}], paths(spark)) == ["fact-coupling"]


def test_w6_r3_budget_passes_over_what_is_too_long():
    assert budget(["a", "b" * 3000, "c"]) == [0, 2] and len(budget(["x"] * 20)) == 10


def test_r3_injector_streams_and_resurfaces(spark, tmp_path):
    from factloom.streaming.injector import inject

    rows = lambda n: spark.createDataFrame([("s", f"p{i:02}", "k", "m") for i in range(n)], "session string, path string, kind string, message string")
    rows(14).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows(1).schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = inject(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        query.processAllAvailable()
        assert spark.table("told").count() == 10 and spark.table("told").first()["more"] == 4
        rows(14).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        query.processAllAvailable()
        assert spark.table("told").count() == 14 and spark.table("told").select("fingerprint").distinct().count() == 14
    finally:
        query.stop()


@pytest.fixture
def golden(tmp_path):
    """A small repository in which every policy holds."""
    files = {
        ".facts/config.yml": "wiki: {product_roots: [src]}\nconstraint_sources: {authoritative: [README.md]}\n",
        ".facts/structure.yml": "version: 1\nkind: structure_map\nunits:\n  all: {path: '.', kind: k, owner: o, purpose: p, canonical_placement: c}\n  src: {path: src, kind: k, owner: o, purpose: p, canonical_placement: c}\n",
        "README.md": "See [a](src/pkg/a.py).\n",
        "src/pkg/__init__.py": "",
        "src/pkg/a.py": "from src.pkg.b import g\ndef f():\n    g()\n",
        "src/pkg/b.py": "def g(): pass\n",
        "src/__init__.py": "",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "x")
    return tmp_path


def test_golden_repository_and_one_change(spark, golden):
    assert Catalog(spark, str(golden)).check().collect() == []
    (golden / "src/pkg/c.py").write_text("def g(): pass\n")
    (golden / "README.md").write_text("See [a](src/gone.py).\n")
    found = Catalog(spark, str(golden))
    assert [r.check_id for r in found.check().collect()] == ["stale-claim", "duplicate-symbol", "duplicate-implementation"]
    assert {tuple(r)[:3] for r in found.delta().collect()} == {("symbol_added", "src/pkg/c.py", "g")}


def test_catalog_answers(spark, golden):
    c = Catalog(spark, str(golden))
    assert [(r.node, r.distance) for r in c.impact("g").collect()] == [("src/pkg/a.py::::f", 1)]
    assert c.impact("nothing").count() == 0
    assert c.query("symbols", ["name=g"]).count() == 1
    with pytest.raises(S.QueryError):
        c.query("nope", [])
    assert {r.kind: r.n for r in c.schema().collect()}["symbols"] == 2
    assert c.inventory() == Catalog(spark, str(golden)).inventory()
    assert {r.node: r.kind for r in c.tree().collect()} == {"src": "package", "src/pkg": "package", "src/pkg/a.py": "module", "src/pkg/b.py": "module", "src/pkg/a.py::::f": "function", "src/pkg/b.py::::g": "function"}
    assert c.pack()["dependencies"].count() >= 1 and c.mermaid().startswith("graph LR")
    c.register()
    assert spark.sql("select count(*) from symbols").first()[0] == 2


@pytest.mark.parametrize("name", ["impact_reach", "impact_via", "impact_by_path"])
def test_impact_has_no_depth_limit(spark, monkeypatch, name):
    from factloom import queries

    chain = [(1, 30), (2, 30), (100, 30), *((i + 1, i) for i in range(100, 114))]
    monkeypatch.setattr(queries.E, "calls", lambda s, d: s.createDataFrame(chain, "caller long, callee long"))
    got = {r.node: r.distance for r in queries.QUERIES[name](spark, "").collect()}
    assert all(got[100 + i] == i + 1 for i in range(15))


def test_j1_j4_glob_units(spark):
    literal = units(spark, src="src", deep="src/pkg/longer")
    globs = [("tests", "*/test_*.py"), ("pkg", "src/pkg/*.py"), ("late", "src/pkg/*")]
    files = paths(spark, "src/a.py", "src/pkg/b.py", "src/pkg/longer/c.py", "x/test_a.py", "src/test_b.py", "y")
    got = {r.path: r.unit_id for r in O.owner_with_globs(files, literal, globs).collect()}
    assert got == {"src/a.py": "src", "src/pkg/b.py": "pkg", "src/pkg/longer/c.py": "deep", "x/test_a.py": "tests", "src/test_b.py": "src", "y": None}
    assert {r.id: r.n for r in O.glob_counts(files, globs).collect()} == {"tests": 2, "pkg": 2, "late": 2}
    assert O.owner_with_globs(files, literal, []).count() == 6


def test_c16_scopes_end_at_a_slash_and_requirements_are_globs(spark):
    delta = spark.createDataFrame([("symbol_added", "pkg/policies/a.py", "check_x", None)], "family string, scope string, name string, call_key string")

    def unmet(scope, changed):
        rules, wrong = B.manual_rules(spark, [{"when_fact": {"kind": "symbol_added", "scope": scope}, "requires": ["docs/*.md"]}])
        assert wrong == []
        return B.unmet(B.fired(rules, delta), paths(spark, changed)).count()

    assert unmet("pkg/pol", "other") == 0
    assert unmet("pkg/policies/", "other") == 1
    assert unmet("pkg/policies/", "docs/a/b.md") == 0


def test_c8_g3_cycles_of_a_plan_are_findings(spark):
    items = spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", [])], "id string, depends_on array<string>")
    assert sorted(r.message.split()[2] for r in PO.plan_cycles(items).collect()) == ["a", "b"]


def test_c19_names_are_compared_as_they_are(spark):
    symbols = spark.createDataFrame([("policies/x.py", "check_one_two", "function")], "module string, name string, kind string")
    declared_ = spark.createDataFrame([("one_two", None), ("later", "planned"), ("gone", None)], "id string, status string")
    assert [r.message for r in PO.policy_registry(symbols, declared_, "policies").collect()] == ["policy gone is not implemented"]


def test_r1_status_tells_of_changed_files_only(spark, golden):
    assert Catalog(spark, str(golden)).status()[0].collect() == []
    (golden / "src/pkg/c.py").write_text("def g(): pass\n")
    rows, state = Catalog(spark, str(golden)).status()
    assert state == "ok"
    assert [tuple(r) for r in rows.collect()] == [("src/pkg/c.py", "duplicate-symbol", "src/pkg/c.py: public symbol 'g' is also defined in src/pkg/b.py")]
    assert Catalog(spark, str(golden)).status(["docs/"])[0].collect() == []
    assert Catalog(spark, str(golden)).status(since="0" * 40)[1] == "stale-baseline"
    (golden / ".facts/structure.yml").write_text("units: 3\n")
    rows, state = Catalog(spark, str(golden)).status()
    assert (rows.collect(), state) == ([], "error")


def test_a11_summary_of_the_inventory(spark, golden):
    rows = {r.topic: (r.n, r.shown) for r in Catalog(spark, str(golden)).summary().collect()}
    assert rows["units"][0] >= 1 and rows["not on disk"] == (0, "") and rows["unowned"] == (0, "")


def test_a11_o9_preview(spark):
    units = spark.createDataFrame([("a", True), ("b", False)], "id string, exists boolean")
    paths = spark.createDataFrame([(f"p{i}",) for i in range(7)], "path string")
    items = spark.createDataFrame([("done",), (None,)], "status string")
    rows = {r.topic: (r.n, r.shown) for r in ST.summary(units, paths, items).collect()}
    assert rows == {"units": (2, ""), "not on disk": (1, "b"), "unowned": (7, "p0, p1, p2, p3, p4, +2 more"), "status done": (1, ""), "status unknown": (1, "")}
    assert ST.totals(spark.createDataFrame([], "severity string")).first() == (0, 0, True)


def test_s21_t16_stored_calls(spark):
    nodes = [(1, "m.C::f", "method", "f", "file:///r/a.py"), (2, "g", "function", "g", "./b.py"), (3, "h", "function", "h", "/other/c.py"), (4, "x", "function", " ", "a.py"), (5, "k", "function", "k", "..")]
    edges = [(1, 2, "calls", "7", None), (1, 2, "calls", "-4", ""), (2, 1, "instantiates", "x", "guess"), (1, 3, "calls", "1", None), (1, 4, "calls", "1", None), (1, 5, "calls", "1", None), (1, 2, "reads", "1", None)]
    found = A.stored_calls(
        spark.createDataFrame(nodes, "id int, qualified_name string, kind string, name string, file_path string"),
        spark.createDataFrame(edges, "source int, target int, kind string, line string, provenance string"),
        spark.createDataFrame([("a.py",), ("b.py",), ("c.py",)], "path string"),
        "/r",
    )
    rows = {(r.caller_path, r.caller_class, r.caller_symbol, r.callee_path, r.callee_class, r.callee_symbol, r.resolution, r.line) for r in found.collect()}
    assert rows == {("a.py", "C", "f", "b.py", "", "g", "calls", 0), ("b.py", "", "g", "a.py", "C", "f", "instantiates:guess", 0)}
