"""Rules about changes, impact with advice, repair targets, edges from JSON, digests and packs."""

from __future__ import annotations

import fnmatch
import json
import random
import subprocess
from difflib import SequenceMatcher

import pytest
from factloom.cli import main
from factloom.functions import paths as P
from factloom.operators import graph as G
from factloom.operators import matching as M
from factloom.operators import obligations as B
from factloom.operators import select as S
from factloom.plans import policies as PO
from factloom.plans.catalog import Catalog
from factloom.sources import advisory as A
from pyspark.sql import functions as F

DELTA = "family string, scope string, name string, detail string, call_key string"
CLAIM = "source string, line int, kind string, subject string, object string, concept string"


def delta_of(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DELTA)


def test_glob_columns_match_as_fnmatch_does(spark):
    draw = random.Random(1)
    pieces = ["a", "b", "/", ".", "*", "?", "[ab]", "[!a]", "[a-c]x", "+", "é", "[", "]", "[!]", "[]a]", "$", "\\", "-", "{2}", "|"]
    texts = ["".join(draw.choice(["a", "b", "c", "x", "/", ".", "+", "é", "[", "]", "!", "$", "\\", "-", "\n", "|"]) for _ in range(draw.randrange(7))) for _ in range(120)]
    patterns = {"".join(draw.choice(pieces) for _ in range(draw.randrange(1, 6))) for _ in range(150)}
    rows = spark.createDataFrame([(p, t) for p in patterns for t in texts], "p string, t string")
    got = {(r.p, r.t) for r in rows.where(F.rlike("t", P.glob_pattern(F.col("p")))).collect()}
    assert got == {(p, t) for p in patterns for t in texts if fnmatch.fnmatchcase(t, p)}


def test_f1_globs_meet_what_holds_their_longest_literal_run(spark):
    draw = random.Random(2)
    pieces = ["a", "b", "/", ".", "*", "*", "?", "[ab]", "[!a]", "é", "[", "]", "[]a]", "\\", "😀", "\x00"]
    texts = {"".join(draw.choice(["a", "b", "/", ".", "é", "[", "]", "\\", "😀", "\x00"]) for _ in range(draw.randrange(8))) for _ in range(300)}
    globs = {"".join(draw.choice(pieces) for _ in range(draw.randrange(1, 7))) for _ in range(300)}
    asked = spark.createDataFrame([(p, k) for p in globs for k in (1, 2)], "glob string, k int")
    there = spark.createDataFrame([(t, k) for i, t in enumerate(sorted(texts)) for k in ((1, 3) if i % 2 else (2,))], "text string, k int")
    odd = {t for i, t in enumerate(sorted(texts)) if i % 2}
    got = [(r.glob, r.k) for r in B.matched(asked, there, ["k"]).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(p, k) for p in globs for k in (1, 2) if any(fnmatch.fnmatchcase(t, p) for t in (odd if k == 1 else texts - odd))}


def test_f1_pairs_of_globs_and_paths_grow_with_the_paths(spark):
    for n in (100, 1000):
        globs = spark.range(n).select(F.explode(F.array(F.concat(F.lit("user/"), "id", F.lit("?")), F.concat(F.lit("*/"), "id", F.lit("[13579]")))).alias("glob"))
        texts = spark.range(10 * n).select(F.concat(F.lit("user/"), "id").alias("text"))
        assert 19 * n <= B.meeting(globs, texts, []).count() <= 20 * n
        assert B.matched(globs, texts, []).count() == 2 * n - 2  # 'user/0?' and '*/0[13579]' match nothing


def rules_of(spark, *rows):
    return spark.createDataFrame([(f"r{i}", kind, scope, name, key, want, "manual", i) for i, (kind, scope, name, key, want) in enumerate(rows)], B.RULES)


def test_c16_rules_fire_as_a_model_says(spark):
    draw = random.Random(2)
    folder = lambda: "/".join(draw.choice("ab") for _ in range(draw.randrange(1, 4)))
    delta = [(draw.choice(B.KINDS), folder(), draw.choice(["f", "g", "fg", "_f"]), None, draw.choice([None, "k1", "k2"])) for _ in range(25)]
    rules = [(draw.choice(B.KINDS), draw.choice(["", folder()]), draw.choice([None, "f", "f*", "[!_]*", "*"]), draw.choice([None, None, None, "k1", "k3"]), draw.choice(["a/b", "a/*", "*b", "gone", "a/?"])) for _ in range(150)]
    changed = ["a/b", "b/b/b", "a/bb"]
    under = lambda p, s: s == "" or p == s or p.startswith(s + "/")
    hit = lambda r: any(d[0] == r[0] and (d[4] == r[3] if r[3] else under(d[1], r[1]) and (r[2] is None or fnmatch.fnmatchcase(d[2], r[2]))) for d in delta)
    met = lambda w: any(c == w or fnmatch.fnmatchcase(c, w) for c in changed)
    table = rules_of(spark, *rules)
    fired = B.fired(table, delta_of(spark, *delta))
    assert {r.id for r in fired.collect()} == {f"r{i}" for i, r in enumerate(rules) if hit(r)}
    paths = spark.createDataFrame([(c,) for c in changed], "path string")
    assert sorted(r.id for r in B.unmet(fired, paths).collect()) == sorted(f"r{i}" for i, r in enumerate(rules) if hit(r) and not met(r[4]))
    assert B.fired(table, delta_of(spark)).count() == 0 and B.fired(table.limit(0), delta_of(spark, *delta)).count() == 0


def test_c16_malformed_entries_are_told(spark):
    good = {"when_fact": {"kind": "symbol_added", "scope": "./a\\b/", "name": "check_*"}, "requires": ["./c.py", "d.py"]}
    bad = [
        "x",
        {"requires": ["c"]},
        {"when_fact": {"kind": "nope", "scope": "a"}, "requires": ["c"]},
        {"when_fact": {"kind": "call_added", "scope": ""}, "requires": ["c"]},
        {"when_fact": {"kind": "call_added", "scope": "a", "name": " "}, "requires": ["c"]},
        {"when_fact": {"kind": "call_added", "scope": "a"}, "requires": []},
        {"when_fact": {"kind": "call_added", "scope": "a"}, "requires": ["c", 3]},
    ]
    rules, wrong = B.manual_rules(spark, [*bad, good])
    assert len(wrong) == len(bad) and [(r.scope, r.name, r.requirement) for r in rules.orderBy("ord").collect()] == [("a/b", "check_*", "c.py"), ("a/b", "check_*", "d.py")]
    assert B.manual_rules(spark, {"a": 1})[1] == ["`fact_couplings` must be a list"] and B.manual_rules(spark, None)[1] == []


def test_d8_derived_rules_and_precedence(spark):
    claims = spark.createDataFrame(
        [("d.md", 3, "defines", "m.py::::f", "", "x"), ("d.md", 4, "defines", "m.py::C::f", "", "x"), ("d.md", 5, "contains", "m.py", "", ""), ("d.md", 6, "contains", "m", "", ""), ("d.md", 7, "calls", "m.py::::f", "n.py::C::g", "")], CLAIM
    )
    derived = B.derived_rules(claims)
    key = "\x00".join(["m.py", "", "f", "n.py", "C", "g"])
    both = lambda family, *rest: {(f"{family}_{op}", *rest) for op in ("added", "removed")}
    assert {(r.kind, r.scope, r.name, r.call_key, r.requirement, r.ord) for r in derived.collect()} == both("symbol", "m.py", "f", None, "d.md", 3) | both("symbol", "m.py", "[!_]*", None, "d.md", 5) | both("call", "m.py", "g", key, "d.md", 7)
    manual, _ = B.manual_rules(spark, [{"when_fact": {"kind": "symbol_added", "scope": "m.py", "name": "f"}, "requires": ["d.md"]}] * 2)
    best = {(r.kind, r.name, r.call_key): (r.origin, r.id) for r in B.effective(manual, derived).collect()}
    assert len(best) == 6 and best["symbol_added", "f", None] == ("manual", "fact_couplings[1]") and best["symbol_removed", "f", None][0] == "live_doc_anchor"
    fired = B.fired(B.effective(manual, derived), delta_of(spark, ("call_removed", "m.py", "g", None, key), ("call_added", "m.py", "g", None, key + "x"), ("symbol_added", "m.py", "_f")))
    assert [(r.kind, r.call_key) for r in fired.collect()] == [("call_removed", key)]


@pytest.mark.parametrize("seed", range(3))
def test_g2_two_distances_against_a_model(spark, seed):
    draw = random.Random(seed)
    edges = [(f"n{draw.randrange(20)}", f"n{draw.randrange(20)}", draw.random() < 0.5) for _ in range(28)]

    def distances(kept):
        seen, step = {"n0": 0}, ["n0"]
        while step:
            step = sorted({a for a, b in kept if b in step and a not in seen})
            seen |= {x: max(seen.values()) + 1 for x in step}
        return seen

    every, proven = distances([e[:2] for e in edges]), distances([e[:2] for e in edges if e[2]])
    table = spark.createDataFrame(edges, "caller string, callee string, proven boolean")
    reach = G.written(G.two_distances(table, spark.createDataFrame([("n0",)], "node string")), "reach")
    assert {r.node: (r.distance, r.proven_distance) for r in reach.collect()} == {k: (v, proven.get(k)) for k, v in every.items()}
    told = table.withColumn("provenance", F.when(F.col("proven"), "deterministic").otherwise("advisory")).withColumn("resolution", F.lit("r"))
    for r in G.affected(reach, told).collect():
        arriving = [(b, p) for a, b, p in edges if a == r.node and b != a and every.get(b) == r.distance - 1]
        assert r.advised_only == (r.node not in proven) and r.n_via == len({b for b, _ in arriving}) and r.provenance == sorted({"deterministic" if p else "advisory" for _, p in arriving})


def test_j17_t17_similar_symbols_equal_all_pairs(spark):
    draw = random.Random(4)
    syllables = ["get", "set", "_", "user", "item", "é", "list", "find", "by", "a", "zz"]
    name = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 6)))
    added = sorted({(f"m{draw.randrange(40)}", name(), draw.choice("fc")) for _ in range(3000)})
    claims = [(i, name(), f"m{draw.randrange(60)}", draw.choice("fc")) for i in range(60)] + [(90, "q" * 300, "none", "f"), (91, "", "none", "x"), (92, None, "m1", "f")]
    want = {}
    for i, old, module, kind in claims:
        if old is not None:
            score, at, new = max((SequenceMatcher(None, old, n).ratio() + (m == module) + 0.25 * (k == kind), m, n) for m, n, k in added)
            if score >= 0.75:
                want[i] = (at, new, score)
    asked = spark.createDataFrame(claims, "id long, name string, module string, kind string")
    table = spark.createDataFrame(added, "module string, name string, kind string").repartition(5)
    for block in (2048, 25):
        assert {r.id: (r.module, r["name"], r.score) for r in M.similar_symbols(asked, table, block).collect()} == want
    assert M.similar_symbols(asked, table.limit(0)).count() == 0 and M.similar_symbols(asked.limit(0), table).count() == 0


def test_j17_few_pairs_are_compared(monkeypatch):
    draw = random.Random(5)
    names = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randrange(4, 14))) for _ in range(10_000)]
    import numpy as np

    lengths, counts = M._counts(names)
    modules, kinds = np.array([f"m{i}" for i in range(len(names))], object), np.array(["f"] * len(names), object)
    calls = []

    class Counted(SequenceMatcher):
        def ratio(self):
            calls.append(1)
            return super().ratio()

    monkeypatch.setattr(M, "SequenceMatcher", Counted)
    for i in range(0, 10_000, 500):
        best = M.best_in((names[i] + "x", "none", "f"), names, modules, kinds, lengths, counts, (0.0, "", ""))
        assert best[0] >= 0.75 + 0.25 - 0.2
    assert len(calls) < 20 * 10_000 / 50


def test_j17_similar_calls_equal_all_pairs(spark):
    draw = random.Random(6)
    call = lambda: tuple(draw.choice(["p", "q", "r"]) if i % 3 == 0 else draw.choice(["", "C"]) if i % 3 == 1 else draw.choice("fgh") for i in range(6))
    added, claims = sorted({call() for _ in range(60)}), [(i, *call()) for i in range(40)] + [(99, "x", "", "f", "y", "", "g")]
    shape = ", ".join(f"{c} string" for c in M.CALL)
    want = {}
    for i, *old in claims:
        scored = [(2 * (c[:3] == tuple(old[:3])) + 2 * (c[3:] == tuple(old[3:])) + (c[0] == old[0] or c[3] == old[3]), c) for c in added]
        if max(scored)[0]:
            want[i] = max(scored)
    got = M.similar_calls(spark.createDataFrame(claims, "id long, " + shape), spark.createDataFrame(added, shape))
    assert {r.id: (r.score, tuple(r[c] for c in M.CALL)) for r in got.collect()} == want


def test_c18_repair_targets(spark):
    stale = spark.createDataFrame(
        [("d.md", 1, "defines", "m.py::::load_config", "", "x"), ("d.md", 2, "contains", "m.py::::other", "", ""), ("d.md", 3, "calls", "m.py::::f", "n.py::::g", ""), ("d.md", 4, "contains", "gone", "", ""), ("d.md", 5, "calls", "m.py::::q", "n.py::::g", ""), ("d.md", 6, "defines", "m.py::C::f", "", "x")],
        CLAIM,
    )
    key = lambda *parts: "\x00".join(parts)
    delta = delta_of(
        spark,
        ("symbol_removed", "m.py", "load_config", "function"),
        ("symbol_added", "m.py", "load_configuration", "function"),
        ("symbol_added", "z.py", "load_config", "class"),
        ("call_removed", "m.py", "g", None, key("m.py", "", "f", "n.py", "", "g")),
        ("call_added", "m.py", "g", None, key("m.py", "", "f2", "n.py", "", "g")),
        ("call_added", "m.py", "k", None, key("m.py", "", "a", "n.py", "", "k")),
    )
    got = {r.line: (r.old, r.new, r.action) for r in PO.repair_targets(stale, delta).collect()}
    assert got == {
        1: ("m.py::::load_config", "m.py::::load_configuration", "retarget-subject-node"),
        2: ("m.py::::other", None, "retarget-subject-node"),
        3: ("m.py::::f -> n.py::::g", "m.py::::f2 -> n.py::::g", "retarget-call-edge"),
        5: ("m.py::::q -> n.py::::g", None, "retarget-call-edge"),
    }


def test_s22_edges_from_untyped_json(spark):
    edge = '{"caller":{"path":"./x.py","name":"f","line":"7"},"callee":{"file":"/r/y.py","method":"g","cls":"C"}}'
    documents = [
        ("a", f'[{edge},{{"caller":{{"path":"x.py","name":"f"}},"callee_path":"y.py","calleeName":"g","callee_class":"C","caller_line":3}},5,{{"caller_path":"/o/x.py"}},{{"caller_path":"x.py","caller_symbol":3,"caller_name":"z"}},{{"callerPath":"x.py","callerSymbol":"q"}}]'),
        ("b", '{"edges":3,"graph":{"edges":[{"caller":{"path":"x.py","name":" f "},"callee":{"path":"y.py","name":"g","line":-2},"resolution":"","type":"t"}]}}'),
        *[(k, f'{{"{k}":[{edge}]}}') for k in A.CONTAINERS],
        ("c", "{nope"),
        ("d", '{"x":[]}'),
        ("e", None),
        ("f", "[]"),
        ("g", f"[{edge}] more"),
        ("h", '{"path":1,"end":1},"x":1'),
        ("i", '{"edges":[{"caller":{"path":"../x.py","name":"f"}},{"caller":{"path":"x.py","name":" "},"callerName":"f"}, null]}'),
    ]
    good, left = A.edges_from_json(spark.createDataFrame(documents, "source string, payload string"), "/r")
    first = ("x.py", "", "f", "y.py", "C", "g", "heuristic", 7)
    assert {tuple(r) for r in good.collect()} == {("a", *first), ("b", "x.py", "", "f", "y.py", "", "g", "heuristic", 0), *[(k, *first) for k in A.CONTAINERS]}
    assert {tuple(r) for r in left.collect()} == {
        ("a", 2, "not-object"), ("a", 3, "caller outside-repo"), ("a", 4, "caller missing-symbol"), ("a", 5, "callee missing-path"), ("c", None, "invalid-json"), ("d", None, "unsupported-schema"), ("e", None, "invalid-json"),
        ("g", None, "invalid-json"), ("h", None, "invalid-json"), ("i", 0, "caller outside-repo"), ("i", 1, "callee missing-path"), ("i", 2, "not-object"),
    }


def test_f2_f3_documents_are_parsed_once(spark):
    callee = '"callee":{"path":"y.py","name":"g"}'
    documents = [("a", '[{"caller":{"path":null,"file":"x.py","name":"f"},%s},{"caller":{"file":"x.py","name":"f"},%s}]' % (callee, callee)), ("b", "[]"), ("c", '{"edges":{},"links":[]}'), ("d", "null"), ("e", "[1")]
    good, left = A.edges_from_json(spark.createDataFrame(documents, "source string, payload string"), "/r")
    assert [tuple(r) for r in good.collect()] == [("a", "x.py", "", "f", "y.py", "", "g", "heuristic", 0)]
    assert {tuple(r) for r in left.collect()} == {("a", 0, "caller missing-path"), ("d", None, "unsupported-schema"), ("e", None, "invalid-json")}
    for df in (good, left):
        assert "parse" not in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a15_digests_do_not_depend_on_partitions(spark):
    rows = spark.range(3000).select((F.col("id") % 1700).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("b"))
    for leaf in (4096, 100, 1):
        one = {S.digest(rows.repartition(n), ["a", "b"], leaf).first()[0] for n in (1, 3, 7)}
        assert len(one) == 1 and one.pop().startswith("sha256:")
    whole = S.digest(rows, ["a", "b"]).first()[0]
    assert S.digest(rows.where("a <> 4"), ["a", "b"]).first()[0] != whole and S.digest(rows.union(rows.limit(1)), ["a", "b"]).first()[0] != whole
    assert S.digest(rows.limit(0), ["a"]).first()[0] == S.digest(rows.where("false"), ["b"]).first()[0]
    assert S.tree_of({"a": "x", "b": None}) is None and S.tree_of({"a": "x", "b": "y"}) == S.tree_of({"b": "y", "a": "x"})


def test_p16_o6_first_of_each_section(spark):
    draw = random.Random(7)
    rows = [(draw.randrange(40), f"t{i}") for i in range(300)]
    table = spark.createDataFrame(rows, "n long, t string")
    sections = [S.section("few", table.limit(3), ["n", "t"], 5), S.section("cut", table, ["n", "t"], 7), S.section("all", table, ["t"], None), S.section("none", table.limit(0), ["t"], 5), S.section("only counted", table, ["t"], 0)]
    every = sections[0]
    for s in sections[1:]:
        every = every.unionByName(s)
    got = S.first_of_each(every).collect()
    cut = sorted((r for r in got if r.section == "cut"), key=lambda r: r["rank"])
    assert [(json.loads(r.row)["n"], json.loads(r.row)["t"]) for r in cut] == sorted(rows)[:7] and {(r.total, r.truncated) for r in cut} == {(300, True)}
    assert [(r.total, r.truncated) for r in got if r.section == "few"] == [(3, False)] * 3
    assert sum(r.section == "all" for r in got) == 300 and not any(r.section in ("none", "only counted") for r in got)


def test_c9_rules_are_of_literal_units(spark):
    unit = lambda i, path, k: (i, path, "k", "o", "p", "c", "active", [], [], [], k)
    from factloom import schemas

    units = spark.createDataFrame([unit("core", "src/core", 0), unit("app", "src/app", 1), unit("globbed", "src/core/*.py", 2)], schemas.SCHEMAS["units"])
    imports = spark.createDataFrame([("src/core/a.py", "src.app.b", "src/app/b.py", 3)], schemas.SCHEMAS["imports"])
    rules = spark.createDataFrame([("core", "app")], schemas.SCHEMAS["rules"])
    assert PO.dependency_direction(imports, units, rules).count() == 1


def test_c3_nested_tasks_adapter_and_missing_root(spark):
    disk = spark.createDataFrame([(p, d) for p, d in [("w", True), ("w/tasks", True), ("w/tasks/a/b", True), ("w/tasks/a/b/task.json", False), ("w/tasks/c", True), ("w/tasks/d/task.json", False), ("w/tasks/d/prd.md", False)]], "path string, is_dir boolean")
    assert [(r.check_id, r.message) for r in PO.task_context(disk, "./w/").collect()] == [("trellis-task-context-missing", "w/tasks/a/b has no prd.md")]
    assert [(r.severity, r.check_id) for r in PO.task_context(disk, "elsewhere").collect()] == [("error", "trellis-tasks-root-missing")]
    assert PO.task_context(disk, "elsewhere", None).count() == 0


def test_c10_each_document_is_told_once_and_canonical_roles_are_required(spark):
    roles = spark.createDataFrame([("a", "gone.md", "supporting", "o", ["x"]), ("b", "there.md", "supporting", "o", ["x"]), ("c", "other.md", "supporting", "o", ["x"])], "role string, path string, authority string, owner string, updates_when array<string>")
    disk = spark.createDataFrame([("there.md", False), ("other.md", False)], "path string, is_dir boolean")
    found = PO.document_set(roles, disk, ["gone.md", "there.md"], [], ["config", "waivers"])
    assert sorted(r.message for r in found.collect()) == sorted(["document a is not there: gone.md", "document b has another authority in the configuration", *[f"canonical document role {r} is not required" for r in ("policy_set", "program_plan", "structure_map")]])


@pytest.fixture
def repository(tmp_path):
    files = {
        ".facts/config.yml": "wiki: {product_roots: [src]}\nconstraint_sources: {authoritative: [README.md]}\n",
        ".facts/structure.yml": "version: 1\nkind: structure_map\nunits:\n  all: {path: '.', kind: k, owner: o, purpose: p, canonical_placement: c}\n  src: {path: src, kind: k, owner: o, purpose: p, canonical_placement: c}\n",
        ".facts/claims.yml": "fact_couplings:\n  - {when_fact: {kind: call_added, scope: src/pkg, name: g}, requires: [docs/calls.md]}\n",
        ".facts/calls.json": '{"edges":[{"caller":{"path":"src/pkg/z.py","name":"z"},"callee":{"path":"src/pkg/a.py","name":"f"}}]}',
        "README.md": "x\n",
        "docs/live.md": "```atlas:claims\ndefines: loading -> src/pkg/b.py::::load_one\ncalls: src/pkg/a.py::::f -> src/pkg/b.py::::g\n```\n",
        "src/__init__.py": "",
        "src/pkg/__init__.py": "",
        "src/pkg/a.py": "from src.pkg.b import g\ndef f():\n    g()\n",
        "src/pkg/b.py": "def g(): pass\ndef load_one(): pass\n",
        ".trellis/tasks/t1/task.json": '{"id": "t1", "status": "open"}',
        ".trellis/tasks/t1/notes.md": "See [gone](nowhere.md).\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "x")
    return tmp_path


def test_calls_reach_deltas_couplings_repairs_and_the_pack(spark, repository):
    clean = Catalog(spark, str(repository))
    assert clean.check().collect() == [] and clean.delta().count() == 0
    (repository / "src/pkg/a.py").write_text("from src.pkg.b import g\ndef f2():\n    g()\n")
    (repository / "src/pkg/b.py").write_text("def g(): pass\ndef load_each(): pass\n")
    now = Catalog(spark, str(repository))
    delta = {tuple(r)[:3] for r in now.delta().collect()}
    assert {("call_added", "src/pkg/a.py", "g"), ("call_removed", "src/pkg/a.py", "g"), ("symbol_removed", "src/pkg/b.py", "load_one")} <= delta and len(delta) == 6
    found = now.check().collect()
    told = [json.loads(r.meta) for r in found if r.check_id == "fact-coupling"]
    assert sorted((m["kind"], m["requires"], m["origin"]) for m in told) == [("call_added", "docs/calls.md", "manual"), ("call_removed", "docs/live.md", "live_doc_anchor"), ("symbol_removed", "docs/live.md", "live_doc_anchor")]
    repairs = {json.loads(r.meta)["new"] for r in found if r.check_id == "code-anchor"}
    assert repairs == {"src/pkg/b.py::::load_each", "src/pkg/a.py::::f2 -> src/pkg/b.py::::g"}
    pack = now.context_pack("t1")
    assert pack["task"]["id"] == "t1" and {r["name"] for r in pack["reuse_candidates"]["rows"]} == {"f2", "g", "load_each"}
    assert [r["new"] for r in pack["repair_targets"]["rows"]] and pack["repair_targets"]["total"] == 2 and [r["id"] for r in pack["affected_units"]["rows"]] == ["src"]
    assert pack["provenance"] == now.provenance() != clean.provenance() and pack["provenance"]["policy_version"] is None
    assert "affected_units" not in now.context_pack("nobody")


def test_g2_impact_marks_what_only_advice_reaches(spark, repository):
    rows = {r.node: r for r in Catalog(spark, str(repository)).impact("g").collect()}
    assert {k: (r.distance, r.proven_distance, r.advised_only, r.provenance) for k, r in rows.items()} == {
        "src/pkg/a.py::::f": (1, 1, False, ["deterministic"]),
        "src/pkg/z.py::::z": (2, None, True, ["advisory"]),
    }


def test_c21_a_broken_configuration_is_the_one_finding(spark, repository, capsys):
    (repository / ".facts/config.yml").write_text("wiki: [\n")
    assert [r.check_id for r in Catalog(spark, str(repository)).check().collect()] == ["config-load-error"]
    assert main(["--root", str(repository), "check"]) == 1 and main(["--root", str(repository), "tree"]) == 2
