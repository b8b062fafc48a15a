"""Languages by extension, contents read by tasks, presets, calibration, and bounded forms of earlier operators."""

from __future__ import annotations

import json
import random
import subprocess

import pytest
from factloom import cli
from factloom.functions import paths as P
from factloom.operators import ownership as O
from factloom.operators import presets as R
from factloom.operators.select import QueryError
from factloom.plans.catalog import Catalog
from factloom.sources import declared
from factloom.sources import languages as L
from factloom.sources import repository as repo
from factloom.sources import text_claims as TC
from pyspark.sql import functions as F

PROTO = 'syntax = "proto3";\n// message Not {}\n/* message\n Neither { */\nimport public "shared/base.proto";\nimport \'gone.proto\';\nmessage Order {\n  message Inner { string s = 1; }\n  string note = 2 [default = "message Fake {"];\n}\nenum Kind { A = 0; }\nservice Desk { rpc Get (Order) returns (Order) {} }\n'


def run(root, *args):
    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(root), *args], check=True, capture_output=True)


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


@pytest.fixture
def mixed(tmp_path):
    write(tmp_path, {
        ".facts/config.yml": "languages: [python, proto]\nwiki: {product_roots: [.]}\n",
        "api/order.proto": PROTO,
        "lib/shared/base.proto": "message Base {}\n",
        "other/deep/shared/base.proto": "message Base {}\n",
        "broken.proto": "message Open {",
        "pkg/__init__.py": "",
        "pkg/a.py": "import pkg.b\ndef f(): pass\n",
        "pkg/b.py": "class B: pass\n",
    })
    run(tmp_path, "init", "-q")
    run(tmp_path, "add", "-A")
    run(tmp_path, "commit", "-qm", "x")
    return tmp_path


def test_s25_d4_one_pass_deals_files_to_languages(spark, mixed):
    c = Catalog(spark, str(mixed))
    assert {tuple(r) for r in c.table("symbols").where("endswith(module, '.proto')").collect()} == {
        ("api/order.proto", "Order", "message", 7), ("api/order.proto", "Kind", "enum", 11), ("api/order.proto", "Desk", "service", 12),
        ("lib/shared/base.proto", "Base", "message", 1), ("other/deep/shared/base.proto", "Base", "message", 1)}
    assert {r.name for r in c.table("symbols").where("endswith(module, '.py')").collect()} == {"f", "B"}
    assert {tuple(r) for r in c.table("imports").collect()} == {
        ("api/order.proto", "shared/base.proto", "lib/shared/base.proto", 5), ("api/order.proto", "gone.proto", None, 6), ("pkg/a.py", "pkg.b", "pkg/b.py", 1)}
    assert [tuple(r) for r in c.table("skipped").collect()] == [("symbols", "broken.proto")]
    assert c.delta().isEmpty()  # the same facts from the commit and from the tree
    write(mixed, {"api/order.proto": PROTO + "message New {}\n"})
    assert [tuple(r)[:4] for r in Catalog(spark, str(mixed)).delta().collect()] == [("symbol_added", "api/order.proto", "New", "message")]


def test_s25_python_alone_unless_named(spark, mixed):
    write(mixed, {".facts/config.yml": "wiki: {product_roots: [.]}\n"})
    c = Catalog(spark, str(mixed))
    assert {r.module for r in c.table("symbols").collect()} == {"pkg/a.py", "pkg/b.py"} and c.table("skipped").isEmpty()
    for bad in ("languages: [cobol]\n", "languages: python\n"):
        write(mixed, {".facts/config.yml": bad})
        found = Catalog(spark, str(mixed)).check().collect()
        assert [r.check_id for r in found] == ["config-load-error"]


@pytest.mark.parametrize("text", ["message A { ", "}", "/* no end", 'import "no end;\n', "message A {}}"])
def test_s25_broken_schemas_are_failed_and_give_nothing_else(text):
    assert list(L.proto_events(text)) == [L.FAILED]


def test_s25_null_content_is_unreadable_and_no_files_are_empty(spark):
    every = L.chosen(["python", "proto"])
    files = spark.createDataFrame([("a.proto", None), ("b.proto", ""), ("c.txt", "message A {}")], "path string, content string")
    got = L.events(files, every)
    assert {(r.path, r.kind) for r in got.collect()} == {("a.proto", "unreadable"), ("b.proto", "parsed")}
    none = L.events(files.limit(0), every)
    assert L.symbols(none, every).isEmpty() and L.imports(none, every).isEmpty() and L.calls(none, every).isEmpty()
    assert L.calls(got, L.chosen(["proto"])).isEmpty()


def test_s18_blobs_are_read_by_tasks_all_or_nothing(spark, mixed, monkeypatch):
    monkeypatch.setattr(repo, "SHARE", 2)
    got = {r.path: r.content for r in repo.contents_at(spark, str(mixed), "HEAD", (".py", ".proto")).collect()}
    assert got == {p: (mixed / p).read_text() for p in got} and len(got) == 7
    assert repo.contents_at(spark, str(mixed), "nothing") is None
    sha = subprocess.run(["git", "-C", str(mixed), "rev-parse", "HEAD:pkg/a.py"], check=True, capture_output=True, text=True).stdout.strip()
    (mixed / ".git/objects" / sha[:2] / sha[2:]).unlink()
    assert repo.contents_at(spark, str(mixed)) is None


def test_s18_a_module_of_another_repository_is_no_file(spark, mixed):
    head = subprocess.run(["git", "-C", str(mixed), "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
    run(mixed, "update-index", "--add", "--cacheinfo", f"160000,{head},vendor.py")
    run(mixed, "commit", "-qm", "module")
    assert repo.contents_at(spark, str(mixed)).count() == 3


def test_contents_of_an_unseen_folder_are_an_error(spark, tmp_path):
    listed = spark.createDataFrame([("a.py",)], "path string")
    with pytest.raises(Exception, match="all executors share"):
        repo.contents(spark, str(tmp_path / "gone"), listed).collect()
    assert [r.content for r in repo.contents(spark, str(tmp_path), listed).collect()] == [None]


def test_s3_a_walk_leaves_out_what_is_derived_or_of_this_machine(tmp_path):
    write(tmp_path, {"a.py": "", "wiki/b.md": "", "src/wiki/c.md": "", ".facts/cache/d.md": "", ".facts/.status-seen.json": "", ".facts/config.yml": "", "x/__pycache__/e.py": "", "f.pyc": ""})
    assert sorted(repo.walked(str(tmp_path), ("wiki",))) == [".facts/config.yml", "a.py", "src/wiki/c.md"]


def test_s11_globs_of_pages_meet_the_disk_in_one_join(spark):
    page = "# C\n\n## Canonical sources\n" + "".join(f"- `{p}`\n" for p in ("src/*.py", "src/**/*.py", "docs/*.md", "src/**", "*/a.py"))
    disk = spark.createDataFrame([("src/a.py", False), ("src/x/b.md", False), ("docs/y/c.md", False), ("docs", True)], "path string, is_dir boolean")
    claims = TC.wiki_claims(spark.createDataFrame([("w/p.md", page)], "path string, content string"), disk, "w")
    assert {r.path: r.exists for r in claims.collect()} == {"src/*.py": True, "src/**/*.py": True, "docs/*.md": False, "src/**": True, "*/a.py": True}


def test_h7_patterns_of_a_column_are_those_of_a_literal(spark):
    cases = [(p, n) for p in ("a/*", "a/**", "**/x.py", "a/**/x.py", "?.py", "a.b*", "[!a]*", "[ab]/c") for n in ("a/b", "a/b/c", "x.py", "q/x.py", "a/x.py", "a/q/r/x.py", "b.py", "a.bc", "axb", "a/c", "ba")]
    df = spark.createDataFrame(cases, "p string, n string")
    for crosses in (True, False):
        got = {(r.p, r.n): r.hit for r in df.withColumn("e", P.glob_pattern(F.col("p"), crosses)).select("p", "n", F.expr("n rlike e").alias("hit")).collect()}
        literal = df.select("p", "n", *[P.matches(F.col("n"), p, crosses).alias(f"m{i}") for i, p in enumerate(dict.fromkeys(p for p, _ in cases))]).collect()
        at = {p: f"m{i}" for i, p in enumerate(dict.fromkeys(p for p, _ in cases))}
        assert got == {(r.p, r.n): r[at[r.p]] for r in literal}


def test_w4_nearest_units_are_those_of_all_pairs(spark):
    r = random.Random(5)
    folder = lambda: "/".join(r.choice("ab") for _ in range(r.randint(1, 4)))
    units = {f"u{i:02d}": folder() for i in range(40)}
    paths = sorted({folder() + "/f" for _ in range(40)} | {"zz"})

    def shared(a, b):
        n = 0
        for x, y in zip(a.split("/"), b.split("/"), strict=False):
            if x != y:
                break
            n += 1
        return n

    want = set()
    for p in paths:
        ranked = sorted((-shared(p, u), i) for i, u in units.items())
        some = [x for x in ranked if x[0]] or ranked
        want |= {(p, k + 1, i) for k, (_, i) in enumerate(some[:3])}
    got = O.nearest(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(list(units.items()), "id string, prefix string"))
    assert {tuple(x) for x in got.collect()} == want


def preset(**changes):
    role = lambda i, *no: {"id": i, "purpose": "p", "canonical_placement": "c", "must_not_depend_on": list(no)}
    return {"name": "onion", "description": "d", "top_level": "layers", "enforceable_for": ["python"], "roles": [role("core", "edge"), role("edge")], **changes}


def test_p10_p11_j19_presets(spark, tmp_path):
    shared, own = tmp_path / "shared", tmp_path / "r"
    text = lambda **c: json.dumps(preset(**c))
    write(shared, {"onion.yml": text(description="shared"), "plain.yml": text(name="plain", enforceable_for=["go"])})
    write(own, {".facts/presets/onion.yml": text(description="own"), ".facts/presets/plain.yml": "[", "setup.py": "", "sub/go.mod": ""})
    c = Catalog(spark, str(own))
    found = c.presets(str(shared))
    assert {r.name: r.place for r in R.listed(found).collect()} == {"onion": 0, "plain": 1}
    assert {(r.name, r.place): r.advisory for r in found.where("wrong is null").collect()} == {("onion", 0): False, ("onion", 1): False, ("plain", 1): True}
    units, rules = c.rendered("onion", "shop", str(shared))
    assert [(r.id, r.path, r.status) for r in units.orderBy("ord").collect()] == [("shop-core", "src/shop/core", "planned"), ("shop-edge", "src/shop/edge", "planned")]
    assert [tuple(r) for r in rules.collect()] == [("shop-core", "shop-edge")]
    with pytest.raises(QueryError, match="no mapping"):  # an unsound own one does not let the shared one through
        c.rendered("plain", shared=str(shared))
    with pytest.raises(QueryError, match="unknown preset 'x'; there are onion, plain"):
        c.rendered("x", shared=str(shared))


@pytest.mark.parametrize(("changes", "said"), [
    ({"name": "other"}, "another name"), ({"description": " "}, "lacks description"), ({"top_level": "x"}, "unknown top level"),
    ({"enforceable_for": []}, "enforceable for nothing"), ({"enforceable_for": "python"}, "enforceable for nothing"), ({"top_level": "contexts"}, "no roles"),
    ({"roles": [{"id": "a", "purpose": "p"}]}, "lacks a text"),
    ({"roles": [{"id": "a", "purpose": "p", "canonical_placement": "c"}] * 2}, "repeats"),
    ({"roles": [{"id": "a", "purpose": "p", "canonical_placement": "c", "must_not_depend_on": "b"}]}, "no list"),
    ({"roles": [{"id": "a", "purpose": "p", "canonical_placement": "c", "must_not_depend_on": ["a"]}]}, "itself"),
    ({"roles": [{"id": "a", "purpose": "p", "canonical_placement": "c", "must_not_depend_on": ["b"]}]}, "unknown one"),
])
def test_p10_unsound_presets_say_why(spark, changes, said):
    texts = spark.createDataFrame([(0, "onion", json.dumps(preset(**changes)))], "place int, name string, body string")
    assert said in R.presets(texts).first().wrong


def test_p17_calibration_of_an_offline_corpus(spark, mixed):
    write(mixed, {
        ".gitignore": ".facts/cache/\n",
        "pkg/c.py": "from pkg.d import g\ndef h():\n    g()\n",
        "pkg/d.py": "def g(): pass\n",
        ".facts/cache/semantic/x.md": "```atlas:claims\ndefines: a concept -> pkg/d.py::::g\ncalls: pkg/c.py::::h -> pkg/d.py::::g\ncalls: pkg/d.py::::g -> pkg/c.py::::h\ncontains: pkg/gone.py\n```\n",
    })
    c = Catalog(spark, str(mixed))
    got = {(r.kind, r.subject): (r.tier, r.line) for r in c.calibration().collect()}
    assert got, "claims are read"
    assert got["calls", "pkg/c.py::::h"] == ("confirmed", 3) and got["calls", "pkg/d.py::::g"] == ("unconfirmed", 4)
    assert got["defines", "pkg/d.py::::g"] == ("confirmed", 2) and got["contains", "pkg/gone.py"] == ("unconfirmed", 5)
    assert c.files.where("path like '%semantic%'").isEmpty()


def test_p9_enforcement_of_policies(spark):
    document = {"policies": {"a": {"severity": "error", "status": "planned"}, "b": {"severity": "error"}, "c": {"severity": "warning", "status": "active"}, "d": None}}
    assert {r.id: r.enforcement for r in declared.policy_rows(spark, document).collect()} == {"a": "planned", "b": "gated", "c": "advisory", "d": "advisory"}
    assert declared.policy_rows(spark, {}).isEmpty()


def test_k1_inventory_in_pieces_is_the_whole_document(spark, mixed, capsys):
    c = Catalog(spark, str(mixed))
    blocks = json.loads(c.inventory())
    assert c.inventory() == json.dumps(blocks, indent=2, sort_keys=True)
    assert [(r["module"], r["line"]) for r in blocks["imports"]] == [("api/order.proto", 5), ("api/order.proto", 6), ("pkg/a.py", 1)]
    assert cli.main(["--root", str(mixed), "inventory"]) == 0
    assert json.loads(capsys.readouterr().out) == blocks
