"""Fenced blocks, live documents, sessions, budgets and the order of trees."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions.text import numbered
from factloom.operators import budget as BU
from factloom.operators import fences as N
from factloom.operators import graph as G
from factloom.plans import policies as PO
from factloom.plans.catalog import Catalog
from factloom.sources import text_claims as TC
from factloom.streaming.injector import MAX_BYTES, MAX_LINES, budget
from factloom.streaming.session import DAY, OUTPUT, PROVIDER, TURN, sessions


def _plain(text):
    """The nested rule, line by line."""
    state, out = None, []
    for i, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        ticks = len(bare) - len(bare.lstrip("`"))
        info = bare[ticks:].strip()
        if state and ticks >= 3 and ticks >= state[0] and not info:
            out.append((i, "close", *state[1:]))
            state = None
        elif not state and ticks >= 3:
            state = (ticks, "claims" if info == N.CLAIMS else "code", i)
            out.append((i, "open", *state[1:]))
        else:
            out.append((i, "text", *(state[1:] if state else (None, None))))
    return out


@pytest.mark.parametrize("segment", [3, 4096])
def test_t6_blocks_in_segments_are_those_of_a_plain_fold(spark, segment):
    r = random.Random(3)
    texts = [(f"p{k}", "\n".join(r.choice(["x", "", "```", "````", "`````", "```py", "````atlas:claims", " ```atlas:claims ", "``"]) for _ in range(r.choice([1, 5, 40, 90]))) + "\nend") for k in range(40)]
    df = spark.createDataFrame(texts, "path string, content string")
    got = {}
    for row in N.blocks(numbered(df), N.nested(F.col("text")), segment).collect():
        got.setdefault(row.source, []).append((row.line, row.role, row.block, row.since))
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {p: _plain(t) for p, t in texts}


def test_t6_the_three_dialects(spark):
    text = "~~~\n```\n````atlas:claims\na\n```\nb\n````\n"
    df = spark.createDataFrame([("p", text), (None, "```\nx\n"), ("empty", ""), ("none", None)], "path string, content string")
    lines = numbered(df)
    inside = lambda dialect: sorted((str(r.source), r.line) for r in N.blocks(lines, dialect(F.col("text"))).where("role = 'text' and block is not null").collect())
    assert inside(N.toggles) == [("None", 2), ("p", 4)] and inside(N.nested) == [("None", 2), ("p", 3), ("p", 4)]
    assert inside(N.generated) == []  # four backticks begin no block there
    assert N.blocks(lines.limit(0), N.toggles(F.col("text"))).count() == 0


def test_s13_claims_shown_inside_a_longer_fence_are_none(spark):
    page = "````md\n```atlas:claims\ncontains: shown.py\n```\n````\n````atlas:claims\ncontains: x.py\n```\ncontains: y.py\n````\n"
    claims, wrong = TC.structural_claims(spark.createDataFrame([("a.md", page)], "path string, content string"))
    assert {(r.line, r.subject) for r in claims.collect()} == {(7, "x.py"), (9, "y.py")} and [r.line for r in wrong.collect()] == [8]


def test_s14_s15_d12_live_documents_are_read_strictly(spark):
    pages = [
        ("docs/a.md", "```atlas:claims\ncontains: x.py\nnonsense\n"),
        ("docs/b.html", "<pre>contains: no.py</pre>\n<pre data-atlas-claims>\ncontains: y.py\noops\n</pre><pre data-atlas-claims>contains: open.py"),
        ("docs/c.txt", "```atlas:claims\ncontains: z.py\n```\n"),
        (".trellis/workspace/d.md", "```atlas:claims\ncontains: z.py\n```\n"),
        ("other.md", "```atlas:claims\ncontains: z.py\n```\n"),
        ("docs/empty.html", None),
    ]
    df = spark.createDataFrame(pages, "path string, content string")
    claims, wrong = TC.live_claims(df, ["docs/*", "docs/*.md", "docs/*.html", ".trellis/*.md"])
    assert {(r.source, r.line, r.subject) for r in claims.collect()} == {("docs/a.md", 2, "x.py"), ("docs/b.html", 3, "y.py")}
    assert {(r.source, r.line, r.detail) for r in wrong.collect()} == {("docs/a.md", 3, "nonsense"), ("docs/a.md", 3, "unterminated atlas:claims block"), ("docs/b.html", 4, "oops")}
    assert TC.live_documents(df, []).count() == 0


def test_c1_live_document_patterns(spark):
    disk = spark.createDataFrame([("docs/a.md", False), ("docs", True)], "path string, is_dir boolean")
    told = {(r.check_id, r.evidence[0].detail) for r in PO.live_sources(disk, ["docs/*.md", "docs/*.txt", "gone/*.html"]).collect()}
    assert told == {("anchor-live-document-invalid", "docs/*.txt"), ("anchor-live-document-missing", "gone/*.html")}
    assert PO.live_sources(disk, []).count() == 0


def _walk(tree):
    kids = {}
    for node, parent in tree:
        kids.setdefault(parent if parent in dict(tree) else None, []).append(node)
    out, stack = [], [(n, 0) for n in sorted(kids.get(None, []), reverse=True)]
    while stack:
        node, depth = stack.pop()
        out.append((node, len(out) + 1, depth))
        stack += [(n, depth + 1) for n in sorted(kids.get(node, []), reverse=True)]
    return sorted(out)


def test_g7_order_of_trees_is_that_of_a_plain_walk(spark):
    r = random.Random(5)
    names = [f"n{i:03}" for i in range(150)]
    bushy = [(n, r.choice(names[:i]) if i and r.random() > 0.05 else None) for i, n in enumerate(names)]
    deep = [(n, names[i - 1] if i else "absent") for i, n in enumerate(names)]
    circle = [("a", None), ("b", "a"), ("x", "y"), ("y", "x"), ("z", "z"), ("below", "x")]
    for tree in (bushy, deep, circle, [("a", None)]):
        got = G.preorder(spark.createDataFrame(tree, "node string, parent string"))
        assert sorted(map(tuple, got.collect())) == _walk(tree)
    assert G.preorder(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_w6_budget_fold_is_the_plain_budget(spark):
    r = random.Random(7)
    rows = [(g, i, r.choice([0, 1, 3, 40, 400, 900, 3000])) for g in ("hot", None, "small") for i in range(400 if g == "hot" else 12)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    for max_rows, max_size in ((10, 2000), (3, 50), (10, 0)):
        want = []
        for g in ("hot", None, "small"):
            own, used, kept = sorted(x for x in rows if x[0] == g), 0, []
            for x in own:
                if len(kept) < max_rows and used + x[2] <= max_size:
                    used += x[2]
                    kept.append(x)
            want += [(*x, p, len(own) - len(kept)) for p, x in enumerate(kept, 1)]
        assert sorted(map(tuple, BU.within(df, "g", ["i"], "n", max_rows, max_size).collect()), key=str) == sorted(want, key=str)
    lines = [(None if i else "g", i, len("x" * (7 * i)) + 1) for i in range(40)]  # as the injector counts
    own = BU.within(spark.createDataFrame([("g", i, n) for _, i, n in lines], "g string, i int, n int"), "g", ["i"], "n", MAX_LINES, MAX_BYTES)
    assert sorted(r.i for r in own.collect()) == budget(["x" * (7 * i) for i in range(40)])
    assert BU.within(df.limit(0), "g", ["i"], "n", 10, 10).count() == 0


def test_r2_k14_sessions_reset_restart_and_expire(spark, tmp_path):
    turn = lambda n, start=None: ([("s", True, start, None, None, None)] if start is not None else []) + [("s", False, None, f"p{i:02}", "k", "m") for i in range(n)]
    # with processing time, batches without data would never end
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)

    def run(name, turns, ttl=DAY):
        spark.createDataFrame(turns, TURN).coalesce(1).write.mode("append").json(f"{tmp_path}/{name}/in")
        stream = spark.readStream.schema(TURN).json(f"{tmp_path}/{name}/in")
        into = lambda df, i: df.write.mode("overwrite").json(f"{tmp_path}/{name}/out{i}")
        query = sessions(stream, ttl).writeStream.foreachBatch(into).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        i = query.lastProgress["batchId"]
        return sorted((r.path, r.baseline, r.more) for r in spark.read.schema(OUTPUT).json(f"{tmp_path}/{name}/out{i}").collect())

    try:  # each run is a new query on the same checkpoint: a restart
        assert run("a", turn(14, "c1")) == [(f"p{i:02}", "c1", 4) for i in range(10)]
        assert run("a", turn(14)) == [(f"p{i:02}", "c1", 0) for i in range(10, 14)]
        assert run("a", turn(2, "")) == [("p00", None, 0), ("p01", None, 0)]  # anew, without a baseline
        assert run("b", turn(1, "c1"), 1000) == [("p00", "c1", 0)]
        time.sleep(1.5)
        assert run("b", turn(1), 1000) == [("p00", None, 0)]  # forgotten
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_g7_g8_nested_tree_and_chapters(spark, tmp_path):
    unit = "{{path: {}, kind: k, owner: o, purpose: p, canonical_placement: c}}".format
    files = {
        ".facts/config.yml": "wiki: {product_roots: [src]}\n",
        ".facts/structure.yml": f"version: 1\nkind: structure_map\nunits:\n  src: {unit('src')}\n  docs: {unit('docs')}\n",
        "docs/x.md": "x\n",
        "src/pkg/b.py": "def g(): pass\n",
        "src/pkg/a.py": "def f(): pass\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    catalog = Catalog(spark, str(tmp_path))
    rows = catalog.nested_tree().orderBy("place").collect()
    assert [(r.depth, r.node) for r in rows] == [(0, "src"), (1, "src/pkg"), (2, "src/pkg/a.py"), (3, "src/pkg/a.py::::f"), (2, "src/pkg/b.py"), (3, "src/pkg/b.py::::g")]
    assert [r.id for r in catalog.chapters().collect()] == ["src"]
