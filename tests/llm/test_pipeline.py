from __future__ import annotations

import corpus_pipeline
import pytest
from factloom.llm import queries
from pyspark.sql import functions as F

from . import brute
from .test_operators import SCHEMA, check_packing, corpus, table


def test_stages_are_the_five(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "best_fit_packing"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    docs = corpus()
    table(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in docs], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(docs[40].split()[:40])), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs


def test_each_stage_on_its_own_input(spark, tables):
    folder, docs = tables
    now = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = stages["quality_rules"](spark, now, folder)
    assert kept.columns == now.columns
    failed = {k for k, v in brute.base_rules(docs).items() if v[-1]}
    assert not set(texts(kept)) & failed and texts(kept)

    left = stages["line_dedup"](spark, kept, folder)
    assert left.columns == now.columns
    want = {k: t for k, (n, gone, t) in brute.lines(texts(kept)).items() if n > gone}
    assert texts(left) == want
    assert all(r.n_chars == len(r.text) for r in left.collect())

    single = stages["near_duplicates"](spark, kept, folder)
    assert single.columns == now.columns
    assert set(texts(single)) == {k for k, (_, c) in brute.jaccard(texts(kept)).items() if c == k}

    clean = stages["decontamination"](spark, kept, folder)
    assert clean.columns == now.columns
    items = {r.item_id: r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    assert set(texts(clean)) == {k for k, v in brute.contamination(texts(kept), items).items() if not v[-1]}

    packed = stages["best_fit_packing"](spark, clean, folder).collect()
    check_packing(packed, 4096)
    assert {r.doc_id for r in packed} == set(texts(clean))


def test_run_and_empty_tables(spark, tables, sf):
    folder, _ = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and check_packing(rows, 4096) >= 1
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_odd_rows_pass_every_stage(spark, tables):
    folder, docs = tables
    long = docs[0]
    odd = table(spark, [(None, None), (None, long), (None, long), (1, None), (1, long), (1, long), (2, ""), (3, "x" * 200_000 + " " + long)])
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, folder).count()


def test_a_copy_does_not_survive_as_its_short_lines(spark, tables):
    folder, docs = tables
    body = "\n".join(f"line {i} of a longer text that stands {i} times here" for i in range(3))
    rows = {1: f"{body}\nThe end\n", 2: f"{body}\nthe  END\n", 3: f"{body}\nNot yet\n\n", 4: "The end\nNot yet", 5: f"{body}\n \n", 6: None, 7: "", 8: "\n"}
    given = table(spark, rows).withColumns({"n_removed": F.lit("mine"), "verdict_doc": F.lit(1)})
    left = corpus_pipeline.line_dedup(spark, given, folder)
    assert left.schema == given.schema
    assert {r.doc_id: (r.text, r.n_removed) for r in left.collect()} == {1: (rows[1], "mine"), 3: ("Not yet\n\n", "mine"), 6: (None, "mine"), 7: ("", "mine"), 8: ("\n", "mine")}


def test_rows_with_one_id_and_different_texts_stay(spark, tables):
    folder, docs = tables
    rows = [(1, docs[30]), (1, docs[31]), (1, docs[30]), (2, docs[30]), (None, "x"), (None, "x")]
    left = corpus_pipeline.near_duplicates(spark, table(spark, rows), folder)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == sorted([(0, "x"), (0, "x"), (1, docs[30]), (1, docs[31])])
