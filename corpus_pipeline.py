"""The corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), docs being the documents that its predecessor kept, and returns
a DataFrame; ``run`` writes each stage's result as Parquet to the shared folder and reads it again for
the next. All stages but the last return the columns of documents.

Defined results: documents with null or empty texts fail the quality rules; a document goes when all its lines that
hold a word repeat earlier ones; of documents linked as near duplicates the smallest doc_id stays; contaminated documents
go; an empty table passes through every stage; repeated rows are treated alike by every stage but near
duplicates, where of rows with one doc_id and one text that with the smallest other columns stays. Rows that share a doc_id with
different texts are one document there, and each of its texts stays or none; rows without a doc_id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, jaccard, lines, packing, quality
from factloom.llm.common import materialise
from factloom.llm.queries import table, tokenizer_path, trusted


def _like(docs: DataFrame, verdicts: DataFrame, keep: str) -> DataFrame:
    """The rows of docs whose verdict (doc_id, text_key, ``keep``) is true, columns unchanged."""
    good = verdicts.where(keep).select(F.col("doc_id").alias("verdict_doc"), F.col("text_key").alias("verdict_text")).distinct()
    same = docs["doc_id"].eqNullSafe(good["verdict_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == good["verdict_text"])
    return docs.join(good, same, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _like(docs, quality.judge(docs, trusted(table(spark, sf_dir, "labels"))), "kept")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(docs).where("not repeated")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _one_each(docs: DataFrame) -> DataFrame:
    """One row for each doc_id and text: the smallest of the other columns, where they have an order."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not others:
        return docs.distinct()
    ordered = "map<" not in docs.select(*others).schema.simpleString() and "variant" not in docs.select(*others).schema.simpleString()
    first = (F.min if ordered else F.any_value)(F.struct(*others))
    once = docs.groupBy("doc_id", "text").agg(first.alias("others"))
    return once.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(docs)
    heads = found.where("component_id = doc_id").select(F.col("doc_id").alias("head")).distinct()
    known = docs.join(heads, docs["doc_id"] == heads["head"], "left_semi")
    return _one_each(known).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(docs.withColumn("text", F.coalesce("text", F.lit(""))), table(spark, sf_dir, "benchmark"))
    return _like(docs, judged, "not contaminated")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizing and packing are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
