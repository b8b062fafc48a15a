"""The driver's queries over the synthetic tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html, jaccard, lines, oracles, packing, phrases, quality, search, substring, tokens, toxicity, warc
from .common import materialise, shared_dir

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "tokens")
    tokens.write_token_files(table(spark, sf_dir, "documents"), out, tokenizer_path())
    return tokens.read_tokens(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica for the audit: every 97th page has lost its last character, every 211th is not there."""
    cut = F.when(F.pmod("page_id", F.lit(97)) == 13, F.expr("substring(html, 1, length(html) - 1)")).otherwise(F.col("html"))
    return pages.select("page_id", "url", cut.alias("html"), (F.pmod("page_id", F.lit(211)) == 7).alias("gone"))


def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sound replica against one whose records were damaged in place: offsets are those of the sound archives."""
    pages = table(spark, sf_dir, "pages")
    sound = materialise(warc.hashed_records(pages), "records")
    copy = damaged(pages)
    hashes = copy.select("page_id", "gone", F.sha2(warc.record(F.col("page_id"), F.col("url"), F.col("html")), 256).alias("hash"))
    replica = sound.drop("hash").join(hashes, "page_id").where("not gone").drop("gone")
    return warc.audit(sound, materialise(replica, "records"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def trusted(labels: DataFrame) -> DataFrame:
    """The trusted target: documents labelled as of good quality."""
    return labels.where("quality = 1").select("doc_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), trusted(table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_decontamination": op2_decontamination,
        "op3_html_extraction": op3_html_extraction,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_warc_fixity": op6_warc_fixity,
        "op7_toxicity": op7_toxicity,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_line_dedup": op9_line_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_phrase_mining": op11_phrase_mining,
        "op12_bpe_codec": op12_bpe_codec,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
