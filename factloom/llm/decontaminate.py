"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions alone.

An item's windows are sets of (word, place) tokens. A window can occur only where all of its words
do, so one necessary token is enough to find candidates: the prefix is the window's rarest word, rarity
being how often the benchmark's words occur in the whole corpus. A corpus word that equals it, at
place p of the text, is a candidate for a window that starts at p less the token's place in the window;
bounds on that place and on the text's length discard windows that would hang over either end, and the
exact words of the item-sized window decide.

The windows are sent to the documents, not the other way round, in blocks of at most ``BLOCK_WINDOWS``
windows, so each broadcast has a bounded size however large the benchmark is, and no document is shuffled.

Words: runs of characters other than 0x00-0x2F, 0x3A-0x60, 0x7B-0x7F after lower-casing A-Z.

Defined results: null and empty texts have no words, are never hit, and items without words hit nothing; an
item of fewer words than a window is one window; rows with the same doc_id and text are returned each, and rows that share
a doc_id with different texts are judged each by its own text; an empty benchmark leaves every document clean; columns
other than the key and the text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, split_words

SIZE = 13
#: Windows in one broadcast: some 200 bytes each.
BLOCK_WINDOWS = 100_000
#: Share of a document's words, in hundredths, that must be hit for it to count as contaminated.
PERCENT = 5

#: What stands between words, fixed by the contract.
BETWEEN = "".join(map(chr, [*range(1, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words(text: Column) -> Column:
    """Lower-cases A-Z only. A NUL, which translate() cannot map, is replaced first."""
    return split_words(F.replace(F.coalesce(text, F.lit("")), F.lit("\0"), F.lit(" ")), BETWEEN, lower=True)


def _windows(items: DataFrame, size: int) -> DataFrame:
    """window (array of words) and the items that have it, each distinct window once."""
    each = items.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    cut = each.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(size)).alias("window"))
    return cut.groupBy("window").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))


def _necessary(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window_id, window, word (its rarest) and place (0-based) of that word."""
    token = windows.select("window_id", F.posexplode("window").alias("place", "word")).join(counts, "word", "left")
    rarest = token.groupBy("window_id").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "word", "place")).alias("t"))
    return windows.join(rarest, "window_id").select("window_id", "window", F.col("t.word").alias("word"), F.col("t.place").alias("place"))


def hits(docs: DataFrame, items: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text_key, start, length, window_id of every occurrence, and the table of windows with their items."""
    windows = materialise(_windows(items, size).withColumn("window_id", F.xxhash64("window")), "windows")
    n_blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    placed = texts.select("doc_id", "text_key", "w", F.posexplode("w").alias("p", "word"))
    found = []
    for k in range(n_blocks):
        block = windows.where(F.pmod("window_id", F.lit(n_blocks)) == k)
        vocabulary = block.select(F.explode("window").alias("word")).distinct()
        counts = placed.select("word").join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("times"))
        prefix = materialise(_necessary(block, counts), "prefix")
        start = F.col("p") - F.col("place")
        near = placed.join(F.broadcast(prefix), "word").where((start >= 0) & (start + F.size("window") <= F.size("w")))
        exact = near.where(F.slice("w", start + 1, F.size("window")) == F.col("window"))
        found.append(exact.select("doc_id", "text_key", start.alias("start"), F.size("window").alias("length"), "window_id"))
    return reduce(DataFrame.unionByName, found), windows


def contamination(docs: DataFrame, items: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items (sorted ids as text), contaminated for every document."""
    occurrences, windows = hits(docs, items, size)
    occurrences = materialise(occurrences, "hits")
    key = ["doc_id", "text_key"]
    covered = occurrences.select(*key, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("p")).distinct()
    n_hit = covered.groupBy(*key).agg(F.count("*").alias("n_hit"))
    named = occurrences.select(*key, "window_id").distinct().join(windows.select("window_id", F.explode("items").alias("item")), "window_id")
    n_items = named.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_items = n_items.withColumnsRenamed({"doc_id": "item_doc", "text_key": "item_text"})
    both = n_hit.join(n_items, F.col("doc_id").eqNullSafe(F.col("item_doc")) & (F.col("text_key") == F.col("item_text")))
    hit = materialise(both.select(*key, "n_hit", "items"), "hit")
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = (texts["doc_id"].eqNullSafe(hit["doc_id"])) & (texts["text_key"] == hit["text_key"])
    full = texts.join(hit, same, "left").select(texts["doc_id"], texts["text_key"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    judged = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return full.select(*key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", judged.alias("contaminated"))
