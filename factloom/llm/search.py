"""Ranked lexical search, term at a time with a limit on accumulators.

One pass over the texts writes, for every document, its number of terms and the places' counts of those terms that some item
holds; its sums give N, L and df. A second pass reads that table: each task takes blocks of documents, turns a
block into postings and answers every item on it, the item's rarest term first. New accumulators are opened until what the
remaining terms can still add is less than the k-th partial score; from there on the documents that have one are
only brought to their exact scores. The k-th exact score of earlier blocks of the task counts from the start. Each
task leaves at most k documents an item, of which the first k of all are taken in two steps.

Items are the stated query set; they are dealt to blocks of about ``ITEM_TERMS`` terms, one run over the documents each.

Defined results: null and empty texts (and items) have no terms and are found (and find) nothing; every row is a
document, also with a null or repeated doc_id; of equal scores the smaller doc_id comes first, null before all, then rows
as they come; of items that share an id, or have none, each row is answered by itself; without
documents or items there are no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, doc_text, materialise, small_batches, text_chunks, words_of

#: Terms with their items that one run holds, a long item's own excepted.
ITEM_TERMS = 200_000
#: Postings and documents that a task scores at once.
BLOCK_POSTINGS, BLOCK_DOCS = 1 << 21, 1 << 15
#: Groups of the first merging step.
SALTS = 32

#: Bytes between terms: all ASCII but digits and letters.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def item_terms(items: DataFrame, key: str = "item_id") -> DataFrame:
    """Each item row's distinct terms: the id, a number of its own and the terms."""
    small_batches(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            words = words_of(texts, lower=True, between=_BETWEEN)
            own = [sorted({words.distinct[c] for c in words.codes[a:b].tolist()}) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([column(batch, key), pa.array([[t.decode() for t in x] for x in own], pa.list_(pa.string()))], names=[key, "terms"])

    return doc_text(items, key).mapInArrow(run, f"{key} long, terms array<string>").withColumn("row", F.monotonically_increasing_id())


def item_blocks(items: DataFrame) -> Iterator[DataFrame]:
    """The items in blocks, each small enough to send to every task."""
    sized = items.select("row", F.size("terms").alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    n = -(-total // (ITEM_TERMS // 2)) if total > ITEM_TERMS else 1
    while n > 1:
        block = F.pmod(F.xxhash64("row"), F.lit(n))
        over = sized.groupBy(block.alias("block")).agg(F.sum("size").alias("size"), F.count("*").alias("items")).where(f"size > {ITEM_TERMS} and items > 1")
        if over.isEmpty():
            break
        n *= 2
    for b in range(n):
        yield items.where(F.pmod(F.xxhash64("row"), F.lit(n)) == b)


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each document: its number of terms, and how often it holds which terms of the vocabulary."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            words = words_of(texts, lower=True, between=_BETWEEN)
            numbers = np.fromiter((vocabulary.get(w, -1) for w in words.distinct), np.int64, len(words.distinct))
            term = numbers[words.codes] if len(numbers) else np.zeros(0, np.int64)
            n = np.diff(words.first)
            doc = np.repeat(np.arange(len(n)), n)
            known = term >= 0
            pair, tf = np.unique(doc[known] * len(vocabulary) + term[known], return_counts=True)
            counts = np.bincount(pair // max(len(vocabulary), 1), minlength=len(n))
            lists = [_lists(pair % max(len(vocabulary), 1), counts), _lists(tf, counts)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return doc_text(docs).mapInArrow(run, POSTINGS)


class Block:
    """Postings of some documents by term, each with its weighted share of a score."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, all_docs: int, all_terms: int):
        doc = np.repeat(np.arange(len(n)), counts)
        m = 50 + 50 * n.astype(np.int64) * all_docs // max(all_terms, 1)
        tf = tfs.astype(np.int64)
        gain = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        order = np.argsort(terms, kind="stable")
        self.size, self.doc, self.gain = len(n), doc[order], gain[order]
        self.first = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        filled = np.flatnonzero(np.diff(self.first))
        self.most = np.zeros(len(weights), np.int64)
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.gain, self.first[filled])

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores, with all of the first k; terms come rarest first, and fewer than ``least`` is out."""
        bounds = self.most[terms]
        remaining = np.cumsum(bounds[::-1])[::-1]
        score = np.zeros(self.size, np.int64)
        opened, most, at = [], least, 0
        while at < len(terms):
            held = sum(map(len, opened))
            if held >= k and remaining[at] < bounds[:at].sum():
                found = np.concatenate(opened)
                most = max(most, int(np.partition(score[found], len(found) - k)[len(found) - k]))
            if remaining[at] < most:
                break
            own = slice(self.first[terms[at]], self.first[terms[at] + 1])
            docs, gain = self.doc[own], self.gain[own]
            opened.append(docs[(score[docs] == 0) & (gain > 0)])
            score[docs] += gain
            at += 1
        found = np.concatenate([np.zeros(0, np.int64), *opened])
        if at < len(terms):
            alive = np.zeros(self.size, bool)
            alive[found] = True
            for t in terms[at:].tolist():
                own = slice(self.first[t], self.first[t + 1])
                docs = self.doc[own]
                kept = alive[docs]
                score[docs[kept]] += self.gain[own][kept]
        exact = score[found]
        good = exact >= max(least, 1)
        return found[good], exact[good]


def _first(k: int, scores: np.ndarray, docs: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k by score, then by doc_id, a null one before all."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= least
        scores, docs, known = scores[near], docs[near], known[near]
    order = np.lexsort((docs, known, -scores))[:k]
    return scores[order], docs[order], known[order]


def _answer(found: DataFrame, items: list[np.ndarray], weights: np.ndarray, all_docs: int, all_terms: int, k: int, block_docs: int) -> DataFrame:
    """At most k documents for each item from each task: item, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none, np.zeros(0, bool)) for _ in items]
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = table.column("terms").combine_chunks()
            tfs = table.column("tfs").combine_chunks()
            counts = lists.value_lengths().to_numpy()
            ids = table.column("doc_id").combine_chunks()
            known, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            block = Block(table.column("n").to_numpy(), counts, lists.flatten().to_numpy(), tfs.flatten().to_numpy(), weights, all_docs, all_terms)
            for i, terms in enumerate(items):
                scores, docs, had = best[i]
                at, got = block.search(terms, k, int(scores[-1]) if len(scores) == k else 0)
                if len(at):
                    best[i] = _first(k, np.concatenate([scores, got]), np.concatenate([docs, ids[at]]), np.concatenate([had, known[at]]))

        size = rows = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block_docs - rows)
                held.append(part)
                at += part.num_rows
                rows += part.num_rows
                size += len(column(part, "terms").flatten())
                if rows >= block_docs or size >= BLOCK_POSTINGS:
                    flush()
                    size = rows = 0
        if held:
            flush()
        item = np.repeat(np.arange(len(items)), [len(x[0]) for x in best])
        scores, docs, known = (np.concatenate([b[i] for b in best]) if best else none for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(docs, pa.int64(), mask=~known.astype(bool)), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return found.mapInArrow(run, "item int, doc_id long, score long")


def weight(all_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * all_docs + 2) / (2 * df + 1)))


def _one_block(docs: DataFrame, items: DataFrame, key: str, k: int, block_docs: int) -> DataFrame:
    """The answers of one block of items, whose rows come to the driver and go to every task."""
    spark = docs.sparkSession
    rows = items.orderBy("row").collect()
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    found = materialise(postings(docs, vocabulary), "postings")
    all_docs, all_terms = found.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = n
    weights = np.array([weight(all_docs, int(n)) if n else 0 for n in df], np.int64)
    numbered = [np.array([vocabulary[t.encode()] for t in r["terms"]], np.int64) for r in rows]
    rarest = [x[np.lexsort((x, df[x]))] for x in (y[df[y] > 0] for y in numbered)]
    names = spark.createDataFrame([(i, r[key]) for i, r in enumerate(rows)], f"item int, {key} long")
    best = _answer(found, rarest, weights, all_docs, all_terms, k, block_docs)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    for by in (["item", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), "item").select(key, "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, key: str = "item_id", k: int = 50, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The k best documents of each item: the item's id, rank from 1, doc_id and score."""
    items = materialise(item_terms(items, key), "items")
    out = None
    for block in item_blocks(items):
        own = _one_block(docs, block, key, k, block_docs)
        out = own if out is None else out.unionByName(own)
    return out
