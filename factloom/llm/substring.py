"""Substring dedup: words covered by a long window that also stands in an earlier document.

Level-wise doubling. A window of ``size`` words can repeat only if every window of half that length in it
repeats. So each window is first judged by one half-length window in it, its *seed*: the one of
smallest hash, which depends on the window's words alone. Consecutive windows with one seed form a *run*,
so the first level deals about two rows for every ``size`` / 2 words, not one for every word.

* Level ``size / 2``: runs whose seed stands in one document alone go.
* Runs left are extended to their whole length. A run whose words are the same as those of
  an earlier document's run is settled at once, as is every run of a seed that has the same run everywhere.
* Level ``size``: only first copies of runs that differ around their seed are opened
  into windows, which are compared one by one.

Words are runs of characters other than space and \t to \r, unchanged. Runs and windows count as equal when two 64-bit hashes
are: their own and that of their seed.

Defined results: a null or empty text has no words and loses none; a document of fewer words than the window loses
none; a repeat inside one document, or in rows with the same doc_id, removes nothing; a row with a null doc_id neither
loses words nor makes others lose any; all rows are returned; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, column, doc_text, joined_hash, materialise, small_batches, text_chunks, words_of

SIZE = 50

_RUNS = "doc_id long, text_key long, first int, n int, seed long, run long"


def _runs_of(words: Words, size: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one seed: text, first window's first word (in the chunk), windows, seed hash, run hash."""
    half = -(-size // 2)
    at, text = words.windows(size)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    seeds = words.window_hash(np.arange(len(words.hashes) - half + 1), half)
    seed = at + np.lib.stride_tricks.sliding_window_view(seeds, size - half + 1).argmin(axis=1)[at]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(seed) != 0) | (np.diff(text) != 0)]))
    n = np.diff(np.append(new, len(at)))
    first = at[new]
    # a run is no longer than two windows: its first and last one and their distance tell its words
    whole = joined_hash(joined_hash(words.window_hash(first, size), words.window_hash(first + n - 1, size)), n.astype(np.uint64))
    return text[new], first, n, seeds[seed[new]], whole


def _runs(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            words = words_of(texts)
            text, first, n, seed, whole = _runs_of(words, size)
            if len(text):
                keys = [column(rows, c).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "text_key")]
                own = (first - words.first[text]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, own, n.astype(np.int32), seed.view(np.int64), whole.view(np.int64))], names=["doc_id", "text_key", "first", "n", "seed", "run"])

    return run


def _open(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of the runs given with each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            words = words_of(texts)
            runs = column(rows, "runs")
            owner = np.repeat(np.arange(len(texts)), runs.value_lengths().to_numpy())
            first, n, seed = (runs.flatten().field(c).to_numpy().astype(np.int64) for c in ("first", "n", "seed"))
            own = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            owner = np.repeat(owner, n)
            at = own + words.first[owner]
            keys = [column(rows, c).to_numpy(zero_copy_only=False)[owner] for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, own.astype(np.int32), np.repeat(seed, n), words.window_hash(at, size).view(np.int64))], names=["doc_id", "text_key", "first", "seed", "window"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return doc_text(docs).withColumn("text_key", F.xxhash64("text"))


def repeated_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, text_key, first, n: windows ``first`` to ``first + n - 1`` of a text also stand in a smaller doc_id."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    runs = keyed.where("doc_id is not null").mapInArrow(_runs(size), _RUNS)
    seeds = runs.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min("run").alias("run_lo"), F.max("run").alias("run_hi"))
    seeds = materialise(seeds.where("lo < hi").select("seed", "lo", (F.col("run_lo") != F.col("run_hi")).alias("differ")), "seeds")
    alive = materialise(runs.join(seeds, "seed"), "runs")
    alike = alive.where("not differ and doc_id > lo")
    unlike = alive.where("differ")
    firsts = materialise(unlike.groupBy("seed", "run").agg(F.min("doc_id").alias("first_doc")), "firsts")
    unlike = unlike.join(firsts, ["seed", "run"])
    copies = unlike.where("doc_id > first_doc")
    to_open = unlike.where("doc_id = first_doc").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n", "seed")).alias("runs"))
    opened = materialise(keyed.join(to_open, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "runs").mapInArrow(_open(size), "doc_id long, text_key long, first int, seed long, window long"), "windows")
    owners = opened.groupBy("seed", "window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
    owners = materialise(owners.where("owner < last").select("seed", "window", "owner"), "owners")
    singles = opened.join(owners, ["seed", "window"]).where("doc_id > owner").withColumn("n", F.lit(1))
    spans = [x.select("doc_id", "text_key", "first", "n") for x in (alike, copies, singles)]
    return spans[0].unionByName(spans[1]).unionByName(spans[2])


def _removed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            out: list[tuple[int, int, str]] = []
            for text, spans in zip(texts, column(rows, "spans").to_pylist(), strict=True):
                words, kept = text.split(), None
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["first"] for s in spans], 1)
                    np.add.at(edge, [s["first"] + s["n"] - 1 + size for s in spans], -1)
                    kept = [w for w, covered in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not covered]
                left = b" ".join(words if kept is None else kept)
                out.append((len(words), 0 if kept is None else len(words) - len(kept), left.decode()))
            kinds = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), *[pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, and kept (the words left, joined by one space) for every document."""
    spans = repeated_windows(docs, size).groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    joined = _keyed(docs).join(spans, ["doc_id", "text_key"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_removed(size), "doc_id long, n_words long, n_removed long, kept string")
