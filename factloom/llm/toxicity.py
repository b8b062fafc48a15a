"""Toxicity by a factorization machine over hashed terms.

A document's terms are its lower-cased letter runs and their beginnings (two lengths), hashed to
``DIMENSION`` places; a term's value grows with the logarithm of its share of the words, so
one harsh word in a long text weighs less than the same in a short one. The machine scores

    bias + sum of w[i] x[i] + sum over pairs of <v[i], v[j]> x[i] x[j]

so that terms harmless alone, an insult and the mention of a group, can count together. It is fitted on the driver
to a bounded sample of labelled rows (``SAMPLE``, the smallest hashes of doc_id) and sent to the executors, whose
tasks score every whole text. Its size is fixed by DIMENSION and RANK. Every term of the sample takes part; no term is left out for
saying little alone.

Fitting: first the linear weights, by Adagrad with an absolute-value penalty. What they miss, the residuals, is then held
against every pair of the ``PAIRED`` most frequent terms: a pair's score is the residuals' sum over its co-occurrences (about the terms' means)
in standard errors. The leading eigenvectors of the scores beyond ``PAIR_Z`` are where the factors start, for
gradient steps from near zero hardly find a pair whose terms tell nothing alone. Then weights and factors are
fitted together; an eighth of the sample says when to stop, and whether the pairs help at all.

Defined results: null and empty texts have no terms and get the score of the bias; without labelled rows of both classes
every score is 0.5 times the share of toxic labels; labels that are null are ignored; rows with the same doc_id are scored each;
a null doc_id is held out; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, doc_text, small_batches, text_chunks, words_of

DIMENSION, RANK = 1 << 18, 4
#: Labelled rows that the machine is fitted to, at most.
SAMPLE = 8000
#: Bytes of a word's beginnings that are terms.
BEGINNINGS = (5, 7)
#: Terms whose pairs are looked at before fitting, and the standard errors from which a pair counts.
PAIRED, PAIR_Z = 2048, 8.0
EPOCHS, PATIENCE, BATCH, RATE, DECAY, PENALTY, FIRST = 40, 5, 64, 0.3, 1e-2, 2e-3, 0.01
#: How often a toxic row counts in the loss.
POSITIVE = 4.0

_NOT_LETTER = np.array([not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])


def _places(word: bytes) -> list[int]:
    """The places of a word and of its beginnings, -1 for those it is too short for."""
    return [xxhash.xxh3_64_intdigest(word) % DIMENSION, *(xxhash.xxh3_64_intdigest(word[:n], n) % DIMENSION if len(word) > n else -1 for n in BEGINNINGS)]


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, place and value of the distinct terms of each text."""
    words = words_of([t.decode("utf-8", "replace").lower().encode() for t in texts], between=_NOT_LETTER)
    n = np.diff(words.first)
    each = np.array([_places(w) for w in words.distinct], np.int64).reshape(-1, 1 + len(BEGINNINGS))[words.codes]
    text, place = np.repeat(np.arange(len(texts)), n * each.shape[1]), each.ravel()
    key, times = np.unique((text * DIMENSION + place)[place >= 0], return_counts=True)
    text, place = key // DIMENSION, key % DIMENSION
    return text, place, (np.log1p(1000.0 * times / n[text]) / 4).astype(np.float32)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, text: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Probability for each of n texts."""
        return 1 / (1 + np.exp(-np.clip(_logit(self, text, place, value, n), -30, 30)))


class _Rows:
    """The sample as one sparse matrix over the places it uses."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.edge = np.concatenate([[0], np.cumsum([len(p) for p, _ in rows])]).astype(np.int64)
        self.used, self.place = np.unique(np.concatenate([p for p, _ in rows]), return_inverse=True)
        self.value = np.concatenate([x for _, x in rows]).astype(float)
        self.text = np.repeat(np.arange(self.n), np.diff(self.edge))

    def some(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """text (0 to len(pick) - 1), place and value of the picked rows."""
        sizes = np.diff(self.edge)[pick]
        text = np.repeat(np.arange(len(pick)), sizes)
        at = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.edge[pick][text]
        return text, self.place[at], self.value[at]


def _logit(machine: Machine, text: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    out = machine.bias + np.bincount(text, machine.w[place] * value, n)
    for f in range(machine.v.shape[1]):
        part = machine.v[place, f] * value
        out += 0.5 * (np.bincount(text, part, n) ** 2 - np.bincount(text, part**2, n))
    return out


def _paired(rows: _Rows, residual: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Where the factors start, for the places used."""
    v = draw.normal(0, 1e-3, (len(rows.used), RANK))
    often = np.bincount(rows.place, minlength=len(rows.used))
    chosen = np.argsort(-often, kind="stable")[:PAIRED]
    chosen = chosen[often[chosen] > 4]
    if not len(chosen):
        return v
    where = np.full(len(rows.used), -1)
    where[chosen] = np.arange(len(chosen))
    mean = (often[chosen] / rows.n).astype(np.float32)
    sums, squares = np.zeros((2, len(chosen), len(chosen)), np.float32)
    for at in range(0, rows.n, 1024):
        pick = np.arange(at, min(at + 1024, rows.n))
        text, place, _ = rows.some(pick)
        x = np.zeros((len(pick), len(chosen)), np.float32)
        x[text[where[place] >= 0], where[place][where[place] >= 0]] = 1
        x -= mean
        r = residual[pick, None].astype(np.float32)
        sums += x.T @ (x * r)
        squares += (x**2).T @ ((x * r) ** 2)
    z = sums / np.sqrt(squares + 1e-6)
    np.fill_diagonal(z, 0)
    z[np.abs(z) < PAIR_Z] = 0
    q, shift = np.linalg.qr(draw.normal(size=(len(chosen), RANK)))[0], float(np.abs(z).sum(1).max())
    for _ in range(60 if shift else 0):
        q = np.linalg.qr(z @ q + shift * q)[0]
    strength = np.maximum(np.einsum("if,if->f", q, z @ q), 0)
    if strength.max() > 0:
        v[chosen] += 2 * q * np.sqrt(strength / strength.max())
    return v


def _descend(machine: Machine, rows: _Rows, labels: np.ndarray, held: np.ndarray, pairs: bool, draw: np.random.Generator, least: float, gw: np.ndarray) -> tuple[Machine, float]:
    """Adagrad over minibatches on the logistic loss; the machine of the least loss on the rows held back. ``gw``: squared steps of the weights so far."""
    w, v, bias = machine.w.copy(), machine.v.copy(), machine.bias
    gv, gb = np.full(v.shape, 0.1), 0.1
    best, own_least, since = machine, np.inf, 0
    mine, check = np.flatnonzero(~held), rows.some(np.flatnonzero(held))
    seen, rank = np.zeros(len(w), bool), np.zeros(len(w), np.int64)
    for _ in range(EPOCHS):
        order = draw.permutation(mine)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            text, place, value = rows.some(pick)
            seen[place] = True
            own = np.flatnonzero(seen)
            seen[own] = False
            rank[own] = np.arange(len(own))
            back = rank[place]
            z = bias + np.bincount(text, w[place] * value, len(pick))
            if pairs:
                part = v[place] * value[:, None]
                sums = np.stack([np.bincount(text, part[:, f], len(pick)) for f in range(RANK)], 1)
                z += 0.5 * ((sums**2).sum(1) - np.bincount(text, (part**2).sum(1), len(pick)))
            miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) * np.where(labels[pick] > 0, POSITIVE, 1)
            one = np.bincount(back, miss[text] * value, len(own))
            gw[own] += one**2
            step = RATE / np.sqrt(gw[own])
            moved = w[own] - step * one
            w[own] = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY * BATCH, 0)
            if pairs:
                push = (miss[text] * value)[:, None] * (sums[text] - part)
                for f in range(RANK):
                    two = np.bincount(back, push[:, f], len(own)) + DECAY * BATCH * v[own, f]
                    gv[own, f] += two**2
                    v[own, f] -= RATE * two / np.sqrt(gv[own, f])
            gb += miss.sum() ** 2
            bias -= RATE * miss.sum() / np.sqrt(gb)
        now = Machine(float(bias), w.copy(), v.copy())
        z, y = _logit(now, *check, len(labels[held])), labels[held]
        loss = float(np.mean((np.logaddexp(0, z) - y * z) * np.where(y > 0, POSITIVE, 1)))
        if loss < least:
            best, least = now, loss
        if loss < own_least - 1e-4:
            own_least, since = loss, 0
        else:
            since += 1
            if since == PATIENCE:
                break
    return best, least


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7, pairs: bool = True) -> Machine:
    """The machine for rows of (place, value); without ``pairs`` only its linear part, for comparison."""
    rate = float(labels.mean()) if len(labels) else 0.0
    whole = Machine(-30.0, np.zeros(DIMENSION, np.float32), np.zeros((DIMENSION, RANK), np.float32))
    if not 0 < rate < 1 or not any(len(p) for p, _ in rows):
        odds = 0.5 * rate
        whole.bias = float(np.log(odds / (1 - odds))) if odds else -30.0
        return whole
    draw, table = np.random.default_rng(seed), _Rows(rows)
    held = draw.permutation(len(labels)) < len(labels) // 8
    none = np.zeros((len(table.used), RANK))
    gw = np.full(len(table.used), FIRST)
    found, loss = _descend(Machine(float(np.log(rate / (1 - rate))), np.zeros(len(table.used)), none), table, labels, held, False, draw, np.inf, gw)
    if pairs:
        z = _logit(found, table.text, table.place, table.value, table.n)
        start = Machine(found.bias, found.w, _paired(table, labels - 1 / (1 + np.exp(-np.clip(z, -30, 30))), draw))
        better, less = _descend(start, table, labels, held, True, draw, loss, gw)
        if less < loss:
            found = better
    whole.bias = found.bias
    whole.w[table.used], whole.v[table.used] = found.w, found.v
    return whole


def _sample(docs: DataFrame, labels: DataFrame, learn: Column, limit: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Terms and labels of at most ``limit`` labelled documents for which ``learn`` holds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            text, place, value = terms(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            own = list(zip(cuts[:-1], cuts[1:], strict=True))
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), column(rows, "toxic"), pa.array([place[a:b].astype(np.int32).tobytes() for a, b in own]), pa.array([value[a:b].tobytes() for a, b in own])], names=["doc_id", "toxic", "place", "value"])

    labelled = doc_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")  # at most ``limit`` rows
    # of rows that share a doc_id the one with the least text; rows are cut to the limit before they come to the driver
    single = labelled.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").limit(limit)
    found = single.mapInArrow(run, "doc_id long, toxic int, place binary, value binary").collect()
    found.sort(key=lambda r: r["doc_id"])
    return [(np.frombuffer(r["place"], np.int32).astype(np.int64), np.frombuffer(r["value"], np.float32)) for r in found], np.array([r["toxic"] for r in found], float)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def score(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows, known = _sample(docs, labels, ~held_out(F.col("doc_id")), limit)
    machine = spark.sparkContext.broadcast(fit(rows, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches):
            scores = machine.value.score(*terms(texts), len(texts))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scores)], names=["doc_id", "score"])

    scored = doc_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
