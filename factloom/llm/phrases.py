"""Phrase collocation mining over word suffixes, partitioned vertically by prefix.

Every place in a piece of text starts a suffix of at most four words. Prefixes of suffixes are dealt to groups that a task can
hold: the key space of prefixes is cut wherever the running total of their counts passes the memory budget, a word
above the budget is replaced by its pairs with the next word, and a pair above it by whole suffixes, whose
equal ones are already summed in each chunk of text. Each group sorts its suffixes, which is its subtree cut at depth four,
and reads every node's count from the totals of the leaves below.

Words that occur fewer than ``least`` times end a suffix, and so do such pairs, for no phrase that counts can hold them. They are told by
bits of fixed number (``FILTER_BITS``): a bit set by chance lets through a suffix too many and changes no count.

Three scans read the texts: counts of words, counts of pairs, suffixes.

Defined results: null texts have no words, a null language is ``und``; texts are whole, rows that share a doc_id or repeat are
texts like others; ties go by phrase, in the order of its bytes; a table without words gives no rows; other columns are
ignored. A word with its language is known by a 64-bit hash; if two that occur ``least`` times share one, ValueError is raised.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_hash, materialise, small_batches, text_chunks, words_of

#: Words of the longest phrase.
DEPTH = 4
LEAST = 30
#: Suffixes that a group holds, about; grows with the input so that fewer than 2**20 prefixes are above it.
BUDGET, HEAVY = 1 << 20, 1 << 20
#: Cells that the keys of prefixes are counted in before they are cut into groups: their high bits.
CELL_BITS = 22
FILTER_BITS = 1 << 25
#: Bytes of text that are summed up at once.
CHUNK = 5 << 19
#: Groups of the first step of the ranking.
SALTS = 32

_PIECE_ENDS = np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
_BETWEEN = _PIECE_ENDS.copy()
_BETWEEN[[9, 32]] = True

KEYS = [f"k{i + 1}" for i in range(DEPTH)]


@dataclass
class Chunk:
    """Words of some texts: key of word and language, and whether the next word follows in the same piece."""

    langs: list[str]
    lang: np.ndarray
    codes: np.ndarray
    distinct: list[bytes]
    keys: np.ndarray
    follows: np.ndarray


def _chunk(texts: list[bytes], langs: list[str]) -> Chunk:
    words = words_of(texts, lower=True, between=_BETWEEN)
    names = sorted(set(langs))
    place = {x: i for i, x in enumerate(names)}
    lang = np.repeat(np.fromiter((place[x] for x in langs), np.int64, len(langs)), np.diff(words.first))
    seeds = np.fromiter((xxhash.xxh3_64_intdigest(x.encode(), 7) for x in names), np.uint64, len(names))
    keys = joined_hash(seeds[lang], words.hashes)
    ends = np.searchsorted(np.flatnonzero(_PIECE_ENDS[np.frombuffer(words.data, np.uint8)]), words.starts)
    follows = np.append(ends[1:] == ends[:-1], False) if len(ends) else np.zeros(0, bool)
    return Chunk(names, lang, words.codes, words.distinct, keys, follows)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0
    for batch, own in text_chunks(batches):
        texts += own
        langs += batch.column(batch.schema.get_field_index("lang")).to_pylist()
        size += sum(map(len, own))
        if size >= CHUNK:
            yield _chunk(texts, langs)
            texts, langs, size = [], [], 0
    if texts:
        yield _chunk(texts, langs)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, its key and how often it occurs, of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            cell, n = np.unique(c.codes.astype(np.int64) * len(c.langs) + c.lang, return_counts=True)
            code, lang = np.divmod(cell, len(c.langs))
            seeds = np.fromiter((xxhash.xxh3_64_intdigest(x.encode(), 7) for x in c.langs), np.uint64, len(c.langs))
            own = np.fromiter(map(xxhash.xxh3_64_intdigest, c.distinct), np.uint64, len(c.distinct))
            columns = [pa.array(c.langs, pa.string()).take(pa.array(lang)), pa.array([x.decode() for x in c.distinct], pa.string()).take(pa.array(code)), _longs(joined_hash(seeds[lang], own[code])), _longs(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "key", "n"])

    found = texts.mapInArrow(run, "lang string, word string, key long, n long")
    return found.groupBy("lang", "word", "key").agg(F.sum("n").alias("n"))


def filter_bits(keys: DataFrame) -> np.ndarray:
    """One bit for each key's low bits: FILTER_BITS / 8 bytes on the driver, however many keys there are."""
    at = F.col("key").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        own = np.frombuffer(bytes(r["bits"]), np.uint8)
        from_ = (r["part"] - 1) * len(own)
        out[from_ : from_ + len(own)] = own
    return out


def _set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(bits) * 8 - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _heavy(counts: DataFrame, budget: int) -> np.ndarray:
    """The keys above the budget, sorted: fewer than HEAVY, as the budget is at least a HEAVY-th of all."""
    found = counts.where(F.col("n") > budget).select("key").toArrow().column("key").to_numpy()
    return np.sort(found.view(np.uint64))


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
    return listed[at] == values


def pair_counts(texts: DataFrame, common: np.ndarray, heavy: np.ndarray) -> DataFrame:
    """Key of each pair of common words, whether its first is above the budget, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            good = _set(common, c.keys)
            at = np.flatnonzero(c.follows[:-1] & good[:-1] & good[1:])
            pair, first, n = np.unique(joined_hash(c.keys[at], c.keys[at + 1]), return_index=True, return_counts=True)
            columns = [_longs(pair), pa.array(_among(c.keys[at[first]], heavy), pa.bool_()), _longs(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "heavy", "n"])

    found = texts.mapInArrow(run, "key long, heavy boolean, n long")
    return found.groupBy("key", "heavy").agg(F.sum("n").alias("n"))


def group_starts(prefixes: DataFrame, budget: int) -> np.ndarray:
    """First cell of each group: cells of prefixes in order, cut where their running total passes the budget."""
    cell = F.shiftrightunsigned("key", 64 - CELL_BITS)
    cells = prefixes.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    if not len(cells):
        return np.zeros(1, np.int64)
    before = np.cumsum(cells.column("n").to_numpy())
    group = before // budget
    return np.append(0, cells.column("cell").to_numpy()[1:][group[1:] != group[:-1]]).astype(np.int64)


def _suffixes(common: np.ndarray, pairs: np.ndarray, heavy: np.ndarray, heavy_pairs: np.ndarray, starts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = lambda h: (h >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        for c in _chunks(batches):
            good = _set(common, c.keys)
            pair = joined_hash(c.keys[:-1], c.keys[1:])
            goes_on = c.follows[:-1] & good[:-1] & good[1:]
            goes_on[goes_on] = _set(pairs, pair[goes_on])
            reach = np.concatenate([goes_on, np.zeros(DEPTH, bool)])
            padded = np.concatenate([c.keys, np.zeros(DEPTH, np.uint64)])
            at = np.flatnonzero(goes_on)
            if not len(at):
                continue
            more, path = np.ones(len(at), bool), []
            for i in range(DEPTH):
                path.append(np.where(more, padded[at + i], np.uint64(0)))
                more &= reach[at + i]
            whole = joined_hash(joined_hash(path[0], path[1]), joined_hash(path[2], path[3]))
            whole, first, n = np.unique(whole, return_index=True, return_counts=True)
            path = [p[first] for p in path]
            own = pair[at[first]]
            long, split = _among(path[0], heavy), _among(own, heavy_pairs)
            split &= long
            by = np.where(split, cell(whole), np.where(long, cell(own), cell(path[0])))
            group = np.searchsorted(starts, by, "right") - 1 + np.where(split, len(starts), 0)
            order = np.lexsort((path[1], path[0], group))
            group = group[order]
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            values = np.stack([*[p[order] for p in path], n[order].astype(np.uint64)])
            payloads = [values[:, a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(group)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group[edges], pa.int32()), pa.array(payloads, pa.binary())], names=["group", "suffixes"])

    return run


def _subtree(groups: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """Nodes of one group with their counts. Above whole suffixes of a split pair, counts are the group's own part."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64).reshape(DEPTH + 1, -1) for x in table.column("suffixes").to_pylist()]
        values = np.concatenate(parts, axis=1)
        values = values[:, np.lexsort(values[DEPTH - 1 :: -1])]
        split = table.column("group")[0].as_py() >= groups
        n, new, found = values[DEPTH].astype(np.int64), np.zeros(values.shape[1], bool), []
        new[:1] = True
        for depth in range(1, DEPTH + 1):
            level = values[depth - 1]
            new[1:] |= level[1:] != level[:-1]
            if depth == 1:
                continue
            begins = np.flatnonzero(new)
            total = np.add.reduceat(n, begins)
            kept = (level[begins] != 0) & ((total >= least) | (split and depth < DEPTH))
            node = values[:DEPTH, begins[kept]].copy()
            node[depth:] = 0
            found.append((node, total[kept]))
        nodes, totals = np.concatenate([x for x, _ in found], axis=1), np.concatenate([x for _, x in found])
        return pa.table([*[_longs(k) for k in nodes], _longs(totals)], names=[*KEYS, "n"])

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to 4 words that occur ``least`` times or more, as keys of their words (0: none) with their counts; and all words."""
    small_batches(docs.sparkSession)
    texts = _texts(docs)
    words = materialise(word_counts(texts), "words")
    common = words.where(F.col("n") >= least)
    shared = words.join(common.select("key"), "key", "left_semi").groupBy("key").count().where("count > 1")
    if not shared.isEmpty():
        raise ValueError("two words share a 64-bit hash")
    total = common.agg(F.sum("n")).first()[0] or 0
    budget = max(budget, -(-total // HEAVY))
    word_bits, heavy = filter_bits(common), _heavy(common, budget)
    pairs = materialise(pair_counts(texts, word_bits, heavy).where(F.col("n") >= least), "pairs")
    heavy_pairs = _heavy(pairs.where("heavy"), budget)
    light = common.where(F.col("n") <= budget).select("key", "n").unionAll(pairs.where("heavy").where(F.col("n") <= budget).select("key", "n"))
    starts = group_starts(light, budget)
    dealt = texts.mapInArrow(_suffixes(word_bits, filter_bits(pairs), heavy, heavy_pairs, starts), "group int, suffixes binary")
    nodes = dealt.groupBy("group").applyInArrow(_subtree(len(starts), least), ", ".join(f"{k} long" for k in [*KEYS, "n"]))
    summed = nodes.groupBy(*KEYS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    singles = common.select(F.col("key").alias("k1"), *[F.lit(0).cast("long").alias(k) for k in KEYS[1:]], "n")
    return materialise(summed.unionByName(singles), "phrases"), words


def _part(first: Column, size: Column) -> list[Column]:
    """Keys of ``size`` words of a phrase from word ``first`` (from 0), zeros after them."""
    path = F.array(*KEYS)
    return [F.when(size > i, F.get(path, first + i)).otherwise(0).alias(k) for i, k in enumerate(KEYS)]


def _span(first: Column, size: Column) -> Column:
    return F.struct(*_part(first, size))


def mine(docs: DataFrame, top: int = 2000, least: int = LEAST, keep_below: int = 80, budget: int = BUDGET) -> DataFrame:
    """Each language's first phrases: lang, rank, phrase, a, l, r, n, score."""
    phrases, words = frequent_phrases(docs, least, budget)
    depth = sum((F.when(F.col(k) != 0, 1).otherwise(0) for k in KEYS[1:]), F.lit(1))
    long = phrases.withColumn("depth", depth).where("depth > 1")

    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("depth") - 1), lambda size: F.transform(F.sequence(F.lit(0), F.col("depth") - size), lambda at: _span(at, size))))
    within = long.where("depth > 2").select(F.explode(inside).alias("part"), "n").groupBy(*[F.col(f"part.{k}").alias(k) for k in KEYS]).agg(F.max("n").alias("longer"))
    held = (100 * F.col("longer").cast("decimal(20,0)")) >= keep_below * F.col("n").cast("decimal(20,0)")
    left = long.join(within, KEYS, "left").where(F.col("longer").isNull() | ~held).select(*KEYS, "depth", "n")

    cuts = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda k: F.struct(k.alias("k"), _span(F.lit(0), k).alias("left"), _span(k, F.col("depth") - k).alias("right")))
    cut = left.select(*KEYS, F.col("n").alias("a"), F.explode(cuts).alias("cut"))
    counts = phrases.select(F.struct(*KEYS).alias("part"), "n")
    by_left = cut.join(counts.select(F.col("part").alias("of_left"), F.col("n").alias("l")), F.col("cut.left") == F.col("of_left"))
    both = by_left.join(counts.select(F.col("part").alias("of_right"), F.col("n").alias("r")), F.col("cut.right") == F.col("of_right"))
    score = F.expr("2000000bd * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.groupBy(*KEYS, "a").agg(F.min(F.struct(score.alias("score"), F.col("cut.k").alias("k"), "l", "r")).alias("best"))

    named = best
    for i, k in enumerate(KEYS):
        own = words.where(F.col("n") >= least).select(F.col("key").alias(k), F.col("word").alias(f"w{i}"), *([F.col("lang")] if i == 0 else []))
        named = named.join(own, k, "inner" if i == 0 else "left")
    rows = named.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(DEPTH)]).alias("phrase"), "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return rows.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
