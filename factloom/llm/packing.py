"""Best-fit packing of token pieces into sequences by a configuration linear program.

The histogram of piece lengths (at most ``capacity`` rows) goes to the driver. There the
linear program "fewest sequences, each filled by one configuration of lengths, that cover
the histogram" is solved by multiplicative weights on the covering constraints: a length's price falls exponentially with the share of its
count that is covered. A knapsack dynamic program over the capacity, which takes no length more often than it occurs, finds the
configurations of greatest price. What any configuration can be worth at some prices, against what the histogram is worth, bounds every packing
from below; ``Plan.bound`` is the best bound met. The fractional solution is rounded, fullest configurations first; the pieces left are filled best fit
first, length by length with multiplicities. So is the whole histogram for comparison: the plan never takes more sequences.

The plan is a table of runs, (length, ranks from-to, sequence, offset), whose size
depends on the histogram alone; each piece finds its place from its rank among pieces of its length.

Defined results: a null or empty text is one piece with the end id; rows with the same doc_id are packed each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, doc_text, materialise, small_batches
from .tokens import END_ID, encoded

CAPACITY = 4096
#: Rounds of multiplicative weights: as many as make WORK steps of the dynamic program, within LEAST and MOST.
WORK, LEAST, MOST = 2_000_000, 12, 600
#: How much of a count one configuration may cover in a round of LEAST; with more rounds less. How near the best price it must come.
STEP, NEAR = 0.25, 0.97
#: Shares of the solution that are rounded, tried one after another until the plan takes no more sequences than best fit alone.
TAKEN = (0.8, 0.5, 0.2)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids, cut only where longer than the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), encoded(column(batch, "text").to_pylist(), tokenizer_path, end_id), strict=True):
                for at in range(0, len(ids), capacity):
                    own = ids[at : at + capacity]
                    rows.append((doc, at // capacity, at, len(own), zlib.crc32(own.astype("<u4").tobytes())))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _priced(prices: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Knapsack over lots of 1, 2, 4... pieces of a length, at most its count: best price for each room, and whether each lot is taken there."""
    lots = []
    for i, n in enumerate(np.minimum(counts, capacity // lengths).tolist()):
        lot = 1
        while n > 0:
            lots.append((i, min(lot, n)))
            n -= lot
            lot *= 2
    best, taken = np.zeros(capacity + 1), np.zeros((len(lots), capacity + 1), bool)
    for j, (i, k) in enumerate(lots):
        size = k * int(lengths[i])
        if size <= capacity:
            worth = best[: capacity + 1 - size] + k * prices[i]
            more = taken[j, size:] = worth > best[size:]
            best[size:][more] = worth[more]
    return best, taken, np.array(lots, np.int64).reshape(-1, 2)


def _configuration(first: int, room: int, lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, lots: np.ndarray) -> dict[int, int]:
    """Item ``first`` and the best fill of ``room``, never more of an item than there are: item -> times."""
    out, j = {first: 1}, len(lots) - 1
    while j >= 0 and room > 0:
        chosen = np.flatnonzero(taken[: j + 1, room])
        if not len(chosen):
            break
        j = int(chosen[-1])
        i, k = int(lots[j, 0]), int(lots[j, 1])
        out[i] = out.get(i, 0) + k
        room -= k * int(lengths[i])
        j -= 1
    if out[first] > counts[first]:
        out[first] -= 1
    return out


def _solve(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[dict[tuple, float], float]:
    """Fractional use of configurations that covers every count about once, and a lower bound on the sequences of any packing."""
    n_lots = int(np.ceil(np.log2(np.minimum(counts, capacity // lengths) + 1)).sum())
    rounds = int(np.clip(WORK // max(n_lots * capacity // 64, 1), LEAST, MOST))
    step = STEP * (LEAST / rounds) ** 0.5
    covered, late, usage, bound = np.zeros(len(lengths)), np.zeros(len(lengths)), {}, 0.0
    for r in range(rounds):
        if r == rounds // 2:  # by now prices are near the program's; what was taken before them does not count
            late, usage = np.zeros(len(lengths)), {}
        prices = np.exp(-4.0 * np.minimum(covered - covered.min(), 8.0)) * lengths / capacity
        best, taken, lots = _priced(prices, lengths, counts, capacity)
        bound = max(bound, float((prices * counts).sum() / best[capacity]))
        worth = prices + best[capacity - lengths]
        near = np.maximum(worth >= NEAR * best[capacity], worth == worth.max())
        risen = np.zeros(len(lengths))
        # what is least covered goes first, by configurations that come near the best price
        for first in np.flatnonzero(near)[np.argsort(covered[near], kind="stable")].tolist():
            if risen[first] >= step:
                continue
            one = _configuration(first, int(capacity - lengths[first]), lengths, counts, taken, lots)
            items, times = np.fromiter(one, np.int64), np.fromiter(one.values(), np.int64)
            if (risen[items] >= 2 * step).any():
                continue
            used = float(step * (counts[items] / times).min())
            key = tuple(sorted(one.items()))
            usage[key] = usage.get(key, 0.0) + used
            risen[items] += times * used / counts[items]
        covered += risen
        late += risen
    scale = max(float(np.median(late)), 1e-9)
    return {key: x / scale for key, x in usage.items()}, bound


@dataclass
class Plan:
    """Configurations (item -> times) with how often each is used, a proven lower bound on the sequences of any packing, and the share of
    the tokens that lie in rounded configurations of the program."""

    uses: list[tuple[dict[int, int], int]]
    bound: int
    by_program: float

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.uses)


def _rounded(lengths: np.ndarray, left: np.ndarray, usage: dict[tuple, float], capacity: int, share: float, waste: int) -> list[tuple[dict[int, int], int]]:
    """Configurations that go into the plan, taken out of ``left``: fullest first, ``share`` of each use rounded, at least once, until they
    hold that share of the tokens or leave ``waste`` places empty."""
    filled = {key: sum(int(lengths[i]) * k for i, k in key) for key in usage}
    room, plan, so_far = int(share * (lengths * left).sum()), [], 0
    for key in sorted(usage, key=lambda key: (-filled[key], -usage[key], key)):
        n = min(max(1, int(share * usage[key])), *(int(left[i]) // k for i, k in key), -(-(room - so_far) // filled[key]))
        if capacity > filled[key]:
            n = min(n, waste // (capacity - filled[key]))
        if n > 0:
            waste -= n * (capacity - filled[key])
            plan.append((dict(key), n))
            so_far += n * filled[key]
            for i, k in key:
                left[i] -= n * k
    return plan


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """A plan that holds the histogram exactly."""
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    simple = _best_fit(lengths, counts.copy(), capacity)
    plan, by_program, bound = simple, 0.0, 0.0
    if len(lengths):
        usage, bound = _solve(lengths, counts, capacity)
        spare = sum(n for _, n in simple) * capacity - int((lengths * counts).sum())
        for share in TAKEN:
            left = counts.copy()
            some = _rounded(lengths, left, usage, capacity, share, int(share * spare))
            rest = _best_fit(lengths, left.copy(), capacity)
            if sum(n for _, n in some + rest) <= sum(n for _, n in simple):
                plan, by_program = some + rest, 1 - float((lengths * left).sum() / (lengths * counts).sum())
                break
    # a bound within a millionth of a whole number is that number
    least = max(int(np.ceil(bound - 1e-6)), -(-int((lengths * counts).sum()) // capacity))
    return Plan([({int(order[i]): k for i, k in one.items()}, n) for one, n in plan], least, by_program)


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The largest length left, then the subset of what is left that fills its room best; as often as counts allow."""
    plan = []
    while (alive := np.flatnonzero(left)).size:
        first = int(alive[-1])
        one, room = {first: 1}, capacity - int(lengths[first])
        own = left.copy()
        own[first] -= 1
        while room > 0:
            fit = np.flatnonzero((own > 0) & (lengths <= room))
            if not len(fit):
                break
            # the pair that fills the room best, else the largest length that fits
            partner = np.searchsorted(lengths[fit], room - lengths[fit], "right") - 1
            pair = np.where(partner >= 0, lengths[fit] + lengths[fit[np.maximum(partner, 0)]], lengths[fit])
            pair = np.where((partner == np.arange(len(fit))) & (own[fit] < 2), lengths[fit], pair)
            i = int(fit[np.flatnonzero(pair == pair.max())[-1]])
            one[i] = one.get(i, 0) + 1
            own[i] -= 1
            room -= int(lengths[i])
        n = min(int(left[i]) // k for i, k in one.items())
        plan.append((one, n))
        for i, k in one.items():
            left[i] -= n * k
    return plan


def placements(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs of ranks: piece number ``rank_from + r`` of a length goes to sequence ``sequence + r // times``
    at ``offset + (r % times) * length``."""
    used = dict.fromkeys(range(len(lengths)), 0)
    rows, sequence = [], 0
    for one, n in configurations(lengths, counts, capacity).uses:
        offset = 0
        for i in sorted(one, key=lambda i: -lengths[i]):
            k = one[i]
            rows.append((int(lengths[i]), used[i], used[i] + n * k, k, sequence, offset))
            used[i] += n * k
            offset += k * int(lengths[i])
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "times", "sequence", "offset"]).sort_values(["length", "rank_from"], ignore_index=True)


def ranked(pieces: DataFrame) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0; a length of very many pieces is dealt over many tasks."""
    salts = max(64, 2 * int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return salted.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + own).drop("salt", "before")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    pieces = materialise(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = pieces.groupBy("length").agg(F.count("*").alias("n")).orderBy("length").collect()
    plan = placements(np.array([r["length"] for r in histogram], np.int64), np.array([r["n"] for r in histogram], np.int64), capacity)
    span = 1 << 44  # more pieces than this of one length there are not
    keys = plan["length"].to_numpy() * span + plan["rank_from"].to_numpy()
    runs = {c: plan[c].to_numpy() for c in ("rank_from", "times", "sequence", "offset")}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * span + rank, "right") - 1
            nth = rank - runs["rank_from"][at]
            sequence = runs["sequence"][at] + nth // runs["times"][at]
            offset = runs["offset"][at] + nth % runs["times"][at] * length
            kept = [column(batch, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(pieces).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
