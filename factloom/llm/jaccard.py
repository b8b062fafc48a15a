"""N-gram Jaccard join as a blocked sparse matrix product of documents by n-grams.

1. Each document's set of word shingles is hashed; documents with the same set form a class, represented by
   its smallest doc_id.
2. The incidence is dealt in column blocks (ranges of the shingle hash). A block counts the
   documents of each shingle and keeps what at least two share.
3. Size bounds: a partner at similarity t holds at least t * n of a document's n shingles, so documents that share fewer
   than that with all others together go, and two partners share one of each one's n - ceil(t * n) + 1 rarest
   shingles. Documents that have such a shingle in common form a group.
4. Products. In each group one document, the hub, is held against those that are not linked with it yet and whose size and place allow it: overlaps
   accumulate over slices of the hub's columns, and a pair goes as soon as what is left cannot lift it to its bound. What is
   linked becomes one component, and after ``HUBS`` such rounds only pairs of different components are left in the groups. Small groups
   list these, and each is multiplied once; large groups are multiplied in tiles of two row blocks, where they lie. So the work grows with the
   candidates: copies by the thousand cost some products each, and no group is joined with another before a link is proven.

Hashes have 64 bits; equal hashes count as equal shingles, two of them as equal sets.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer words than a shingle are
one shingle; rows that share a doc_id count as one document, which has the links of each of its texts, and each gets its row; a null doc_id has no
component but for its copies' smallest doc_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, doc_text, materialise, mix, small_batches, text_chunks, words_of
from .graph import components

SHINGLE, PERCENT = 5, 80
#: Incidences in a column block, documents in a row block, columns of a slice, rounds of hubs, hubs that a document is held against in a round.
BLOCK_CELLS, BLOCK_ROWS, SLICE, HUBS, TRIED = 1 << 21, 256, 2048, 2, 4
#: Documents of a group whose pairs are listed; larger groups are multiplied in tiles.
SMALL = 48
#: Sets of one task that are remembered, so that a copy in the same task adds no incidence.
SEEN = 1 << 18

_PAIR = np.dtype([("h", "<u8"), ("d", "<u4")])


def _sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes ordered by text, the text of each, and how many each text has."""
    words = words_of(texts, lower=True)
    at, text = words.windows(size)
    hashes = words.window_hash(at, size)
    counts = np.diff(words.first)
    for n in range(1, size):  # shorter texts are one shingle, which their number of words keeps apart
        short = np.flatnonzero(counts == n)
        hashes = np.concatenate([hashes, mix(words.window_hash(words.first[short], n) + np.uint64(n))])
        text = np.concatenate([text, short])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, text, np.bincount(text, minlength=len(texts))


def _digest(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums for each text's set."""
    edge = np.searchsorted(text, np.arange(n + 1))
    out = []
    for salt in (0x51ED270B0A1F39C1, 0xB5297A4D3F84D5B5):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
    return out[0], out[1]


def _described(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            hashes, text, n = _sets(texts, size)
            one, two = _digest(hashes, text, len(texts))
            yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(n.astype(np.int64)), pa.array(one), pa.array(two)], names=["doc_id", "n_shingles", "set1", "set2"])

    return run


def _binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """values[edges[i]:edges[i + 1]] as one binary each."""
    offsets = (edges * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _dealt(size: int, blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The incidence by column block: block, hashes, and doc_id, label (set size, part of its digest) and number of hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows, texts in text_chunks(batches):
            hashes, text, n = _sets(texts, size)
            fresh = np.zeros(len(texts), bool)
            digest = _digest(hashes, text, len(texts))
            label = (n.astype(np.int64) << 32) | (digest[0] & 0xFFFFFFFF)
            for i, key in enumerate(zip(*(x.tolist() for x in digest), strict=True)):
                fresh[i] = key not in seen
                if len(seen) < SEEN:
                    seen.add(key)
            kept = fresh[text]
            hashes, text = hashes[kept], text[kept]
            ids = column(rows, "doc_id").to_numpy(zero_copy_only=False)
            block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
            order = np.lexsort((text, block))
            hashes, text, block = hashes[order], text[order], block[order]
            cell = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (text[1:] != text[:-1])])) if len(block) else np.zeros(0, np.int64)
            present, first = np.unique(block[cell], return_index=True)
            cells = np.append(first, len(cell))
            counts = np.diff(np.append(cell, len(hashes)))
            owner = text[cell]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(present.astype(np.int32)),
                    _binaries(hashes, np.append(cell, len(hashes))[cells]),
                    _binaries(ids[owner].astype(np.int64), cells),
                    _binaries(label[owner], cells),
                    _binaries(counts.astype(np.uint32), cells),
                ],
                names=["block", "hashes", "ids", "labels", "counts"],
            )

    return run


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _shared(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Of one column block: each document's shingles that others have too, with the number of documents, dealt by label, so that equal sets meet."""

    def run(table: pa.Table) -> pa.Table:
        hashes, ids = _joined(table, "hashes", np.uint64), _joined(table, "ids", np.int64)
        counts, labels = _joined(table, "counts", np.uint32), _joined(table, "labels", np.int64)
        cell = np.repeat(np.arange(len(ids)), counts)
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(first, len(ordered)))
        df = np.empty(len(hashes), np.uint32)
        df[order] = np.repeat(times, times)
        kept = np.flatnonzero(df > 1)
        bucket = (mix(labels.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        kept = kept[np.lexsort((cell[kept], bucket[cell[kept]]))]
        cell = cell[kept]
        edge = np.flatnonzero(np.diff(cell, prepend=-1))
        pairs = np.empty(len(kept), _PAIR)
        pairs["h"], pairs["d"] = hashes[kept], df[kept]
        owner, edges = cell[edge], np.append(edge, len(cell))
        present, at = np.unique(bucket[owner], return_index=True)
        cells = np.append(at, len(owner))
        return pa.table(
            {
                "bucket": present,
                "ids": _binaries(ids[owner], cells),
                "labels": _binaries(labels[owner], cells),
                "counts": _binaries(np.diff(edges).astype(np.uint32), cells),
                "pairs": _binaries(pairs, edges[cells]),
            }
        )

    return run


def _sharing(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Of one bucket of documents: doc_id, label and all shared shingles of those that share enough of their n, once for equal sets."""

    def run(table: pa.Table) -> pa.Table:
        ids, labels = _joined(table, "ids", np.int64), _joined(table, "labels", np.int64)
        pairs = _joined(table, "pairs", _PAIR)
        cell = np.repeat(np.arange(len(ids)), _joined(table, "counts", np.uint32))
        order = np.lexsort((pairs["h"], ids[cell], labels[cell]))
        cell = cell[order]
        owner_id, owner_label, h = ids[cell], labels[cell], pairs["h"][order]
        same = np.zeros(len(cell), bool)
        same[1:] = (owner_id[1:] == owner_id[:-1]) & (owner_label[1:] == owner_label[:-1])
        again = same.copy()  # rows with one doc_id and one text in different tasks
        again[1:] &= h[1:] == h[:-1]
        cell, order, same = cell[~again], order[~again], same[~again]
        edge = np.append(np.flatnonzero(~same), len(cell))
        owner, shared = cell[edge[:-1]], np.diff(edge)
        good = np.flatnonzero(shared * 100 >= (labels[owner] >> 32) * percent)
        h = pairs["h"][order]
        once, known = [], {}
        for i in good.tolist():  # of equal sets the smallest doc_id, which comes first
            key = (int(labels[owner[i]]), h[edge[i] : edge[i + 1]].tobytes()) if shared[i] == labels[owner[i]] >> 32 else None
            if key is None or known.setdefault(key, i) == i:
                once.append(i)
        good = np.array(once, np.int64)
        kept = np.repeat(good, shared[good])
        at = edge[kept] + np.arange(len(kept)) - np.repeat(np.cumsum(shared[good]) - shared[good], shared[good])
        edges = np.concatenate([[0], np.cumsum(shared[good])])
        return pa.table({"doc_id": ids[owner[good]], "label": labels[owner[good]], "pairs": _binaries(pairs[order][at], edges)})

    return run


def _rarest(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each document's shared shingles among its n - ceil(t * n) + 1 rarest, and their places among all by rarity; what it has alone comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for doc, label, own in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "label", "pairs")), strict=True):
                pairs, n = np.frombuffer(own, _PAIR), label >> 32
                alone = n - len(pairs)
                length = n - -(-n * percent // 100) + 1 - alone
                if length > 0:
                    pick = np.lexsort((pairs["h"], pairs["d"]))[:length]
                    k = len(pick)
                    out.append((pairs["h"][pick].view(np.int64), np.full(k, doc), np.full(k, label), (alone + np.arange(k)).astype(np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["meet", "doc_id", "label", "place"])

    return run


def _size(label: Column) -> Column:
    return F.shiftright(label, 32)


def _within(percent: int, a: str, b: str, place_a: str, place_b: str) -> Column:
    """Whether two documents' sizes, and what follows a common shingle in both, leave room for the bound.

    What follows bounds the overlap from the first common shingle on; linked pairs pass at that one at least.
    """
    m, n = _size(F.col(a)), _size(F.col(b))
    rest = F.least(m - F.col(place_a), n - F.col(place_b))
    return (100 * F.least(m, n) >= percent * F.greatest(m, n)) & ((100 + percent) * rest >= percent * (m + n))


def _overlaps(hub: np.ndarray, sets: list[np.ndarray], n_hub: int, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which sets are linked with the hub's. Overlaps accumulate over slices of the hub's columns; pairs below their bound go."""
    columns = np.sort(hub)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cells = np.concatenate(sets)
    at = np.searchsorted(columns, cells)
    inside = np.flatnonzero(at < len(columns))
    inside = inside[columns[at[inside]] == cells[inside]]
    order = inside[np.argsort(at[inside], kind="stable")]
    owner, at = owner[order], at[order]
    need = -(-percent * (n_hub + sizes) // (100 + percent))
    overlap, alive = np.zeros(len(sets), np.int64), np.ones(len(sets), bool)
    for start in range(0, len(columns), SLICE):
        a, b = np.searchsorted(at, [start, start + SLICE])
        some = owner[a:b][alive[owner[a:b]]]
        overlap += np.bincount(some, minlength=len(sets))
        alive &= overlap + max(len(columns) - start - SLICE, 0) >= need
        if not alive.any():
            break
    return alive & (100 * overlap >= percent * (n_hub + sizes - overlap))


def _multiplied(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Edges (a, b) of the linked pairs of hub and partner in one task's row blocks. The hub is the row without a partner's role."""

    def run(table: pa.Table) -> pa.Table:
        block, hub = table.column("block").to_numpy(), table.column("is_hub").to_numpy(zero_copy_only=False)
        hub_doc, hub_label = table.column("hub_doc").to_numpy(), table.column("hub_label").to_numpy()
        ids, labels, pairs = table.column("doc_id").to_numpy(), table.column("label").to_numpy(), table.column("pairs")
        order = np.lexsort((~hub, block, hub_label, hub_doc))
        new = np.flatnonzero(np.any([np.diff(x[order]) != 0 for x in (block, hub_label, hub_doc)], axis=0)) + 1
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(order, new) if len(order) else []:
            if len(rows) > 1 and hub[rows[0]]:
                sets = [np.frombuffer(pairs[int(i)].as_py(), _PAIR)["h"] for i in rows]
                linked = _overlaps(sets[0], sets[1:], int(labels[rows[0]] >> 32), labels[rows[1:]] >> 32, percent)
                found = ids[rows[1:]][linked]
                a.append(np.full(len(found), ids[rows[0]]))
                b.append(found)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _products(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of the pairs (hub_doc, hub_label, doc_id, label) that are linked. A hub's partners are dealt in row blocks."""
    hub = ["hub_doc", "hub_label"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialise(pairs.groupBy(*hub).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "hubs")
    bins = max(parts * 8, (sizes.agg(F.sum("blocks")).first()[0] or 0) // 64)
    dealt = pairs.join(sizes, hub).withColumn("block", F.pmod(F.xxhash64("doc_id", "label"), F.col("blocks")).cast("int")).drop("blocks")
    partners = dealt.join(members, ["doc_id", "label"]).select(*hub, "block", F.lit(False).alias("is_hub"), "doc_id", "label", "pairs")
    blocks = sizes.select(*hub, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    own = blocks.join(members.select(F.col("doc_id").alias("hub_doc"), F.col("label").alias("hub_label"), "pairs"), hub)
    hubs = own.select(*hub, "block", F.lit(True).alias("is_hub"), F.col("hub_doc").alias("doc_id"), F.col("hub_label").alias("label"), "pairs")
    binned = hubs.unionByName(partners).withColumn("bin", F.pmod(F.xxhash64(*hub, "block"), F.lit(bins)))
    return materialise(binned.groupBy("bin").applyInArrow(_multiplied(percent), "a long, b long").distinct(), "links")


def _crossing(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Pairs of different components within each group of the task; groups have at most ``SMALL`` documents."""

    def run(table: pa.Table) -> pa.Table:
        meet, ids, labels, place, component = (table.column(c).to_numpy() for c in ("meet", "doc_id", "label", "place", "component"))
        order = np.argsort(meet, kind="stable")
        out = [[np.zeros(0, np.int64)] for _ in range(4)]
        for rows in np.split(order, np.flatnonzero(np.diff(meet[order])) + 1) if len(order) else []:
            i, j = np.nonzero(np.triu(_allowed(rows, rows, labels, place, component, percent), 1))
            i, j = rows[i], rows[j]
            swap = (ids[j] < ids[i]) | ((ids[j] == ids[i]) & (labels[j] < labels[i]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            for kept, values in zip(out, (ids[i], labels[i], ids[j], labels[j]), strict=True):
                kept.append(values)
        found = pa.table(dict(zip(("hub_doc", "hub_label", "doc_id", "label"), map(np.concatenate, out), strict=True)))
        return found.group_by(found.column_names).aggregate([]) if found.num_rows else found

    return run


def _allowed(left: np.ndarray, right: np.ndarray, labels: np.ndarray, place: np.ndarray, component: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows are of different components and within the bounds of ``_within``."""
    m, n = (labels[left] >> 32)[:, None], (labels[right] >> 32)[None, :]
    rest = np.minimum(m - place[left][:, None], n - place[right][None, :])
    sizes = (100 * np.minimum(m, n) >= percent * np.maximum(m, n)) & ((100 + percent) * rest >= percent * (m + n))
    return sizes & (component[left][:, None] != component[right][None, :])


def _tile(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlaps of two row blocks: what both have is counted slice by slice of the columns they share."""
    one, other = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(one, other)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    cells = []
    for row, values in zip(rows, (one, other), strict=True):
        at = np.searchsorted(columns, values)
        inside = np.flatnonzero(columns[np.minimum(at, len(columns) - 1)] == values) if len(columns) else np.zeros(0, np.int64)
        inside = inside[np.argsort(at[inside], kind="stable")]
        cells.append((row[inside], at[inside]))
    overlap = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(columns), SLICE):
        parts = []
        for n, (row, at) in zip((len(left), len(right)), cells, strict=True):
            a, b = np.searchsorted(at, [start, start + SLICE])
            part = np.zeros((n, min(SLICE, len(columns) - start)), np.float32)
            part[row[a:b], at[a:b] - start] = 1
            parts.append(part)
        overlap += parts[0] @ parts[1].T
    return overlap.astype(np.int64)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edges with the same components as the edges (a, b): each node with the smallest one it reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _tiled(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Edges (a, b) between the components of what is linked in the task's tiles of groups."""

    def run(table: pa.Table) -> pa.Table:
        names = ("meet", "x", "y", "block", "label", "place", "component")
        meet, x, y, block, labels, place, component = (table.column(c).to_numpy() for c in names)
        pairs, a, b = table.column("pairs"), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.lexsort((y, x, meet))
        new = np.flatnonzero(np.any([np.diff(v[order]) != 0 for v in (meet, x, y)], axis=0)) + 1
        for rows in np.split(order, new) if len(order) else []:
            left, right = rows[block[rows] == x[rows[0]]], rows[block[rows] == y[rows[0]]]
            good = _allowed(left, right, labels, place, component, percent) if len(left) and len(right) else np.zeros((0, 0), bool)
            left, right, good = left[good.any(axis=1)], right[good.any(axis=0)], good[good.any(axis=1)][:, good.any(axis=0)]
            if good.any():
                sets = [[np.frombuffer(pairs[int(i)].as_py(), _PAIR)["h"] for i in side] for side in (left, right)]
                overlap = _tile(*sets)
                union = (labels[left] >> 32)[:, None] + (labels[right] >> 32)[None, :] - overlap
                i, j = np.nonzero(good & (100 * overlap >= percent * union))
                for kept, values in zip((a, b), _spanning(component[left[i]], component[right[j]]), strict=True):
                    kept.append(values)
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _rest(open_: DataFrame, members: DataFrame, tested: DataFrame | None, percent: int) -> DataFrame:
    """Edges (a, b) of all that is linked across components in groups. open_: meet, doc_id, label, place, component.

    Small groups give their pairs, at most ``SMALL`` for each of their rows, once each; large ones are multiplied tile by tile where they lie.
    """
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = materialise(open_.groupBy("meet").agg(F.count("*").alias("g")).withColumn("blocks", F.ceil(F.col("g") / BLOCK_ROWS).cast("int")), "groups")
    rows = open_.join(sizes, "meet")
    small = rows.where(F.col("g") <= SMALL).drop("g", "blocks")
    n_rows = sizes.where(F.col("g") <= SMALL).agg(F.sum("g")).first()[0] or 0
    binned = small.withColumn("bin", F.pmod(F.xxhash64("meet"), F.lit(max(parts * 8, n_rows // 4096))))
    pairs = binned.groupBy("bin").applyInArrow(_crossing(percent), "hub_doc long, hub_label long, doc_id long, label long").distinct()
    pair = ["hub_doc", "hub_label", "doc_id", "label"]
    if tested is not None:
        turned = tested.select(*[F.col(c).alias(n) for c, n in zip(pair, [*pair[2:], *pair[:2]], strict=True)])
        pairs = pairs.join(tested.unionByName(turned), pair, "left_anti")
    found = _products(materialise(pairs, "pairs"), members, percent)
    if sizes.where(F.col("g") > SMALL).isEmpty():
        return found
    large = rows.where(F.col("g") > SMALL).withColumn("block", F.pmod(F.xxhash64("doc_id", "label"), F.col("blocks")).cast("int"))
    other = large.join(members, ["doc_id", "label"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = other.select("meet", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "label", "place", "component", "pairs")
    n_tiles = sizes.where(F.col("g") > SMALL).agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    dealt = tiles.withColumn("bin", F.pmod(F.xxhash64("meet", "x", "y"), F.lit(max(parts * 8, int(n_tiles)))))
    return found.unionByName(materialise(dealt.groupBy("bin").applyInArrow(_tiled(percent), "a long, b long"), "links"))


def _links(members: DataFrame, rare: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) over doc_ids, enough to connect all that is linked. rare: meet, doc_id, label, place."""
    links, tested, open_, named = None, None, rare, None
    pair = ["hub_doc", "hub_label", "doc_id", "label"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(HUBS + 1):
        rows = open_.withColumn("component", F.col("doc_id"))
        if named is not None:
            rows = open_.join(named.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        # dealt once, for the hubs and for their groups
        rows = rows.repartition(parts, "meet")
        hub = F.min(F.struct(F.xxhash64("doc_id", "label", F.lit(turn)).alias("order"), "doc_id", "label", "place", "component")).alias("hub")
        groups = rows.groupBy("meet").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), hub).where("lo <> hi").select("meet", "hub")
        # only groups that hold more than one component are looked at again
        open_ = materialise(rows.join(groups, "meet"), "open")
        if open_.isEmpty():
            break
        if turn < HUBS:
            met = open_.select("doc_id", "label", "place", "component", F.col("hub.doc_id").alias("hub_doc"), F.col("hub.label").alias("hub_label"), F.col("hub.place").alias("hub_place"), F.col("hub.component").alias("hub_component"), "hub.order")
            near = met.where("component <> hub_component").where(_within(percent, "label", "hub_label", "place", "hub_place"))
            some = near.groupBy("doc_id", "label").agg(F.slice(F.array_sort(F.collect_set(F.struct("order", "hub_doc", "hub_label"))), 1, TRIED).alias("hubs"))
            found = some.select(F.explode("hubs").alias("h"), "doc_id", "label").select("h.hub_doc", "h.hub_label", "doc_id", "label")
        else:
            some = _rest(open_.drop("hub"), members, tested, percent)
            return some if links is None else links.unionByName(some)
        if tested is not None:
            turned = tested.select(*[F.col(c).alias(n) for c, n in zip(pair, [*pair[2:], *pair[:2]], strict=True)])
            found = found.join(tested.unionByName(turned), pair, "left_anti")
        found = materialise(found, "pairs")
        if not found.isEmpty():
            some = _products(found, members, percent)
            tested = found if tested is None else tested.unionByName(found)
            links = some if links is None else links.unionByName(some)
        if links is not None:
            named = components(links)
        open_ = open_.select("meet", "doc_id", "label", "place")
    return links if links is not None else members.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included) for every document."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = doc_text(docs)
    described = materialise(texts.mapInArrow(_described(size), "doc_id long, n_shingles long, set1 long, set2 long"), "described")
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BLOCK_CELLS))
    dealt = texts.where("doc_id is not null").mapInArrow(_dealt(size, blocks), "block int, hashes binary, ids binary, labels binary, counts binary")
    shared = dealt.groupBy("block").applyInArrow(_shared(blocks), "bucket int, ids binary, labels binary, counts binary, pairs binary")
    members = materialise(shared.groupBy("bucket").applyInArrow(_sharing(percent), "doc_id long, label long, pairs binary"), "sharing")
    rare = materialise(members.mapInArrow(_rarest(percent), "meet long, doc_id long, label long, place int"), "rare")
    links = _links(members, rare, percent)
    # copies: every document of a class stands for its smallest doc_id
    some = described.where("n_shingles > 0")
    classes = materialise(some.groupBy("n_shingles", "set1", "set2").agg(F.min("doc_id").alias("head")), "classes")
    headed = materialise(some.join(classes, ["n_shingles", "set1", "set2"]).select("doc_id", "n_shingles", "head"), "headed")
    heads = headed.where("doc_id <> head").select("doc_id", "head").distinct()
    ends = links.join(heads.select(F.col("doc_id").alias("a"), F.col("head").alias("x")), "a", "left").join(heads.select(F.col("doc_id").alias("b"), F.col("head").alias("y")), "b", "left")
    # a document with several texts links their classes
    several = headed.groupBy("doc_id").agg(F.min("head").alias("a"), F.max("head").alias("z")).where("a <> z").drop("z")
    joined = headed.join(several, "doc_id").where("head <> a").select("a", F.col("head").alias("b")).distinct()
    found = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).unionByName(joined))
    linked = headed.join(found.withColumnRenamed("node", "head"), "head", "left").select("doc_id", "n_shingles", F.coalesce("component", "head").alias("component_id"))
    alone = described.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
