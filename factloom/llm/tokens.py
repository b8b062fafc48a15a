"""Token-id output: fixed-width bit packing in blocks with offsets.

``write_token_files`` encodes every text and writes its ids in ascending doc_id order;
``read_tokens`` unpacks whole files, ``read_range`` and ``read_documents`` only the blocks that hold what is asked.

File format: Parquet rows, one for each block of whole documents.
``part`` and ``block`` order the blocks; ``first_token`` is the block's place in its part;
``bits`` is the width of an id, the fewest bits that hold the vocabulary; ``payload``
holds the ids one after another, least significant bit first, so id ``i`` of a
block is bits ``i * bits`` to ``(i + 1) * bits``; ``doc_ids`` and ``doc_starts`` say whose ids start where.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first; rows with the same
doc_id are kept, ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, column, doc_text, small_batches

BLOCK_TOKENS = 1 << 16
END_ID = 1
#: Pieces that an encoder remembers at most, and the longest of them.
CACHED, CACHED_CHARS = 1 << 19, 64

FILE_SCHEMA = "part int, block int, first_token long, n_tokens long, bits int, doc_ids array<bigint>, doc_starts array<bigint>, payload binary"


#: Fixed value: the normaliser and splitter of word_bpe_49k.json. White space becomes one space and is dropped, and no rule reaches across it.
SPACED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class _Known(dict):
    """Ids of remembered pieces; ``rest`` has those that only the texts at hand need."""

    rest: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        return self.rest[piece]


class Encoder:
    """Encodes with the tokenizers library, remembering the ids of whole pieces between spaces.

    Where the file's rules are those of ``SPACED``, a text's ids are those of its pieces one after another. The library
    encodes the pieces that are not known yet, joined by spaces, in one call; the ids' places say whose
    they are. A piece is looked up by its characters, never by a hash. With other rules whole texts go to the library.
    """

    cached = CACHED

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.vocabulary = self.whole.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spaced = all(spec.get(k) == v for k, v in SPACED.items()) and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec.get("added_tokens") or [])
        self.known = _Known({"": b""})

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; pieces hold no space and are not empty."""
        found = self.whole.encode(" ".join(pieces), add_special_tokens=False)
        begins = np.cumsum([0, *[len(p) + 1 for p in pieces[:-1]]])
        at = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
        cuts = np.searchsorted(np.searchsorted(begins, at, "right") - 1, np.arange(len(pieces) + 1)) * 4
        ids = np.array(found.ids, "<u4").tobytes()
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _encode_pieces(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = list(set().union(*split) - self.known.keys())
        own = dict(zip(new, self._ids_of(new), strict=True)) if new else {}
        room = self.cached - len(self.known)
        short = (p for p in new if len(p) <= CACHED_CHARS)
        self.known.update((p, own[p]) for p, _ in zip(short, range(room), strict=False))
        self.known.rest = {p: i for p, i in own.items() if p not in self.known}
        return [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), "<u4") for pieces in split]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text, as unsigned 32-bit integers."""
        if not self.spaced:
            return [np.array(x.ids, np.uint32) for x in self.whole.encode_batch(texts, add_special_tokens=False)]
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= CHUNK_BYTES:
                size += len(texts[to])
                to += 1
            out += self._encode_pieces(texts[at:to])
            at = to
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(texts: list[str | None], path: str, end_id: int) -> list[np.ndarray]:
    """Ids of each text (null: empty) with the end id."""
    return [np.append(ids, np.uint32(end_id)) for ids in encoder(path).encode_many([t or "" for t in texts])]


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits for each id, least significant first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = [np.packbits(((ids[at : at + 65536, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little") for at in range(0, len(ids), 65536)]
    return b"".join(x.tobytes() for x in out)


def unpack(payload: bytes, bits: int, start: int = 0, count: int | None = None) -> np.ndarray:
    """``count`` ids from id ``start``, reading only the bytes that hold them."""
    if count is None:
        count = len(payload) * 8 // bits - start
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8)[first : -(-(start + count) * bits // 8)]
    flat = np.unpackbits(raw, bitorder="little")[start * bits - first * 8 :][: count * bits]
    return flat.reshape(count, bits) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _blocks(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = max(1, (max(encoder(path).vocabulary, end_id + 1) - 1).bit_length())
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        owners: list[int | None] = []
        starts: list[int] = []
        held = 0

        def row() -> pa.RecordBatch:
            values = [[part], [block], [before], [held], [bits], [owners], [starts], [pack(np.concatenate(ids), bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["part", "block", "first_token", "n_tokens", "bits", "doc_ids", "doc_starts", "payload"])

        for batch in batches:
            for doc, own in zip(column(batch, "doc_id").to_pylist(), encoded(column(batch, "text").to_pylist(), path, end_id), strict=True):
                owners.append(doc)
                starts.append(held)
                ids.append(own)
                held += len(own)
                if held >= BLOCK_TOKENS:
                    yield row()
                    block, before, held = block + 1, before + held, 0
                    ids, owners, starts = [], [], []
        if owners:
            yield row()

    return run


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode every document and write the files; partitions follow doc_id, so blocks do as well."""
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = doc_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(tokenizer_path, end_id), FILE_SCHEMA).write.parquet(out_dir)


def read_blocks(spark: SparkSession, in_dir: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(in_dir)


def part_starts(blocks: DataFrame) -> dict[int, int]:
    """Ids before each part. One row for each written partition comes to the driver, without payloads."""
    totals = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    out, so_far = {}, 0
    for part in sorted(totals):
        out[part] = so_far
        so_far += totals[part]
    return out


def read_tokens(spark: SparkSession, in_dir: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids_crc32, ids."""
    blocks = read_blocks(spark, in_dir)
    base = part_starts(blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack(r["payload"], r["bits"], 0, r["n_tokens"])
                ends = [*r["doc_starts"][1:], r["n_tokens"]]
                own = [ids[a:b] for a, b in zip(r["doc_starts"], ends, strict=True)]
                at = base[r["part"]] + r["first_token"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array([at + s for s in r["doc_starts"]], pa.int64()),
                        pa.array([len(x) for x in own], pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                        pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def read_range(spark: SparkSession, in_dir: str, start: int, count: int) -> np.ndarray:
    """Random access: ids ``start`` to ``start + count`` of the whole stream; reads the blocks that overlap it."""
    blocks = read_blocks(spark, in_dir)
    base = part_starts(blocks)
    wanted = [p for p, s in base.items() if s < start + count]
    at = F.lit(0)
    for p in wanted:
        at = F.when(F.col("part") == p, F.lit(base[p])).otherwise(at)
    near = blocks.where(F.col("part").isin(wanted)).withColumn("at", at + F.col("first_token"))
    rows = near.where((F.col("at") < start + count) & (F.col("at") + F.col("n_tokens") > start)).orderBy("at").toLocalIterator()
    out = []
    for r in rows:
        a, b = max(start, r["at"]) - r["at"], min(start + count, r["at"] + r["n_tokens"]) - r["at"]
        out.append(unpack(bytes(r["payload"]), r["bits"], a, b - a))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
