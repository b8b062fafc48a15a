"""What the operators of this subpackage share: shared folders, column picking and hashed words.

A word is hashed once for each Arrow batch that holds it, by a 64-bit hash of its bytes. Ranges of words are
hashed by doubling: the hash of 2k words mixes those of its halves, non-linearly, and a range of another
length mixes the two largest such windows that cover it. No range is a polynomial in its words, so texts built of
regular patterns meet no more often than others.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; texts are long, so this keeps a batch to some MB.
ARROW_ROWS = 1000
#: Bytes hashed at once.
CHUNK_BYTES = 1 << 21

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z only.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local session, whose tasks share its folders, may leave that unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/factloom"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def doc_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Only the key and the text (null: empty), whatever else the table carries."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(text: Column) -> Column:
    """A-Z in lower case; other texts than ASCII have their bytes read as Latin-1 first.

    Lower-casing Latin-1 moves the bytes 0xC0 to 0xDE up by 0x20. How many continuation bytes follow still tells
    which byte it was, so texts stay different unless only the case of A-Z differs.
    """
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1")))


def split_words(text: Column, between: str = " \t\n\x0b\f\r", lower: bool = False) -> Column:
    """The words between the given ASCII characters, without regular expressions.

    With ``lower``, words are equal as their forms with A-Z in lower case are; they are to be
    compared, counted and hashed, not shown.
    """
    rest = between.replace(" ", "")
    if len(rest) > 8:
        upper, small = (_UPPER, _SMALL) if lower else ("", "")
        spaced = F.translate(text, upper + rest, small + " " * len(rest))
    else:
        spaced = _folded(text) if lower else text
        for c in rest:
            spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two ranges one after the other (or overlapping), from theirs."""
    return mix(mix(a + _LEFT) * _RIGHT + b)


@dataclass
class Words:
    """The words of some texts: byte range, hash, and first word of each text (one more at the end).

    ``distinct`` are the different words and ``codes`` which of them each word is.
    """

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    distinct: list[bytes]
    codes: np.ndarray
    _doubled: list[np.ndarray] = field(default_factory=list)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of ``size`` words inside one text, and their texts."""
        counts = np.maximum(np.diff(self.first) - size + 1, 0)
        text = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + self.first[text]
        return at, text

    def doubled(self, k: int) -> np.ndarray:
        """Hashes of the windows of 2**k words at every place."""
        if not self._doubled:
            self._doubled.append(self.hashes)
        while len(self._doubled) <= k:
            have, half = self._doubled[-1], 1 << (len(self._doubled) - 1)
            self._doubled.append(joined_hash(have[: max(len(have) - half, 0)], have[half:]))
        return self._doubled[k]

    def window_hash(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each start; windows of unlike sizes are not to be compared."""
        k = size.bit_length() - 1
        have = self.doubled(k)
        return have[starts] if size == 1 << k else joined_hash(have[starts], have[starts + (size - (1 << k))])


def _hash_each(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))


def words_of(texts: list[bytes], lower: bool = False, between: np.ndarray = _ASCII_SPACE) -> Words:
    """Words are runs of bytes other than ASCII white space (space, \\t to \\r), or than the bytes marked in ``between``."""
    data = b"\n".join([*texts, b""])
    if lower:
        data = data.translate(LOWER)
    raw = np.frombuffer(data, np.uint8)
    inside = ~between[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw[inside])])
    coded = packed.dictionary_encode()
    distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    return Words(data, starts, ends, _hash_each(distinct)[codes] if distinct else np.zeros(0, np.uint64), np.searchsorted(starts, offsets), distinct, codes)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches of about CHUNK_BYTES of text, or one longer text, with the texts as UTF-8."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()]
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and size + len(texts[to]) <= CHUNK_BYTES:
                size += len(texts[to])
                to += 1
            yield batch.slice(at, to - at), texts[at:to]
            at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
