"""WARC fixity audit with Merkle trees over ordered offset ranges.

Every record of an archive is hashed. The records of one range of ``RANGE_BYTES`` of the
archive, in offset order and with offset and length, make a leaf; each ``FANOUT`` neighbouring nodes make the
one above them, up to a root for each archive. Two replicas are compared from their roots: only below nodes that
differ are the next level's nodes looked at, and only in leaves that differ are single records
compared, so what agrees is never read below its root. Both replicas' trees are as high as the higher one, so an archive that only one has
is found from its root too. Ranges go by offset, so a lost record leaves its neighbours' nodes alone.

Defined results: an empty replica against a full one reports every record missing; two empty ones nothing; a null html is an empty
payload and a null url an empty address; pages with a null page_id form archive -1; pages with the same page_id are ordered by
address and content; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, materialise

#: Pages in an archive, bytes of a leaf's range, children of a node.
ARCHIVE_PAGES, RANGE_BYTES, FANOUT = 1000, 1 << 16, 8
DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC/1.1 resource record."""
    body = F.coalesce(html, F.lit(""))
    head = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    ]
    return F.concat(*head, body, F.lit("\r\n\r\n"))


def hashed_records(pages: DataFrame) -> DataFrame:
    """archive, offset, length, page_id, hash of each page's record. Only hashes and lengths are shuffled."""
    made = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("r"))
    archive = F.coalesce(F.floor(F.col("page_id") / ARCHIVE_PAGES), F.lit(-1)).cast("long")
    leaves = made.select(archive.alias("archive"), "page_id", "url", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("hash"))
    order = W.partitionBy("archive").orderBy("page_id", "url", "hash")
    before = F.sum("length").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("length")
    return leaves.select("archive", before.alias("offset"), "length", "page_id", "hash")


def _leaves(records: DataFrame) -> tuple[DataFrame, int]:
    """archive, level 0, node, hash of every range, and the highest node."""
    ranged = records.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).alias("node")).agg(F.array_sort(F.collect_list(F.struct("offset", "length", "hash"))).alias("children"))
    joined = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["offset"], c["length"], c["hash"])), "|")
    level = materialise(ranged.select("archive", F.lit(0).alias("level"), "node", F.sha2(joined, 256).alias("hash")), "tree")
    return level, level.agg(F.max("node")).first()[0] or 0


def _raised(level: DataFrame, top: int) -> DataFrame:
    """Leaves and all nodes above them, up to the level where node ``top`` is the first and only one."""
    out, k = level, 0
    while top > 0:
        k, top = k + 1, top // FANOUT
        up = level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("children"))
        joined = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["node"], c["hash"])), "|")
        level = materialise(up.select("archive", F.lit(k).alias("level"), "node", F.sha2(joined, 256).alias("hash")), "tree")
        out = out.unionByName(level)
    return out


def tree(records: DataFrame) -> DataFrame:
    """archive, level (0: ranges), node, hash: all nodes. records: archive, offset, length, hash."""
    return _raised(*_leaves(records))


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """archive, node of nodes that are not the same in both."""
    a, b = (x.select("archive", "node", F.col("hash").alias(n)) for x, n in ((left, "one"), (right, "other")))
    return a.join(b, ["archive", "node"], "full").where(~F.col("one").eqNullSafe(F.col("other"))).select("archive", "node")


def audit(sound: DataFrame, replica: DataFrame) -> DataFrame:
    """archive, offset, length, page_id, kind (changed, missing or extra) of every record that differs."""
    leaves = _leaves(sound), _leaves(replica)
    node = max(n for _, n in leaves)
    trees = [_raised(level, node) for level, _ in leaves]
    top, parents = 0, None
    while node > 0:
        top, node = top + 1, node // FANOUT
    for k in range(top, -1, -1):
        level = [t.where(F.col("level") == k) for t in trees]
        if parents is not None:
            level = [x.withColumn("up", F.floor(F.col("node") / FANOUT)).join(parents.select("archive", F.col("node").alias("up")), ["archive", "up"], "left_semi") for x in level]
        parents = materialise(_differing(*level), "differing")
    own = [x.withColumn("node", F.floor(F.col("offset") / RANGE_BYTES)).join(parents, ["archive", "node"], "left_semi") for x in (sound, replica)]
    names = ("length", "page_id", "hash")
    a, b = (x.select("archive", "offset", *[F.col(c).alias(f"{n}_{c}") for c in names]) for x, n in zip(own, ("one", "other"), strict=True))
    both = a.join(b, ["archive", "offset"], "full").where(~F.col("one_hash").eqNullSafe(F.col("other_hash")))
    kind = F.when(F.col("other_hash").isNull(), "missing").when(F.col("one_hash").isNull(), "extra").otherwise("changed")
    return both.select("archive", "offset", F.coalesce("one_length", "other_length").alias("length"), F.coalesce("one_page_id", "other_page_id").alias("page_id"), kind.alias("kind"))


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)
_START = re.compile(rb"WARC/1\.[01]\r\n")


def scan(data: bytes) -> Iterator[tuple[int, int, str | None, bytes | None]]:
    """offset, length, address and payload of the records of an uncompressed archive; address and payload are null for a stretch that
    is not a whole record. After damage the next head is looked for."""
    at = gap = 0
    while at < len(data):
        head = _HEAD.match(data, at)
        stop = None
        if head is not None:
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head[1].split(b"\r\n"))}
            size = fields.get(b"content-length", b"0")
            end = head.end() + int(size) if size.isdigit() else len(data) + 1
            if end <= len(data):
                stop = end + 4 if data[end : end + 4] == b"\r\n\r\n" else end
                # a record that ends amid bytes of no record has lost or gained some
                if stop == end and end < len(data) and not _START.match(data, end):
                    stop = None
        if stop is None:
            found = _START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if gap < at:
            yield gap, at - gap, None, None
        yield at, stop - at, fields.get(b"warc-target-uri", b"").decode("utf-8", "replace"), data[head.end() : end]
        at = gap = stop
    if gap < at:
        yield gap, at - gap, None, None


def parse(data: bytes) -> Iterator[tuple[int, int, str, bytes]]:
    """offset, length, address and payload of the whole records of an uncompressed archive."""
    return (x for x in scan(data) if x[3] is not None)


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(column(batch, "path").to_pylist(), column(batch, "content").to_pylist(), strict=True):
                plain = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for offset, length, url, payload in scan(plain):
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((name, offset, length, url, payload), kinds, strict=True)], names=["archive", "offset", "length", "url", "payload"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, offset long, length long, url string, payload binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """archive (file path), offset, length, url, payload of every whole record of WARC files (plain or gzip), one file to a task."""
    return _scanned(spark, path).where("payload is not null")


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """archive (file path), offset, length of every stretch of WARC files that is not a whole record."""
    return _scanned(spark, path).where("payload is null").select("archive", "offset", "length")
