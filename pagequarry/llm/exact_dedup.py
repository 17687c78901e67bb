"""Exact duplicates by a cuckoo-filter index of live digests.

The index is split into shards by digest.  A shard is a cuckoo filter plus its
content: the live digests with, for each, the row that stays and the number of
rows.  The filter answers "surely new" without a look at the content; only hits
are compared with it.  Filters support deletion.  A filter that overflows is
rebuilt at twice the size from the digests stored beside it.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Rows without an id count as copies and lose to any row with one.
"""

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize, partitions, skew_join, unused

SLOTS = 4
MAX_KICKS = 200


class CuckooFilter:
    """Cuckoo filter over 64-bit keys: 16-bit fingerprints, four to a bucket."""

    def __init__(self, buckets: int = 256, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.rows = len(self.table)  # a power of two

    def places(self, key: int) -> tuple[int, int, int]:
        """Fingerprint and its two buckets; each bucket follows from the other and the fingerprint."""
        mark = (key >> 48 & 0xFFFF) or 1
        one = key & self.rows - 1
        return mark, one, self.other(one, mark)

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ mark * 0x5BD1E995) & self.rows - 1

    def may_contain(self, key: int) -> bool:
        mark, one, two = self.places(key)
        return mark in self.table[one] or mark in self.table[two]

    def insert(self, key: int) -> bool:
        """False when no place was found; the caller then resizes."""
        mark, one, two = self.places(key)
        for bucket in (one, two):
            free = np.flatnonzero(self.table[bucket] == 0)
            if free.size:
                self.table[bucket, free[0]] = mark
                return True
        bucket = one
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self.other(bucket, mark)
            free = np.flatnonzero(self.table[bucket] == 0)
            if free.size:
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: int) -> bool:
        """Takes one copy of a key's fingerprint out.  Only for keys known to be stored."""
        mark, one, two = self.places(key)
        for bucket in (one, two):
            held = np.flatnonzero(self.table[bucket] == mark)
            if held.size:
                self.table[bucket, held[0]] = 0
                return True
        return False

    @classmethod
    def of(cls, keys, buckets: int = 256) -> "CuckooFilter":
        """A filter that holds the keys: doubled until they all fit."""
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys):
                return made
            buckets *= 2


class Shard:
    """One shard: a filter and the content ``digest -> [row that stays, rows]``."""

    def __init__(self):
        self.filter, self.content, self.passed = CuckooFilter(), {}, 0

    @staticmethod
    def key(digest: bytes) -> int:
        return int.from_bytes(digest[8:16], "little")

    def find(self, digest: bytes):
        """Content of a live digest: none if the filter says so, else by comparison."""
        if not self.filter.may_contain(self.key(digest)):
            self.passed += 1
            return None
        return self.content.get(digest)

    def add(self, digest: bytes, keep, rows: int) -> None:
        held = self.find(digest)
        if held is not None:
            held[0] = max((x for x in (held[0], keep) if x is not None), default=None)
            held[1] += rows
            return
        self.content[digest] = [keep, rows]
        if not self.filter.insert(self.key(digest)):
            self.filter = CuckooFilter.of(map(self.key, self.content), 2 * self.filter.rows)

    def remove(self, digest: bytes, rows: int) -> bool:
        """Takes rows of a digest out; the last one deletes it from filter and content."""
        held = self.find(digest)
        if held is None:
            return False
        held[1] -= rows
        if held[1] <= 0:
            del self.content[digest]
            self.filter.delete(self.key(digest))
        return True


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, digest``: SHA-256 of each normalised text, in one narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            low = pc.ascii_lower(pc.fill_null(b.column("text"), ""))
            sums = [hashlib.sha256(t.as_buffer() or b"").digest() for t in low.cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sums, pa.binary())], ["doc_id", "digest"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, digest binary")


def salted_counts(rows: DataFrame) -> DataFrame:
    """Rows of a digest, pre-aggregated per salt, so that a digest of a third of
    all rows reaches its shard as a few rows."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(partitions(rows)))
    return rows.groupBy("digest", salt.alias("salt")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))


_SHARD = "shard int, digest binary, keep_id long, group_size long, filter binary, live long"


def build_index(changes: DataFrame, shards: int | None = None) -> DataFrame:
    """The index of a stream of changes ``digest, keep_id, n, salt``: a negative ``n`` deletes rows.

    One row per live digest (``digest, keep_id, group_size``) and one per shard
    with its filter (``filter``, ``live`` digests), by ``shard``.
    """
    shards = shards or partitions(changes)
    placed = changes.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int")) \
        .repartition(shards, "shard").sortWithinPartitions("shard", F.desc("n"))

    def run(batches: Iterator[pa.RecordBatch]):
        def out(number, s):
            keys = list(s.content)
            for lo in range(0, len(keys), 10_000):
                part = keys[lo:lo + 10_000]
                yield pa.RecordBatch.from_pydict({
                    "shard": [number] * len(part), "digest": part, "keep_id": [s.content[k][0] for k in part],
                    "group_size": [s.content[k][1] for k in part], "filter": [None] * len(part),
                    "live": [None] * len(part)}, schema)
            yield pa.RecordBatch.from_pydict({
                "shard": [number], "digest": [None], "keep_id": [None], "group_size": [None],
                "filter": [s.filter.table.tobytes()], "live": [len(keys)]}, schema)
        schema = pa.schema([("shard", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()),
                            ("group_size", pa.int64()), ("filter", pa.binary()), ("live", pa.int64())])
        number, s = None, None
        for b in batches:
            for at, digest, keep, n in zip(*(b.column(c).to_pylist() for c in ("shard", "digest", "keep_id", "n"))):
                if at != number:
                    if s:
                        yield from out(number, s)
                    number, s = at, Shard()
                if n > 0:
                    s.add(digest, keep, n)
                else:
                    s.remove(digest, -n)
        if s:
            yield from out(number, s)
    return placed.select("shard", "digest", "keep_id", "n").mapInArrow(run, _SHARD)


def live_digests(index: DataFrame) -> DataFrame:
    return index.where("digest is not null").select("digest", "keep_id", "group_size")


def filters(index: DataFrame) -> DataFrame:
    return index.where("filter is not null").select("shard", "filter", "live")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays.  Repeated rows of one id
    and text count as rows of its group and share the answer; a group whose rows
    all lack an id keeps none (``keep_id`` null, ``kept`` false).  An empty table
    gives an empty result; further columns are ignored.
    """
    rows = materialize(digests(docs), "digests")
    index = materialize(build_index(salted_counts(rows)), "index")
    found = skew_join(rows, live_digests(index), "digest", ["doc_id"], "inner")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents with one row per text: columns as they came.

    A row is known by its id and text, so repeated rows are one document and an
    id with two texts is two.  Rows without an id stay, once per text.
    """
    digest = unused(docs, "_sha256")
    lost = exact_duplicates(docs).where("doc_id != keep_id").select("doc_id", F.col("text_sha256").alias(digest))
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    rest = docs.withColumn(digest, F.sha2(low, 256)).join(lost, ["doc_id", digest], "left_anti")
    return rest.dropDuplicates(["doc_id", digest]).select(docs.columns)
