"""Near duplicates: SimHash fingerprints, met through fuzzy Golay keys.

A 64-bit fingerprint is cut into three segments of at most 23 bits.  The perfect
Golay code decodes any 23 bits to the one codeword within three bits, whose index
has 12 bits.  Two fingerprints that differ in four bits or fewer have a pair of
segments with two differences or fewer (pigeonhole), so a point with at most one
difference from each lies between them.  A fingerprint's keys are, for each pair
of segments, the codeword indices of all points within one bit: about ten
different ones instead of 44 points.  Equal keys meet; the distance is then checked.

Equal fingerprints are one node, so copies cost nothing.  A bucket emits the links
of a spanning forest, never all its pairs, and a bucket of more than ``BLOCK``
fingerprints is compared in pairs of blocks by several tasks.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, id_and_text, materialize, partitions, skew_join, unused
from .words import mix

BITS, SIZE = 4, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
BLOCK = 4096
SMALL = 3
FEW = 256  # rows of a bucket up to which each row's partners are looked for at once
_GENERATOR = 0b101011100011  # of the (23, 12) Golay code


def _remainder(x: int) -> int:
    for at in range(22, 10, -1):
        if x >> at & 1:
            x ^= _GENERATOR << at - 11
    return x


def _tables():
    """Syndromes of each byte's values, and the error pattern of each syndrome."""
    column = [_remainder(1 << k) for k in range(24)]
    syndromes = np.zeros((3, 256), np.int32)
    for byte in range(3):
        for value in range(256):
            for k in range(8):
                if value >> k & 1 and 8 * byte + k < 23:
                    syndromes[byte, value] ^= column[8 * byte + k]
    errors = np.zeros(2048, np.int32)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):  # equal places: fewer errors
                pattern = 1 << a | 1 << b | 1 << c
                errors[_remainder(pattern)] = pattern
    return syndromes, errors


SYNDROMES, ERRORS = _tables()


def codeword_index(x: np.ndarray) -> np.ndarray:
    """Index of the nearest codeword of each 23-bit number."""
    syndrome = SYNDROMES[0, x & 255] ^ SYNDROMES[1, x >> 8 & 255] ^ SYNDROMES[2, x >> 16]
    return (x ^ ERRORS[syndrome]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distinct keys (pair and two codeword indices, 26 bits) of each fingerprint."""
    near = []
    for low, size in SEGMENTS:
        own = (prints >> np.uint64(low)).astype(np.int64) & (1 << size) - 1
        near.append(codeword_index(own[:, None] ^ np.array([0, *(1 << k for k in range(size))])))
    keys = []
    for number, (a, b) in enumerate(PAIRS):
        both = np.concatenate([near[a] << 12 | near[b][:, :1], near[a][:, :1] << 12 | near[b]], axis=1)
        keys.append(number << 24 | both)
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    fresh = np.ones(keys.shape, bool)
    fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(fresh)[0], keys[fresh]


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words; of all words if they are fewer."""
    words = text.encode().lower().split()  # bytes: A-Z only; splits at space and 09-0D
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)] if words else []
    return np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo:lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SIZE, count: int = 1, more: int | None = None) -> DataFrame:
    """``doc_id, prints array<long>, digest binary`` (SHA-256) of whole texts.  The first is over the hashes
    themselves, further ones over independent permutations of them.  With ``more``, the plain
    fingerprint of shingles of so many words follows."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out, digests = [], []
            for text in b.column("text"):
                text = text.as_py() or ""
                h = shingle_hashes(text, size)
                digests.append(hashlib.sha256(text.encode()).digest())
                prints = [fingerprint(mix(h ^ np.uint64(k)) if k else h) for k in range(count)]
                if more is not None:
                    prints.append(fingerprint(shingle_hashes(text, more)))
                out.append([np.uint64(p).astype(np.int64) for p in prints])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.int64())), pa.array(digests, pa.binary())],
                                             ["doc_id", "prints", "digest"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, prints array<long>, digest binary")


def _close(group: np.ndarray, prints: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of rows with equal group numbers (sorted): all pairs of small groups, a
    spanning forest of each larger one."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    left = np.flatnonzero(np.repeat(size <= SMALL, size))
    for step in range(1, SMALL):
        left = left[left + step < len(group)]
        left = left[group[left + step] == group[left]]
        if not left.size:
            break
        hit = left[np.bitwise_count(prints[left] ^ prints[left + step]) <= bits]
        yield prints[hit], prints[hit + step]
    for lo, n in zip(first[size > SMALL], size[size > SMALL]):
        own, tree = np.sort(prints[lo:lo + n]), np.arange(n)
        a, b = [], []
        for k in range(1, n):
            # Of each tree the smallest fingerprint in reach, so that many buckets name the same links.
            near = np.flatnonzero(np.bitwise_count(own[:k] ^ own[k]) <= bits)
            roots, at = np.unique(tree[near], return_index=True)
            if roots.size:
                a += [own[k]] * roots.size
                b += list(own[near[at]])
                tree[k] = roots[0]
                if roots.size > 1:
                    tree[:k][np.isin(tree[:k], roots)] = roots[0]
        yield np.array(a, np.uint64), np.array(b, np.uint64)


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])


def compare_buckets(bits: int, columns: list[str]):
    """Arrow function over rows sorted by ``columns``: links ``a, b``, or for a bucket
    of over ``2 * BLOCK`` rows just its key and size."""
    def links(group, prints):
        for a, b in _close(group, prints, bits):
            if a.size:
                none = pa.nulls(a.size, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), none, none], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]):
        kept, prints, large = [np.zeros(0, np.int64) for _ in columns], np.zeros(0, np.uint64), 0
        for batch in batches:
            cols = [np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, columns)]
            prints = np.concatenate([prints, batch.column("print").to_numpy().view(np.uint64)])
            if not len(prints):
                continue
            change = np.zeros(len(prints), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            group = np.cumsum(change)
            last = int(np.searchsorted(group, group[-1]))  # the last bucket may go on
            if last:
                start = 0
                if large:
                    start = int(np.searchsorted(group, 0, "right"))
                    yield pa.RecordBatch.from_pydict({"a": [None], "b": [None], "key": [int(cols[0][0])], "n": [large + start]}, _FOUND)
                    large = 0
                yield from links(group[start:last], prints[start:last])
            kept, prints = [c[last:] for c in cols], prints[last:]
            if len(prints) > 2 * BLOCK:  # too large for one comparison: only counted here
                large += len(prints) - 1
                kept, prints = [c[-1:] for c in kept], prints[-1:]
        if large:
            yield pa.RecordBatch.from_pydict({"a": [None], "b": [None], "key": [int(kept[0][0])], "n": [large + len(prints)]}, _FOUND)
        elif len(prints):
            yield from links(np.zeros(len(prints), np.int64), prints)
    return run


def near_links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Links ``a, b`` between distinct ``number, print`` rows at ``bits`` or fewer differing
    bits.  At four or fewer they are all that connectivity needs; beyond, those
    that share a key."""

    def keys(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                own = part.column("print").to_numpy().view(np.uint64)
                row, key = golay_keys(own)
                key |= part.column("number").to_numpy().astype(np.int64)[row] << 26
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row].view(np.int64))], ["key", "print"])
    entries = prints.select("number", "print").mapInArrow(keys, "key long, print long")
    found = "a long, b long, key long, n long"
    n = partitions(prints)
    first = materialize(entries.repartition(n, "key").sortWithinPartitions("key").mapInArrow(
        compare_buckets(bits, ["key"]), found), "buckets")
    links = first.where("a is not null").select("a", "b")
    large = first.where("key is not null").select("key", F.ceil(F.col("n") * 2 / BLOCK).alias("blocks"))
    if not large.isEmpty():
        own = skew_join(entries, large, "key", ["print"], "inner").withColumn("_own", F.pmod(F.xxhash64("print"), "blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        pairs = own.withColumn("_other", other).select("key", F.least("_own", "_other").alias("i"),
                                                       F.greatest("_own", "_other").alias("j"), "print")
        split = pairs.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "print")
        links = links.unionByName(materialize(split.mapInArrow(compare_buckets(bits, ["key", "i", "j"]), found), "blocks")
                                  .select("a", "b"))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def share_of_bits(similarity: float) -> float:
    """The share of differing bits to expect of two sets with a Jaccard similarity."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def members(bits: int):
    """Arrow function over rows ``key, node, print`` sorted by key: ``key, node`` of the rows with another
    within ``bits`` in their bucket, and of all rows of a bucket of over ``FEW``."""
    def out(key, node):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], ["key", "node"])

    def paired(key, node, own):
        hit, left = np.zeros(len(key), bool), np.arange(len(key))
        for step in range(1, len(key)):
            left = left[left + step < len(key)]
            left = left[key[left + step] == key[left]]
            if not left.size:
                break
            near = left[np.bitwise_count(own[left] ^ own[left + step]) <= bits]
            hit[near] = hit[near + step] = True
        return out(key[hit], node[hit])

    def run(batches: Iterator[pa.RecordBatch]):
        kept, large = [np.zeros(0, np.int64)] * 3, None
        for batch in batches:
            rows = [np.concatenate([k, batch.column(c).to_numpy()]) for k, c in zip(kept, ("key", "node", "print"))]
            if large is not None:
                n = int(np.searchsorted(rows[0], large, "right"))
                yield out(rows[0][:n], rows[1][:n])
                rows = [r[n:] for r in rows]
            if not len(rows[0]):
                kept = rows
                continue
            large, last = None, int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on
            yield paired(*(r[:last] for r in rows))
            kept = [r[last:] for r in rows]
            if len(kept[0]) > FEW:
                yield out(kept[0], kept[1])
                large, kept = int(kept[0][0]), [r[:0] for r in kept]
        yield paired(*kept)
    return run


def verified_forest(own: np.ndarray, prints: np.ndarray, bits: int, most: int) -> tuple[list[int], list[int]]:
    """Links (places) of a spanning forest over the rows within ``bits`` of each other in
    ``own`` and within ``most`` in all ``prints``.  Only such pairs join a tree, so nothing is lost."""
    left, a, b = np.arange(len(own)), [], []
    while left.size > 1:
        reached, left = [left[0]], left[1:]
        for at in reached:  # grows meanwhile
            if not left.size:
                break
            near = np.flatnonzero(np.bitwise_count(own[left] ^ own[at]) <= bits)
            near = near[np.bitwise_count(prints[left[near]] ^ prints[at]).sum(1) <= most]
            found = left[near]
            a += [at] * found.size
            b += found.tolist()
            reached += found.tolist()
            left = np.delete(left, near)
    return a, b


def verify_buckets(bits: int, most: int, columns: list[str]):
    """Arrow function over rows ``key, node, prints`` sorted by ``columns``: links ``a, b`` of nodes."""
    def links(node, prints, number):
        a, b = verified_forest(prints[:, number], prints, bits, most)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]):
        cols, node, prints = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in (*columns, "node")]
            values = batch.column("prints").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
            if cols is None:
                *cols, node = new
                prints = values
            else:
                *cols, node = [np.concatenate([k, x]) for k, x in zip((*cols, node), new)]
                prints = np.concatenate([prints, values])
            change = np.zeros(len(node), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            first = np.r_[0, np.flatnonzero(change)]
            for lo, hi in zip(first[:-1], first[1:]):
                yield links(node[lo:hi], prints[lo:hi], int(cols[0][lo]) >> 26)
            cols, node, prints = [c[first[-1]:] for c in cols], node[first[-1]:], prints[first[-1]:]
        if cols is not None:
            yield links(node, prints, int(cols[0][0]) >> 26)
    return run


def verified_links(nodes: DataFrame, bits: int, most: int) -> DataFrame:
    """Links ``a, b`` between rows ``node, prints`` that share a key of a fingerprint within ``bits``
    there and differ in at most ``most`` bits of all their fingerprints: of each bucket a spanning
    forest of the pairs that pass, so that the links tie all that such pairs tie."""
    def keys(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                node = part.column("node").to_numpy()
                prints = part.column("prints").flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
                for number in range(prints.shape[1]):
                    row, key = golay_keys(prints[:, number])
                    yield pa.RecordBatch.from_arrays([pa.array(key | number << 26), pa.array(node[row]),
                                                      pa.array(prints[row, number].view(np.int64))], ["key", "node", "print"])
    n = partitions(nodes)
    entries = nodes.select("node", "prints").mapInArrow(keys, "key long, node long, print long")
    # Most entries meet nothing; only those that do carry all their fingerprints.
    met = materialize(entries.repartition(n, "key").sortWithinPartitions("key").mapInArrow(members(bits), "key long, node long"), "members")
    large = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK) \
        .select("key", F.ceil(F.col("n") * 2 / BLOCK).alias("blocks"))
    large = materialize(large, "large")
    of_nodes = nodes.select("node", "prints")
    if large.isEmpty():
        whole, split = met, None
    else:
        whole = met.join(large, "key", "left_anti")
        split = skew_join(met, large, "key", ["node"], "inner").withColumn("_own", F.pmod(F.xxhash64("node"), "blocks"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        split = split.withColumn("_other", other).select("key", F.least("_own", "_other").alias("i"),
                                                         F.greatest("_own", "_other").alias("j"), "node")
    links = whole.join(of_nodes, "node").repartition(n, "key").sortWithinPartitions("key", "node") \
        .mapInArrow(verify_buckets(bits, most, ["key"]), "a long, b long")
    if split is not None:
        links = links.unionByName(split.join(of_nodes, "node").repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
                                  .mapInArrow(verify_buckets(bits, most, ["key", "i", "j"]), "a long, b long"))
    return materialize(links.distinct(), "verified")


def _unverified(nodes: DataFrame, bits: int, shared: bool) -> DataFrame:
    """Links ``a, b`` of nodes with a fingerprint within ``bits``; ``shared``: nodes may have one in common."""
    each = nodes.select("node", F.posexplode("prints").alias("number", "print"))
    distinct = materialize(each.groupBy("number", "print").agg(F.min("node").alias("first")), "distinct")
    near = near_links(distinct, bits)
    firsts = distinct.groupBy("print").agg(F.min("first").alias("first")) if shared else distinct
    links = near.join(firsts.select(F.col("print").alias("a"), F.col("first").alias("x")), "a") \
        .join(firsts.select(F.col("print").alias("b"), F.col("first").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if shared:
        same = skew_join(each, distinct.withColumnRenamed("number", "_number"), "print", ["node"], "inner") \
            .where("number = _number and node != first").select(F.col("node").alias("a"), F.col("first").alias("b"))
        links = links.unionByName(same)
    return links


def _roots(rows: DataFrame, bits: int, count: int, similarity: float | None, more: bool = False) -> DataFrame:
    """``prints, doc_id`` (the smallest), ``root`` (a number of its class) of each distinct ``prints``.
    ``more``: after the ``count`` fingerprints one follows that links by itself, at ``BITS`` or fewer."""
    nodes = rows.groupBy("prints").agg(F.min("doc_id").alias("doc_id"))
    # A node's number: its place in the written table.
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    own = nodes.select("node", F.slice("prints", 1, count).alias("prints")) if more else nodes
    if similarity is not None:
        links = verified_links(own, bits, int(share_of_bits(similarity) * 64 * count))
    else:
        links = _unverified(own, bits, more or count > 1)
    if more:
        links = links.unionByName(_unverified(nodes.select("node", F.slice("prints", count + 1, 1).alias("prints")), BITS, True))
    tied = nodes.join(components(links), "node", "left").select("prints", "doc_id", F.coalesce("component", "node").alias("root"))
    return materialize(tied, "tied")


def near_duplicate_classes(docs: DataFrame, size: int = SIZE, count: int = 1, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """One row per input row: ``doc_id, prints, component_id`` (the smallest id reachable).

    Two documents are linked when a fingerprint of theirs is within ``bits``.
    With ``similarity``, all ``count`` fingerprints together must also differ in no
    more bits than sets of that Jaccard similarity do on average, which is tested
    inside the buckets, before links are chosen; ``bits`` may then be above four,
    where the keys find a part of the pairs.  A text without words has the fingerprint zero and is linked like any
    other.  Repeated rows share their class; rows without an id take part, and a
    class of such rows alone has no component id.  An empty table gives none.
    """
    rows = materialize(fingerprints(docs, size, count).drop("digest"), "prints")
    tied = _roots(rows, bits, count, similarity)
    lowest = tied.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = skew_join(tied, lowest, "root", ["prints"], "inner").select("prints", "component_id")
    return skew_join(rows, classes, "prints", ["doc_id"], "inner").select("doc_id", "prints", "component_id")


def drop_near(docs: DataFrame, size: int = 5, count: int = 8, bits: int = 10, similarity: float = 0.8) -> DataFrame:
    """The documents with one row of each near-duplicate class, the smallest id: columns as they came.

    Two documents are linked when their fingerprints of four-word shingles are within four bits, as in
    ``near_duplicate_classes``: all such links count.  ``count`` fingerprints of ``size``-word shingles add
    links of texts that differ more: those that share a key and pass the test on all bits.
    A row is known by its id and text: an id with two texts is two documents, of
    which one class keeps one.  Rows without an id stay.
    """
    rows = materialize(fingerprints(docs, size, count, SIZE), "prints")
    tied = _roots(rows, bits, count, similarity, more=True)
    own = skew_join(rows.where("doc_id is not null").distinct(), tied.select("prints", "root"), "prints", ["doc_id", "digest"], "inner") \
        .select("doc_id", "digest", "root")
    own = materialize(own, "documents")
    keep = own.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("keep"))
    lost = skew_join(own, keep, "root", ["doc_id", "digest"], "inner").where(F.struct("doc_id", "digest") != F.col("keep"))
    name = unused(docs, "_sha256")
    lost = lost.select("doc_id", F.lower(F.hex("digest")).alias(name))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.withColumn(name, F.sha2(text, 256)).join(lost, ["doc_id", name], "left_anti").select(docs.columns)
