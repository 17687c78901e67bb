"""Passages that a document with a smaller id has already: an FM-index per shard, and documents streamed against it.

Comparing every document with every shard would cost their product, so shards are cut by content.  A window
of words has an anchor, the smallest hash among its runs of four words.  Equal windows have equal anchors,
so a document meets only the shards of its own anchors, and only those anchors that a second document has.
What travels is a segment: the words of neighbouring windows with the same anchor.

1. ``anchors``: the anchors of all documents, once per document; those of two documents or more are live.
2. ``segments``: the segments of live anchors, with their words.  Equal segments are one row per shard, with the
   smallest id that has it, however many copies there are.
3. ``earlier_windows``: a shard builds the FM-index of its segments, streams them through it as patterns, and
   takes for each match of a whole window the smallest id in its interval.
4. The verdicts go back to the documents, which leave out what is covered.

An anchor may stand in very many different segments.  From ``hot`` on, its windows are segments of their own,
placed by the hash of all their words, so no shard grows with a frequent phrase.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize
from .fm_index import FMIndex
from .words import chunks, find_words, gather, hash_words, mix

WINDOW, GRAM = 13, 4
#: Windows of a segment at most, segments of an anchor from which it counts as hot, words of an index, and bytes
#: up to which a measured table is sent to all executors; results don't depend on them.
LONGEST, HOT, SHARD_WORDS, SMALL = 64, 10_000, 250_000, 64 << 20


def beside(left: DataFrame, right: DataFrame, on, how: str, size: Column, small: int = SMALL) -> DataFrame:
    """Join with a written table, sent to all executors if its measured bytes are few, else by shuffle.

    Its keys are unique or stand on the left of few rows each; a frequent key on the left is split by adaptive execution.
    """
    measured = right.agg(F.sum(size)).head()[0] or 0
    return left.join(F.broadcast(right) if measured <= small else right, on, how)


def windows(words, window: int, gram: int):
    """First word, row and anchor of every window, and the hashes of all words."""
    h = hash_words(words)
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), h
    grams = h[:len(h) - gram + 1].copy()
    for k in range(1, gram):
        grams = mix(grams * np.uint64(3) ^ h[k:len(h) - gram + 1 + k])
    smallest, width, span = grams, 1, window - gram + 1
    while width * 2 <= span:
        smallest = np.minimum(smallest[:-width], smallest[width:])
        width *= 2
    if width < span:
        smallest = np.minimum(smallest[:n], smallest[span - width:span - width + n])
    row = words.row
    at = np.flatnonzero(row[:n] == row[window - 1:])
    return at, row[at], smallest[at], h


def anchors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, key, anchor, times`` for rows of ``doc_id, key, text``: each anchor of a row, and its segments there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                _, row, anchor, _ = windows(find_words(part.column("text"), lower=False), window, gram)
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                row, anchor = row[fresh], anchor[fresh]
                order = np.lexsort((anchor, row))
                row, anchor = row[order], anchor[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]))) if len(row) else np.zeros(0, np.int64)
                take = pa.array(row[first])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(take), part.column("key").take(take), pa.array(anchor[first].view(np.int64)),
                     pa.array(np.diff(np.append(first, len(row))).astype(np.int32))], ["doc_id", "key", "anchor", "times"])
    return docs.mapInArrow(run, "doc_id long, key long, anchor long, times int")


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, longest: int = LONGEST) -> DataFrame:
    """``doc_id, key, start, n, anchor, words, seg`` of rows ``doc_id, key, text, live, hot`` (two lists of anchors):
    a segment has ``n`` windows from word ``start`` on; ``seg`` is a hash of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = find_words(part.column("text"), lower=False)
                at, row, anchor, h = windows(words, window, gram)
                of = {c: np.unique(part.column(c).flatten().to_numpy(zero_copy_only=False)).astype(np.int64).view(np.uint64) for c in ("live", "hot")}
                keep = np.isin(anchor, of["live"])
                at, row, anchor = at[keep], row[keep], anchor[keep]
                if not len(at):
                    continue
                hot = np.isin(anchor, of["hot"])
                for k in range(window):  # a hot anchor's windows go by all their words
                    anchor[hot] = mix(anchor[hot] * np.uint64(5) ^ h[at[hot] + k])
                fresh = np.ones(len(at), bool)
                fresh[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | hot[1:]
                place = np.arange(len(at))
                fresh |= (place - np.maximum.accumulate(np.where(fresh, place, 0))) % longest == 0
                first = np.flatnonzero(fresh)
                n = np.diff(np.append(first, len(at)))
                start, last = at[first], at[first] + n + window - 2
                data, bounds = gather(words.data, words.start, words.end, space=True)
                for some in np.array_split(np.arange(len(first)), len(first) // 50_000 + 1):
                    body, ends = gather(data, bounds[start[some]], bounds[last[some] + 1] - 1)
                    texts = pa.StringArray.from_buffers(len(some), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body))
                    owner = row[first[some]]
                    take = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").take(take), part.column("key").take(take), pa.array(start[some] - words.first[owner]), pa.array(n[some]),
                         pa.array(anchor[first[some]].view(np.int64)), texts], ["doc_id", "key", "start", "n", "anchor", "words"])
    return docs.mapInArrow(run, "doc_id long, key long, start long, n long, anchor long, words string").withColumn("seg", F.xxhash64("words"))


def matched(words: pa.Array, first: np.ndarray, window: int) -> list[list[dict]]:
    """Per segment the runs of windows that an earlier document has, as ``at, n``; ``first`` is the smallest id of each segment."""
    split = pc.split_pattern(words.cast(pa.large_string()), " ")
    encoded = split.flatten().dictionary_encode()
    flat = encoded.indices.to_numpy().astype(np.int64) + 1
    size = np.diff(split.offsets.to_numpy())
    begin = np.cumsum(size) - size
    symbols = np.zeros(len(flat) + len(size), np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    symbols[np.arange(len(flat)) + owner] = flat
    index = FMIndex(symbols, window)
    starts = index.classes(window)
    owners = np.repeat(np.arange(len(size)), size + 1)
    smallest = np.minimum.reduceat(first[owners[index.rows]], starts[:-1])
    length, row = index.matching_statistics(flat, begin, size)
    whole = np.flatnonzero(length == window)
    earlier = whole[smallest[index.class_of(row[whole], window)] < first[owner[whole]]]
    runs: list[list[dict]] = [[] for _ in size]
    if len(earlier):
        at, of = earlier - begin[owner[earlier]], owner[earlier]
        head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)))
        for k, n in zip(head, np.diff(np.append(head, len(at))), strict=True):
            runs[of[k]].append({"at": int(at[k]), "n": int(n)})
    return runs


def earlier_windows(found: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``anchor, seg, first, runs`` of segments ``anchor, seg, words, first``: the windows that stand in a document before ``first``.

    A task reads its anchors in order and cuts shards of about ``shard_words`` words between anchors.
    """
    def verdicts(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        words, first = rows.column("words").chunk(0), rows.column("first").to_numpy()
        runs = pa.array(matched(words, first, window), pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())])))
        return pa.RecordBatch.from_arrays([rows.column("anchor").chunk(0), rows.column("seg").chunk(0), pa.array(first), runs],
                                          ["anchor", "seg", "first", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += pc.sum(pc.binary_length(batch.column("words"))).as_py() // 6
            if count >= shard_words:
                table = pa.Table.from_batches(held)
                anchor = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last anchor may go on
                if cut:
                    yield verdicts(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                count = sum(pc.sum(pc.binary_length(b.column("words"))).as_py() // 6 for b in held)
        if held:
            yield verdicts(pa.Table.from_batches(held))
    return found.repartition("anchor").sortWithinPartitions("anchor") \
        .mapInArrow(run, "anchor long, seg long, first long, runs array<struct<at:long,n:long>>")


def kept_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of rows ``doc_id, text, covers`` (structs of first window and number of windows):
    the words that no window covers, joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words = find_words(part.column("text"), lower=False)
                total = len(words.start)
                covers = part.column("covers")
                owner = np.repeat(np.arange(len(covers)), pc.fill_null(pc.list_value_length(covers), 0).to_numpy(zero_copy_only=False))
                flat = covers.flatten()
                start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + words.first[owner]
                n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                change = np.zeros(total + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + n + window - 1, -1)
                stays = np.cumsum(change[:total]) == 0
                left = np.concatenate([[0], np.cumsum(stays)])[words.first]
                body, bounds = gather(words.data, words.start[stays], words.end[stays], space=True)
                lo, hi = bounds[left[:-1]], np.maximum(bounds[left[1:]] - 1, bounds[left[:-1]])
                kept = pa.array([bytes(body[a:b]).decode() for a, b in zip(lo, hi, strict=True)], pa.string())
                n_words = np.diff(words.first)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), pa.array(n_words - np.diff(left)), kept],
                                                 ["doc_id", "n_words", "n_removed", "kept"])
    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def drop_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, small: int = SMALL,
                 longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row of ``docs`` (``doc_id, text``).

    A word is removed if a window of ``window`` words covers it that also stands in a row with a smaller id.  Windows are
    judged on the input.  Rows with the same id do not remove from each other; a null id neither removes nor loses words; a
    null or empty text has no words; texts of any length are whole; an empty table gives no rows; further columns are not
    looked at.
    """
    rows = id_and_text(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    known = rows.where("doc_id is not null")
    placed = anchors(known, window, gram)  # read twice: cheaper than to keep
    live = placed.groupBy("anchor").agg(F.count("*").alias("docs"), F.sum("times").alias("times")).where("docs > 1")
    live = materialize(live.select("anchor", (F.col("times") >= hot).alias("hot")), "live")
    lists = beside(placed.select("key", "anchor"), live, "anchor", "inner", F.lit(24), small).groupBy("key") \
        .agg(F.collect_set("anchor").alias("live"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    lists = materialize(lists, "lists")
    size = 8 * (F.size("live") + F.size("hot")) + 48
    found = materialize(segments(beside(known, lists, "key", "inner", size, small), window, gram, longest), "segments", compression="zstd")
    distinct = found.groupBy("anchor", "seg", "words").agg(F.min("doc_id").alias("first"))
    told = materialize(earlier_windows(distinct, window, shard_words), "verdicts")
    # All windows of a segment stand in its first document; that one itself loses only what stands before it.
    met = found.select("doc_id", "key", "start", "n", "anchor", "seg").join(told, ["anchor", "seg"])
    covered = F.when(F.col("doc_id") > F.col("first"), F.array(F.struct("start", "n"))) \
        .otherwise(F.transform("runs", lambda r: F.struct((F.col("start") + r["at"]).alias("start"), r["n"].alias("n"))))
    covers = met.select("doc_id", "key", F.explode(covered).alias("cover")).groupBy("doc_id", "key").agg(F.collect_set("cover").alias("covers"))
    covers = materialize(covers, "covers")
    return kept_words(beside(rows, covers, ["doc_id", "key"], "left", 16 * F.size("covers") + 48, small).select("doc_id", "text", "covers"), window)
