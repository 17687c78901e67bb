"""Importance resampling: documents drawn by how much their hashed n-grams look like a target set's.

One pass pre-tokenises every text with a regex Split, which gives words as offsets; neighbouring
offset pairs are the word pairs.  Each feature's bucket is a CRC, and a document keeps its buckets as
packed numbers.  Everything after that reads only those: counts per bucket, gains, the mean gain of a
document.  Drawing is Gumbel top-k: noise that depends on the id alone is added to the weight, and the
highest scores are taken, ranked by a range partition so that no task sees all rows.
"""

from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crc
from .common import id_and_text, materialize
from .sharding import numbered
from .words import chunks

#: What stands between words, after lower-casing A-Z: all of ASCII but letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS, MIN_WORDS, SEED = 10_000, 20, 7
#: Share of the documents with enough words that is drawn: 25 of 100.
SHARE = (25, 100)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_offsets(split, raw: bytes) -> np.ndarray:
    """Byte offsets ``[start, end]`` of the words of a lower-cased text."""
    text = raw.decode()
    words = split.pre_tokenize_str(text)
    at = np.fromiter(chain.from_iterable(map(itemgetter(1), words)), np.int64, 2 * len(words))
    if len(text) != len(raw):  # offsets count code points
        codes = np.frombuffer(raw, np.uint8)
        at = np.append(np.flatnonzero((codes & 0xC0) != 0x80), len(raw))[at]
    return at.reshape(-1, 2)


def feature_buckets(split, texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each text, and the buckets of all features: words first, then pairs, text by text."""
    bodies = [(t.as_py() or "").encode().translate(_LOWER) for t in texts]
    base = np.cumsum([0, *map(len, bodies)])
    offsets = [word_offsets(split, b) + lo for b, lo in zip(bodies, base, strict=False)]
    n_words = np.array([len(o) for o in offsets], np.int64)
    start, end = np.concatenate([np.empty((0, 2), np.int64), *offsets]).T
    data = np.frombuffer(b"".join(bodies), np.uint8)
    single = crc.crcs(data, start, end)
    row = np.repeat(np.arange(len(n_words)), n_words)
    pair = np.flatnonzero(row[1:] == row[:-1])
    double = crc.joined_by_space(single[pair], single[pair + 1], data, start[pair + 1], end[pair + 1])
    order = np.argsort(np.concatenate([row, row[pair]]), kind="stable")
    n_features = n_words + np.maximum(n_words - 1, 0)
    return n_words, n_features, (np.concatenate([single, double]) % np.uint32(buckets))[order]


def hashed(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, features``: the buckets of a text's words and word pairs as packed numbers."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Regex, pre_tokenizers
        split = pre_tokenizers.Split(Regex(BETWEEN), "removed")
        for batch in batches:
            for part in chunks(batch, "text"):
                n_words, n_features, found = feature_buckets(split, part.column("text"), buckets)
                ends = np.concatenate([[0], np.cumsum(n_features)]) * int(kind[-1])
                packed = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(n_words), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found.astype(kind))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words), packed.cast(pa.binary())],
                                                 ["doc_id", "n_words", "features"])
    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, features binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how often each bucket occurs; every task sends one sum per bucket."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column("features"):
                n += np.bincount(np.frombuffer(value.as_buffer(), kind), minlength=buckets) if value.as_buffer().size else 0
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["bucket", "n"])
    return features.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Per bucket floor(1000 ln(share in the target / share in the source)), each count raised by one."""
    every = source.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left") \
        .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    total = source.agg(F.sum("n").alias("n")).select(F.coalesce("n", F.lit(0)).cast("double").alias("total_s")) \
        .join(target.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total_t")))
    gain = F.floor(1000 * F.log(((F.col("t") + 1) * (F.col("total_s") + buckets)) / ((F.col("s") + 1) * (F.col("total_t") + buckets))))
    return [r.gain for r in both.join(F.broadcast(total)).select("bucket", gain.alias("gain")).orderBy("bucket").collect()]


def weighed(features: DataFrame, gain: list[int]) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains of a document's features, 0 without any."""
    kind, gain = "<u2" if len(gain) <= 1 << 16 else "<u4", np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(v.as_buffer(), kind) for v in batch.column("features")]
            n = np.array([len(f) for f in found], np.int64)
            total = np.array([gain[f].sum() for f in found], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             ["doc_id", "n_words", "n_features", "weight"])
    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int) -> Column:
    """Noise in thousandths from the id alone; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(share)))


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS,
             seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row of ``docs`` (``doc_id, text``); drawn rows have a rank.

    Of the rows with at least ``min_words`` words, ``share[0] / share[1]`` (floored) are drawn: the highest scores, ties
    to smaller ids (null first), then to the greater weight.  A null or empty text has no features and the weight 0; rows
    that repeat are drawn one by one; an empty target leaves the smoothed counts; an empty table gives no rows.  Texts of
    any length are whole: a text becomes its buckets in one row.  Further columns of both tables are not looked at.
    """
    found = materialize(hashed(docs, buckets), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(hashed(target.select(F.lit(0).alias("doc_id"), "text"), buckets), buckets), buckets)
    scored = materialize(weighed(found, gain).withColumn("score", F.col("weight") + gumbel(seed)), "scored")
    enough = scored.where(F.col("n_words") >= min_words)
    take = enough.count() * share[0] // share[1]
    # The row's place tells equal rows apart, so that a range can end between them.
    order = [F.desc("score"), F.asc("doc_id"), F.desc("weight"), F.asc("_row")]
    placed = enough.withColumn("_row", F.monotonically_increasing_id())
    ranked = numbered(placed.repartitionByRange(*order).sortWithinPartitions(*order), "rank").drop("_row")
    drawn = ranked.withColumn("rank", F.when(F.col("rank") < take, F.col("rank") + 1))
    return drawn.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
