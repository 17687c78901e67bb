"""Spelling variants: frequent words take in the rare words one letter away.

Two words one edit apart have letter multisets that differ in at most two places.  Seen as binary
vectors (one dimension per letter and repetition) that is a Hamming distance of at most two, which
PartEnum turns into equality: deal the dimensions into four parts; two differing places touch at most two
parts, so the vectors agree on one of the six pairs of parts.  A word has a signature per pair of parts,
and an equi-join of signatures meets every near pair.  As one edit also leaves either the first or the last
three letters whole, a signature carries one of the two; buckets stay small.  Whatever meets is verified
inside the join, so only near pairs leave it.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, materialize
from .words import mix

RUN = "[A-Za-zÀ-ÿ]"
LENGTH, OCCURRENCES, PARTS, END, TIMES, TYPOS = 7, 2, 4, 3, 10, 31


def occurrences(docs: DataFrame, length: int = LENGTH, typos: int = TYPOS) -> DataFrame:
    """``word`` of each run of letters with at least ``length`` code points, A-Z in lower case.

    Where ``typos`` divides the CRC-32 of ``<doc_id>:<run>``, one code point of the run is left out; a row without
    an id keeps its runs.
    """
    runs = id_and_text(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{length},}}"), F.lit(0))).alias("run")) \
        .withColumn("run", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    code = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("code") % F.length("run")).cast("int")
    left = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("code") % typos == 0, left).otherwise(F.col("run"))
    return runs.withColumn("code", code).select(word.alias("word")).where(F.length("word") >= length)


def vocabulary(words: DataFrame, least: int = OCCURRENCES) -> DataFrame:
    """``word, n`` of the words with at least ``least`` occurrences."""
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def signature_array(words: list[str], parts: int = PARTS, end: int = END) -> np.ndarray:
    """One row per word: for each choice of ``parts - 2`` parts, and each of first and last letters, a 64-bit signature."""
    size = np.array([len(w) for w in words], np.int64)
    letter = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    weights = np.zeros((2, len(words)), np.uint64)
    for k in range(end):  # the order of letters at the ends counts, elsewhere only how many there are
        weights[0] = mix(weights[0] ^ letter[first + k])
        weights[1] = mix(weights[1] ^ letter[first + size - end + k])
    order = np.lexsort((letter, row))
    letter, row = letter[order], row[order]
    fresh = np.ones(len(letter), bool)
    fresh[1:] = (letter[1:] != letter[:-1]) | (row[1:] != row[:-1])
    place = np.arange(len(letter))
    repeat = place - np.maximum.accumulate(np.where(fresh, place, 0))
    dimension = mix(letter << np.uint64(32) | repeat.astype(np.uint64))
    part = (dimension >> np.uint64(40)) % np.uint64(parts)
    sums = [np.add.reduceat(np.where(part == p, mix(dimension), np.uint64(0)), first) for p in range(parts)] if len(words) else []
    out = np.empty((len(words), 2 * len(list(combinations(range(parts), parts - 2)))), np.uint64)
    for k, kept in enumerate(combinations(range(parts), parts - 2)):
        for e in range(2):
            out[:, 2 * k + e] = mix(sum(mix(sums[p] + np.uint64(p)) for p in kept) ^ weights[e] ^ np.uint64(2 * k + e + 1)) if len(words) else 0
    return out.view(np.int64)


def signatures(vocab: DataFrame, parts: int = PARTS, end: int = END) -> DataFrame:
    """``signature, word, n``: every word under each of its signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = signature_array(batch.column("word").to_pylist(), parts, end)
                again = pa.array(np.repeat(np.arange(len(found)), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), batch.column("word").take(again), batch.column("n").take(again)],
                                                 ["signature", "word", "n"])
    return vocab.select("word", "n").mapInArrow(run, "signature long, word string, n long")


def one_edit(a: str, b: str) -> Column:
    """Whether two different words differ by one inserted, deleted or replaced code point."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(F.col(a), F.col(b), 1) == 1)


def near_pairs(vocab: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b`` of the words one edit apart, each pair once.

    Signatures meet in a plain equi-join that verifies inside, so what leaves it are near pairs; adaptive execution
    splits a signature that very many words share.
    """
    found = materialize(signatures(vocab), "signatures")
    a = found.select("signature", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = found.select("signature", F.col("word").alias("b"), F.col("n").alias("n_b"))
    met = a.join(b, (a.signature == b.signature) & (F.col("a") < F.col("b")) & one_edit("a", "b"))
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for every word with a form, by doubling: each round looks the reached word's own form up.

    A form is ``times`` as frequent as its word, so chains are short: about as many rounds as the logarithm of the
    number of digits of the largest count.
    """
    reached = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = materialize(stepped, "forms")
        reached = stepped.select("word", "root")
        if not stepped.where("moved").head(1):
            return reached


def spelling_groups(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id, text``).

    A word's form is its most frequent near word (of equals the first in code-point order) if that occurs at least
    ``times`` as often; its root is where the forms lead.  Null and empty texts have no words, repeated rows count
    again, a run of letters of any length is one word, an empty table gives no rows, and further columns of the table
    are not looked at.
    """
    vocab = materialize(vocabulary(occurrences(docs)), "vocabulary")
    pairs = materialize(near_pairs(vocab), "near")
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")) \
        .unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), F.col("other"))).alias("best"))
    told = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.col1") >= times * F.col("n"), F.struct(F.col("best.other").alias("form"), (-F.col("best.col1")).alias("form_n"))).alias("of"))
    told = materialize(told.select("word", "n", "n_near", "of.form", "of.form_n"), "words")
    return told.join(roots(told.where("form is not null")), "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
