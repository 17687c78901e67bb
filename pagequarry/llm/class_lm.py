"""Perplexity by a Brown class bigram model: exchange clustering, class transitions, word emissions.

Words are runs without ASCII white space, A-Z lower-cased; each text ends in an end
token, which also stands before its first word.  All words learned from get their
class by exchange clustering: the ``CORE`` most frequent ones move one at a time, on
their pair counts, until none gains, while any other word is in the class of its last
byte.  Then each other word moves to the class that makes the class bigrams likeliest,
by the same gain and from all its neighbours; a task weighs its share of the words.  A
word not learned from has the class that most words met once with its last byte have.

    log10 P(text) = sum of log10 P(class | class before) + log10 P(word | class)

Transitions are smoothed with the class frequencies, emissions by adding one, with
one more place for all unknown words of a class.

Words travel as 64-bit hashes.  Counts of all words are a table as large as the
corpus needs; the most frequent ones, at most ``HEAD``, are sent to the tasks, and all
others are joined.  Outside the head a word is rare in the texts learned from; in held-out
texts it may be as frequent as any, so their join is salted.
The core's pair counts are a square of fixed size; the other words' neighbours are a
table.  Each text is written once as the classes of its tokens, rare words' classes joined
in, from which transitions are counted and texts scored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_mod, materialize, partitions, skew_join, small_batches
from .words import chunks, find_words, hash_words

CORE, CLASSES, ENDINGS, HEAD, SWEEPS = 1000, 64, 16, 65_536, 6
PRIOR = 10.0  # weight of the class frequencies in a transition
END = np.uint64(1)  # hash of the end token
RARE = 65_535  # code of a token whose class is joined in
_FLUSH, _TOKENS, _ROWS = 250_000, 1_000_000, 8192


def _tokens(part: pa.RecordBatch):
    """Hashes, endings and rows of all tokens, each text's end token last, and tokens per text."""
    found = find_words(part.column("text"))
    n = part.num_rows
    size = np.diff(found.first) + 1
    ends = np.cumsum(size) - 1
    hashes, ending = np.full(ends[-1] + 1 if n else 0, END), np.zeros(ends[-1] + 1 if n else 0, np.int32)
    word = np.ones(len(hashes), bool)
    word[ends] = False
    hashes[word] = hash_words(found)
    ending[word] = found.data[found.end - 1] % ENDINGS
    return hashes, ending, np.repeat(np.arange(n), size), size


def count_words(docs: DataFrame) -> DataFrame:
    """``word, ending, n``: the count of each token, summed inside each task first."""
    def run(batches: Iterator[pa.RecordBatch]):
        known, sums, last = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int32)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(known.view(np.int64)), pa.array(last), pa.array(sums.astype(np.int64))],
                                              ["word", "ending", "n"])
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, ending, _, _ = _tokens(part)
                new, first, counts = np.unique(hashes, return_index=True, return_counts=True)
                joined, place, at = np.unique(np.concatenate([known, new]), return_index=True, return_inverse=True)
                total = np.bincount(at, np.concatenate([sums, counts]), len(joined))
                known, sums, last = joined, total, np.concatenate([last, ending[first]])[place]
                if len(known) > _FLUSH:
                    yield out()
                    known, sums, last = known[:0], sums[:0], last[:0]
        yield out()
    return docs.select("text").mapInArrow(run, "word long, ending int, n long") \
        .groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


def _units(hashes: np.ndarray, ending: np.ndarray, clustered: np.ndarray) -> np.ndarray:
    """A token's unit: its place among the clustered words (sorted), else its ending, else the end token."""
    at = np.minimum(np.searchsorted(clustered, hashes), max(0, len(clustered) - 1))
    own = clustered[at] == hashes if len(clustered) else np.zeros(len(hashes), bool)
    return np.where(own, at, np.where(hashes == END, len(clustered) + ENDINGS, len(clustered) + ending)).astype(np.int64)


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the most frequent words: all those of a count or none.

    The count where they end is found in the counts of counts, whose number grows with
    the square root of the tokens at most, so no task receives the words of all others."""
    held = counts.groupBy("n").agg(F.count("*").alias("words"))
    above = held.withColumn("total", F.sum("words").over(Window.orderBy(F.desc("n"))))
    cut = above.where(F.col("total") <= most).agg(F.min("n")).first()[0]
    return counts.where(F.col("n") >= cut) if cut is not None else counts.limit(0)


def count_pairs(docs: DataFrame, clustered: np.ndarray) -> np.ndarray:
    """How often each unit follows each: summed inside each task, then over tasks; a matrix of fixed size."""
    side = len(clustered) + ENDINGS + 1

    def run(batches: Iterator[pa.RecordBatch]):
        sums = np.zeros(side * side, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, ending, _, _ = _tokens(part)
                if len(hashes):
                    units = _units(hashes, ending, clustered)
                    before = np.concatenate([[side - 1], units[:-1]])
                    key, n = np.unique(before * side + units, return_counts=True)
                    sums[key] += n
        key = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sums[key])], ["pair", "n"])
    pairs = docs.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(side * side, np.int64)
    out[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    return out.reshape(side, side)


def _xlogx(x):
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit.  Words (the first units) start by frequency and move, one at
    a time, to the class that makes the class bigrams likeliest, until a sweep moves
    none.  Further units keep a class of their own."""
    units = len(pairs)
    total = classes + units - words
    of = np.concatenate([np.argsort(np.argsort(-pairs[:words].sum(1), kind="stable"), kind="stable") % classes,
                         classes + np.arange(units - words)])
    onto = np.zeros((units, total))
    onto[np.arange(units), of] = 1
    right, left = pairs @ onto, pairs.T @ onto  # counts of each unit with each class after and before it
    grid = onto.T @ right
    count, after = pairs.sum(1), pairs.sum(0)
    rows, cols = onto.T @ count, onto.T @ after
    own = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            was, loop = of[w], pairs[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[was] -= loop  # pairs of the word with itself go where it goes
            c[was] -= loop
            grid[was] -= r
            grid[:, was] -= c
            grid[was, was] -= loop
            rows[was] -= count[w]
            cols[was] -= after[w]
            across, down = grid[:classes], grid[:, :classes].T
            gain = (_xlogx(across + r) - _xlogx(across)).sum(1) + (_xlogx(down + c) - _xlogx(down)).sum(1)
            corner = grid[own, own]
            gain += _xlogx(corner + r[own] + c[own] + loop) + _xlogx(corner) - _xlogx(corner + r[own]) - _xlogx(corner + c[own])
            gain -= _xlogx(rows[:classes] + count[w]) - _xlogx(rows[:classes]) + _xlogx(cols[:classes] + after[w]) - _xlogx(cols[:classes])
            now = int(np.argmax(gain)) if gain.max() > gain[was] + 1e-9 else was
            grid[now] += r
            grid[:, now] += c
            grid[now, now] += loop
            rows[now] += count[w]
            cols[now] += after[w]
            if now != was:
                of[w], moved = now, moved + 1
                right[:, was] -= pairs[:, w]
                right[:, now] += pairs[:, w]
                left[:, was] -= pairs[w]
                left[:, now] += pairs[w]
        if not moved:
            break
    return of


def contexts(docs: DataFrame, clustered: np.ndarray, of: np.ndarray) -> DataFrame:
    """``word, ending, seen``: the neighbours' classes of each word that is not clustered, counted in runs of a task's
    tokens.  An item is ``n * width + code``: the class after the word, the number of classes if that is
    the word itself, or beyond it the class before it."""
    size = int(of[-1]) + 1
    width = 2 * size + 1

    def rows(hashes, ending, codes):
        words, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        place = place.astype(np.int64) * width
        after, before = codes
        key, n = np.unique(np.concatenate([place + after, (place + before)[before >= 0]]), return_counts=True)
        ends = np.searchsorted(key, np.arange(len(words) + 1) * width)
        seen = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(n * width + key % width, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(ending[first]), seen], ["word", "ending", "seen"])

    def run(batches: Iterator[pa.RecordBatch]):
        kept, n = [], 0
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, ending, _, _ = _tokens(part)
                units = _units(hashes, ending, clustered)
                kind = of[units]
                own = np.flatnonzero((units >= len(clustered)) & (hashes != END))  # each has a token after it
                twice = hashes[own] == hashes[own + 1]
                again = (hashes[own] == hashes[own - 1]) & (own > 0)
                before = np.where(own > 0, kind[own - 1], size - 1)
                kept.append((hashes[own], ending[own], np.where(twice, size, kind[own + 1]), np.where(again, -1, size + 1 + before)))
                n += len(own)
                if n > _TOKENS:
                    hashes, ending, *codes = map(np.concatenate, zip(*kept))
                    yield rows(hashes, ending, codes)
                    kept, n = [], 0
        if n:
            hashes, ending, *codes = map(np.concatenate, zip(*kept))
            yield rows(hashes, ending, codes)
    return docs.select("text").mapInArrow(run, "word long, ending int, seen array<int>")


def best_classes(word, ending, seen, grid: np.ndarray, classes: int):
    """Count and best class of each word, from its neighbours' classes (``contexts``, one list a
    word): the gain of ``exchange`` for leaving the class of its ending for each of ``classes``."""
    size, own = len(grid), np.arange(classes)
    width = 2 * size + 1
    rows, cols = grid.sum(1)[:classes], grid.sum(0)[:classes]
    item, at = seen
    key, place = np.unique(at * width + item % width, return_inverse=True)
    n = np.bincount(place, item // width, len(key)).astype(np.int64)
    at, code = key // width, key % width
    dense = np.zeros((len(word), width), np.int64)
    dense[at, code] = n
    count = dense[:, :size + 1].sum(1)
    loop, right, left = dense[:, size, None], dense[:, :classes], dense[:, size + 1:size + 1 + classes]
    # The grid's cells that a neighbour's class adds to, for each class that the word may move to.
    cells = np.concatenate([grid[:classes].T, np.zeros((1, classes), np.int64), grid[:, :classes]])
    was = classes + ending
    leaves = (code == was[at]) | (code == size + 1 + was[at])  # cells that the word itself counts in now
    pair, place = np.unique(code * (n.max() + 1) + n, return_inverse=True)
    cell, more = cells[pair // (n.max() + 1)], (pair % (n.max() + 1))[:, None]
    step = _xlogx(cell + more) - _xlogx(cell)
    step[pair // (n.max() + 1) == size] = 0
    gain = step[place]
    there = np.flatnonzero(leaves)
    cell = cells[code[there]] - np.where((code[there] < size)[:, None], left[at[there]], right[at[there]])
    gain[there] = _xlogx(cell + n[there, None]) - _xlogx(cell)
    gain = np.add.reduceat(gain, np.searchsorted(at, np.arange(len(word))), axis=0)
    corner = grid[own, own]
    both, k = np.nonzero((right > 0) & (left > 0) | (loop > 0))
    r, c, middle = right[both, k], left[both, k], corner[k]
    gain[both, k] += _xlogx(middle + r + c + loop[both, 0]) + _xlogx(middle) - _xlogx(middle + r) - _xlogx(middle + c)
    sizes, place = np.unique(count, return_inverse=True)
    gain -= (_xlogx(rows + sizes[:, None]) - _xlogx(rows) + _xlogx(cols + sizes[:, None]) - _xlogx(cols))[place]
    # Of equal classes the next one after a place that the word's hash gives, so that none gathers all ties.
    turn = (own + (word.view(np.uint64) % np.uint64(classes)).astype(np.int64)[:, None]) % classes
    gain = np.take_along_axis(gain, turn, 1)
    first = np.argmax(gain >= gain.max(1, keepdims=True) - 1e-9, axis=1)
    return count, turn[np.arange(len(word)), first]


def place_words(docs: DataFrame, clustered: np.ndarray, of: np.ndarray, grid: np.ndarray, classes: int) -> DataFrame:
    """``word, ending, n, kind`` of all words that are not clustered: each moves to its best class."""
    def run(batches: Iterator[pa.RecordBatch]):
        def out(word, ending, lists):
            fresh = np.r_[True, word[1:] != word[:-1]]
            at = np.repeat(np.cumsum(fresh) - 1, pc.list_value_length(lists).to_numpy())
            n, kind = best_classes(word[fresh], ending[fresh], (lists.flatten().to_numpy().astype(np.int64), at), grid, classes)
            return pa.RecordBatch.from_arrays([pa.array(word[fresh]), pa.array(ending[fresh]), pa.array(n), pa.array(kind.astype(np.int32))],
                                              ["word", "ending", "n", "kind"])
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n > _ROWS:
                whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                word = whole.column("word").to_numpy()
                last = int(np.searchsorted(word, word[-1]))  # the last word may go on
                if last:
                    part = whole.slice(0, last)
                    yield out(part.column("word").to_numpy(), part.column("ending").to_numpy(), part.column("seen"))
                kept, n = [whole.slice(last)], 0
        if kept and sum(k.num_rows for k in kept):
            whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            yield out(whole.column("word").to_numpy(), whole.column("ending").to_numpy(), whole.column("seen"))
    seen = contexts(docs, clustered, of)
    return seen.repartition(partitions(docs), "word").sortWithinPartitions("word").mapInArrow(run, "word long, ending int, n long, kind int")


@dataclass
class Model:
    clustered: np.ndarray  # hashes of the core's words, sorted
    of: np.ndarray  # class of each unit: the core's words, the unknown words of each ending, the end token
    steps: np.ndarray  # log10 P(class | class before)
    places: np.ndarray  # log10 of what an emission is divided by, per class
    head: np.ndarray  # hashes of the most frequent words, sorted
    counts: np.ndarray  # their counts
    kinds: np.ndarray  # their classes
    tokens: int
    types: int


def _cluster(docs: DataFrame, words: int | None, classes: int, head: int, core: int) -> tuple[Model, DataFrame]:
    """All classes, in a model that has no transitions yet, and the table ``word, ending, n, kind`` of all words."""
    spark = docs.sparkSession
    counts = materialize(count_words(docs), "wordcounts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types")).head()
    core = core if words is None else words
    top = _frequent(counts, max(head, core + 1)).toArrow()
    hashes, n, ending = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["ending"].to_numpy()
    order = np.lexsort((hashes.view(np.int64), -n))
    order = order[hashes[order] != END][:core]
    order = order[np.argsort(hashes[order])]
    clustered = hashes[order]
    pairs = count_pairs(docs, clustered)
    of = exchange(pairs, len(clustered), classes)
    size = classes + ENDINGS + 1
    own = [(int(h), int(e), int(c), int(k)) for h, e, c, k in zip(clustered.view(np.int64), ending[order], n[order], of)]
    own = spark.createDataFrame(own, "word long, ending int, n long, kind int")
    end = counts.where(F.col("word") == int(END)).withColumn("kind", F.lit(size - 1))
    if words is None:
        onto = np.zeros((len(pairs), size), np.int64)
        onto[np.arange(len(pairs)), of] = 1
        rest = place_words(docs, clustered, of, onto.T @ pairs @ onto, classes)
    else:
        rest = counts.where(F.col("word") != int(END)).join(F.broadcast(own), "word", "left_anti").withColumn("kind", classes + F.col("ending"))
    known = materialize(own.unionByName(end).unionByName(rest), "words")
    if words is None:
        once = F.sum((F.col("n") == 1).cast("long")).alias("once")
        held = known.where(F.col("word") != int(END)).groupBy("ending", "kind").agg(once, F.count("*").alias("words")).collect()
        best = sorted((r.once, r.words, -r.kind, r.ending) for r in held)
        own = {e: -k for _, _, k, e in best}
        of[len(clustered):-1] = [own.get(e, -best[-1][2] if best else 0) for e in range(ENDINGS)]
    top = _frequent(known, max(head, core + 1)).toArrow()
    hashes = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return Model(clustered, of, np.zeros((size, size)), np.zeros(size), hashes[order], top["n"].to_numpy()[order],
                 top["kind"].to_numpy()[order], int(total.tokens), int(total.types)), known


_CODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, codes binary, " \
    "rare array<long>, times array<int>, other array<int>, which binary"
_WHOLE = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, codes binary"


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def _cut(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of consecutive runs of an array."""
    return pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())


def encode_heads(docs: DataFrame, model: Model) -> DataFrame:
    """Per text the classes of its frequent words and the sums over them, and its rare words: each with its
    times and its class if it is unknown, and for every token of one its place among them."""
    unknown = model.of[len(model.clustered):-1]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in chunks(batch, "text"):
                hashes, ending, row, size = _tokens(part)
                n = part.num_rows
                unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)
                at = np.minimum(np.searchsorted(model.head, unique), max(0, len(model.head) - 1))
                in_head = model.head[at] == unique if len(model.head) else np.zeros(len(unique), bool)
                count = np.where(in_head, model.counts[at], 0) if len(model.head) else np.zeros(len(unique))
                kind = np.where(in_head, model.kinds[at], RARE) if len(model.head) else np.full(len(unique), RARE)
                base = np.bincount(row, np.log10(count + 1)[place], n)
                known = np.bincount(row, in_head[place], n).astype(np.int64)
                rare = np.flatnonzero(~in_head[place])
                pair, which, times = np.unique(row[rare].astype(np.int64) << 32 | place[rare], return_inverse=True, return_counts=True)
                starts = np.searchsorted(pair >> 32, np.arange(n + 1))
                ends, word = pa.array(starts, pa.int32()), pair & 0xFFFFFFFF
                other = np.where(unique[word] == END, len(model.steps) - 1, unknown[ending[first[word]]])
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(size), pa.array(known), pa.array(base),
                    _cut(kind[place].astype(np.uint16), np.r_[0, np.cumsum(size)]),
                    pa.ListArray.from_arrays(ends, pa.array(unique[word].view(np.int64))),
                    pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(other, pa.int32())),
                    _cut((which - starts[row[rare]]).astype(np.int32), np.searchsorted(row[rare], np.arange(n + 1)))], _names(_CODED))
    return docs.select("row", "doc_id", "held_out", "text").mapInArrow(run, _CODED)


def encode(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """One row per text (``row, doc_id, held_out, text``): its tokens, known tokens, sum of its words' log10
    counts, and the class of each token."""
    coded = materialize(encode_heads(docs, model), "coded")
    rare = coded.select("row", "held_out", F.posexplode(F.arrays_zip("rare", "times")).alias("place", "item")) \
        .select("row", "held_out", "place", F.col("item.rare").alias("word"), "item.times")
    known = words.select("word", "n", "kind")
    columns = ["row", "place", "times", "n", "kind"]
    # Outside the head a word is rare in the texts learned from, but not in the others: those are salted.
    met = rare.where("not held_out").join(known, "word").select(columns).unionByName(
        skew_join(rare.where("held_out"), known, "word", ["row"], "inner").select(columns))
    found = met.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"),
                                   F.collect_list(F.struct("place", "kind")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            whole = []
            for codes, which, other, found in zip(*(b.column(c) for c in ("codes", "which", "other", "found"))):
                codes = np.frombuffer(codes.as_py(), np.uint16)
                if len(which.as_py()):
                    kinds = other.values.to_numpy().copy()
                    if found.is_valid:
                        kinds[found.values.field("place").to_numpy()] = found.values.field("kind").to_numpy()
                    codes = codes.copy()
                    codes[codes == RARE] = kinds[np.frombuffer(which.as_py(), np.int32)]
                whole.append(codes.tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _names(_WHOLE)[:-1]), pa.array(whole, pa.binary())], _names(_WHOLE))
    joined = coded.join(found, "row", "left").select(
        "row", "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base"), "codes", "other", "which", "found")
    return materialize(joined.mapInArrow(run, _WHOLE), "classes")


def _sequence(batch: pa.RecordBatch, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token of all texts in a row, and the class before it; each text ends in the end token."""
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint16).astype(np.int64)
    return codes, np.concatenate([[end], codes[:-1]])


def transitions(coded: DataFrame, size: int) -> np.ndarray:
    """How often each class follows each, in the texts of ``encode``."""
    def run(batches: Iterator[pa.RecordBatch]):
        sums = np.zeros(size * size, np.int64)
        for batch in batches:
            if batch.num_rows:
                of, before = _sequence(batch, size - 1)
                sums += np.bincount(before * size + of, minlength=size * size)
        key = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sums[key])], ["pair", "n"])
    pairs = coded.select("codes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros(size * size, np.int64)
    grid[pairs["pair"].to_numpy()] = pairs["n"].to_numpy()
    return grid.reshape(size, size)


def _fit(model: Model, words: DataFrame, coded: DataFrame) -> Model:
    """Transitions and emissions of the texts learned from."""
    size = len(model.steps)
    grid = transitions(coded, size)
    shares = (grid.sum(0) + 1) / (grid.sum() + size)
    model.steps = np.log10((grid + PRIOR * shares) / (grid.sum(1, keepdims=True) + PRIOR))
    tokens, types = grid.sum(0), np.zeros(size)
    for r in words.groupBy("kind").agg(F.count("*").alias("types")).collect():
        types[r.kind] = r.types
    model.places = np.log10(tokens + types + 1)
    model.places[-1] = np.log10(tokens[-1] + 1)  # the end token is alone in its class
    return model


def train(docs: DataFrame, words: int | None = None, classes: int = CLASSES, head: int = HEAD, core: int = CORE) -> tuple[Model, DataFrame]:
    """The model of all given texts, and the table ``word, ending, n, kind`` of all counts and classes.

    With ``words``, only so many words are clustered, and any other has the class of its last byte."""
    model, counts = _cluster(docs, words, classes, head, core)
    none = F.lit(None).cast("long")
    rows = docs.select("text", none.alias("doc_id"), F.lit(False).alias("held_out"), F.monotonically_increasing_id().alias("row"))
    return _fit(model, counts, encode(rows, model, counts)), counts


def score_texts(coded: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, n_tokens, known, base, steps`` of the texts of ``encode``: the last sums up classes and emissions."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            of, before = _sequence(b, len(model.steps) - 1)
            row = np.repeat(np.arange(b.num_rows), b.column("n_tokens").to_numpy())
            steps = np.bincount(row, model.steps[before, of] - model.places[of], b.num_rows) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "held_out", "n_tokens", "known", "base")), pa.array(steps)],
                                             ["doc_id", "held_out", "n_tokens", "known", "base", "steps"])
    return coded.drop("row").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, steps double")


def _coded(rows: DataFrame, words: int | None = None, classes: int = CLASSES, head: int = HEAD, core: int = CORE) -> tuple[DataFrame, Model]:
    """All texts as classes, and the model of those not held out."""
    model, counts = _cluster(rows.where("not held_out"), words, classes, head, core)
    coded = encode(rows, model, counts)
    return coded, _fit(model, counts, coded.where("not held_out"))


def score_documents(docs: DataFrame, held_out=None, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    The model learns from the rows that are not held out (by default those whose
    crc32(doc_id) mod 7 is not 2; a row without an id is not held out).  A null
    text is empty and has its end token only.  Repeated rows count and are scored
    each.  Without training rows every probability comes from smoothing.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    held = F.coalesce(crc_mod("doc_id", 7) == 2 if held_out is None else held_out, F.lit(False))
    rows = rows.select("doc_id", held.alias("held_out"), "text", F.monotonically_increasing_id().alias("row"))
    coded, model = _coded(rows, **options)
    score = F.col("base") + F.col("steps")
    places = float(np.log10(model.tokens + model.types + 1))
    return score_texts(coded, model).select(
        "doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * places).alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
