"""Benchmark passages in documents, under edits: CGK embeddings, bit sampling, exact edit distance.

Texts are compared as words (ASCII letters and digits lower-cased, everything
beyond ASCII kept).  The CGK random walk reads a window word by word: it writes
the current word and moves on if a random bit of that word and step is set.  Walks
over texts within a small edit distance fall back into step, so edits become a few
differing places of the written sequences.  Keys are samples of those places;
several walks and samples are repeated to reach the target recall.

A walk starts at every word of a document and at every word of an item that
leaves room for a sample, so one nearly untouched stretch of a passage is enough.
Its hits propose item-sized windows, and the exact edit distance of the whole item
within its window decides.

Items are taken in blocks of bounded size; each block is sent to the tasks and
meets all documents in one narrow pass, without a shuffle of any text.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, received, send, unused
from .words import PUNCTUATION, chunks, find_words, hash_words, mix

#: Steps of a walk, where the first check of all samples lies, places that a sample adds.
STEPS, EARLY, LATER = 10, 2, 1
#: Words that an item needs for walks, and words that a walk's start must leave in it.
WALKED, ROOM = 5, 3
#: Rare words that a sample must hold (samples of common words alone are no evidence) if this share of an
#: item's samples can; a word is rare if at most this share of the items has it.
RARE, USABLE, RARE_SHARE = 2, 0.3, 0.03
#: Edits allowed, as a share of an item's characters.
MAX_EDITS = 0.2
BLOCK_WORDS = 200_000  # about 40 MB of keys
_TABLE_BITS = 22
_TOGETHER = 2048  # pairs of a text window and an item whose distances advance together


def sample_places(seed: int, walk: int, sample: int) -> list[int]:
    """Places of one sample: the walk's first word, one early place, and ``LATER`` others."""
    rng = np.random.default_rng([seed, walk, sample])
    return [0, EARLY, *sorted(int(p) for p in rng.choice(np.arange(EARLY + 1, STEPS), LATER, replace=False))]


def repeats(recall: float, edits: float = 0.43, anchors: int = 10) -> tuple[int, int]:
    """Walks and samples per walk that reach a recall when a word is edited with
    probability ``edits`` (a tenth of its characters) and ``anchors`` starts are tried: a sample
    survives when the words that its walk reads, about half its steps, are untouched."""
    one = (1 - edits) ** (STEPS / 2)
    needed = math.log(max(1e-9, 1 - recall)) / math.log(max(1e-9, 1 - one)) / anchors
    return max(2, math.ceil(needed)), 4


def _coins(hashes: np.ndarray, walk: int) -> np.ndarray:
    """Per word the random bits of a walk's steps: ``64 // STEPS`` walks share one hash of the word."""
    bank, place = divmod(walk, 64 // STEPS)
    drawn = mix(hashes + np.uint64(bank)) if bank else hashes
    return drawn >> np.uint64(place * STEPS)


def _move(coins: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Where the walk stands after a step: on the same word or the next."""
    return at + (coins[at] >> np.uint64(step) & np.uint64(1)).astype(np.int32)


def _keys(hashes: np.ndarray, starts: np.ndarray, walks: int, samples: int, seed: int, keep=None, rare=None):
    """Per walk: starts, their partial keys, and for each sample its keys and, given
    ``rare`` per word, how many rare words it saw.  ``hashes`` ends in
    ``STEPS`` zeros, which walks past the end write.  ``keep(partial)`` may drop starts
    after the early place, before the rest of the walk."""
    for walk in range(walks):
        own, coins = starts, _coins(hashes, walk)
        for step in range(EARLY + 1):
            word, seen = hashes[own], own
            if step == 0:
                partial = mix(word + np.uint64(walk + 1))
            own = _move(coins, own, step)
        partial = mix(partial ^ word)
        live = starts
        if keep is not None:
            some = keep(partial)
            live, own, partial = starts[some], own[some], partial[some]
        places = [sample_places(seed, walk, s)[2:] for s in range(samples)]
        keys = [mix(partial + np.uint64(s)) for s in range(samples)]
        if rare is not None:
            counts = [rare[live].astype(int) + (rare[seen] & (seen > live)) for _ in range(samples)]
            before = [seen] * samples
        for step in range(EARLY + 1, STEPS):
            word = hashes[own]
            for s in range(samples):
                if step in places[s]:
                    keys[s] = mix(keys[s] ^ word)
                    if rare is not None:
                        counts[s] = counts[s] + (rare[own] & (own > before[s]))
                        before[s] = own
            own = _move(coins, own, step)
        yield live, partial, keys, counts if rare is not None else None


def edit_distances(patterns: list[str], pairs: list[tuple[int, str]]) -> np.ndarray:
    """For each pair (place of a pattern, text) the least edit distance between the pattern and any
    substring of the text.

    Exact and bit-parallel: a column of the distance table is two bit sets, one bit per letter of the
    pattern, of where it rises and falls.  All pairs whose patterns need as many 64-bit words advance
    together, one letter of their texts at a time.
    """
    out = np.zeros(len(pairs), np.int64)
    for place in range(0, len(pairs), _TOGETHER):
        groups: dict[int, list[int]] = {}
        for i in range(place, min(len(pairs), place + _TOGETHER)):
            if patterns[pairs[i][0]]:
                groups.setdefault((len(patterns[pairs[i][0]]) + 63) // 64, []).append(i)
        for size, members in groups.items():
            members.sort(key=lambda i: -len(pairs[i][1]))
            out[members] = _advance(patterns, [pairs[i] for i in members], size)
    return out


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _advance(patterns: list[str], pairs: list[tuple[int, str]], size: int) -> np.ndarray:
    """``edit_distances`` of pairs whose patterns fill ``size`` words, the longest text first."""
    # Per pattern and letter a row of bits, where the letter stands; row 0 for letters that it lacks.
    tables, letters, rows = [np.zeros((1, size), np.uint64)], {}, 1
    for k in {k for k, _ in pairs}:
        points = _points(patterns[k])
        known, at = np.unique(points, return_inverse=True)
        bits = np.zeros((len(known), size), np.uint64)
        spots = np.arange(len(points))
        np.bitwise_or.at(bits, (at, spots >> 6), np.uint64(1) << (spots & 63).astype(np.uint64))
        letters[k] = known, rows
        tables.append(bits)
        rows += len(known)
    table = np.concatenate(tables).T.copy()
    lengths = np.array([len(t) for _, t in pairs])
    reads = np.zeros((int(lengths[0]), len(pairs)), np.int32)
    for i, (k, text) in enumerate(pairs):
        known, first = letters[k]
        points = _points(text)
        at = np.minimum(np.searchsorted(known, points), len(known) - 1)
        reads[:len(points), i] = np.where(known[at] == points, first + at, 0)
    score = np.array([len(patterns[k]) for k, _ in pairs])
    top = np.uint64(1) << ((score - 1) & 63).astype(np.uint64)
    best = score.copy()
    plus = np.full((size, len(pairs)), ~np.uint64(0))
    minus = np.zeros_like(plus)
    one, last = np.uint64(1), np.uint64(63)
    for column, live in enumerate(np.searchsorted(-lengths, -np.arange(len(reads)), "left")):
        if live < plus.shape[1]:  # texts that have ended
            plus, minus, score, top = plus[:, :live], minus[:, :live], score[:live], top[:live]
        eq = table[:, reads[column, :live]]
        kept = eq & plus
        total = kept + plus
        over = total < kept
        for w in range(1, size):
            total[w] += over[w - 1]
            over[w] |= over[w - 1] & (total[w] == 0)
        diagonal = (total ^ plus) | eq | minus
        up = minus | ~(diagonal | plus)
        down = plus & diagonal
        score = score + ((up[-1] & top) != 0) - ((down[-1] & top) != 0)
        np.minimum(best[:live], score, out=best[:live])
        # Along the text the first row stays 0: a match may start anywhere.
        up_next, down_next = up << one, down << one
        up_next[1:] |= up[:-1] >> last
        down_next[1:] |= down[:-1] >> last
        plus = down_next | ~(diagonal | up_next)
        minus = up_next & diagonal
    return best


class Items:
    """A block of items with the keys of their walks."""

    def __init__(self, ids: list, texts: list[str], walks: int, samples: int, seed: int):
        found = find_words(pa.array(texts, pa.large_string()), PUNCTUATION)
        hashes = hash_words(found)
        self.walks, self.samples, self.seed = walks, samples, seed
        self.ids, self.words, self.forms, self.short = [], [], [], {}
        lows, posts = [], [[] for _ in range(walks * samples)]
        pairs, of = np.unique(np.stack([hashes, found.row.astype(np.uint64)]), axis=1, return_inverse=True)
        _, at, held = np.unique(pairs[0], return_inverse=True, return_counts=True)
        usual, common = held[at[of]], max(3, int(RARE_SHARE * len(ids)))  # items that hold each word
        for k, (item, lo, hi) in enumerate(zip(ids, found.first, found.first[1:])):
            own = hashes[lo:hi]
            self.ids.append(item)
            self.words.append(hi - lo)
            self.forms.append(_form(found, lo, hi))
            if hi == lo:
                continue
            if hi - lo < WALKED:  # too short for a walk: found word for word only
                self.short.setdefault(int(hi - lo), {}).setdefault(int(_run_hash(own, hi - lo)[0]), []).append(k)
                continue
            starts = np.arange(hi - lo - ROOM + 1, dtype=np.int32)
            rare = np.r_[usual[lo:hi] <= common, np.zeros(STEPS + 1, bool)]
            walked = list(_keys(_padded(own), starts, walks, samples, seed, rare=rare))
            seen = np.concatenate([c for *_, counts in walked for c in counts])
            # An item of mostly common words keeps samples with fewer rare ones, down to none.
            least = next(r for r in range(RARE, -1, -1) if np.mean(seen >= r) >= USABLE)
            for walk, (live, partial, keys, counts) in enumerate(walked):
                for s, key in enumerate(keys):
                    good = counts[s] >= least
                    lows.append(partial[good])
                    posts[walk * samples + s].append(np.stack([
                        key[good], np.full(good.sum(), k, np.uint64), live[good].astype(np.uint64)]))
        self.early = np.zeros(1 << _TABLE_BITS, bool)
        for low in lows:
            self.early[low >> np.uint64(64 - _TABLE_BITS)] = True
        self.posts = []
        for p in posts:
            p = np.concatenate(p, axis=1) if p else np.zeros((3, 0), np.uint64)
            p = p[:, np.argsort(p[0], kind="stable")]
            self.posts.append((p[0], p[1].astype(np.int32), p[2].astype(np.int32)))

    def candidates(self, hashes: np.ndarray, first: np.ndarray):
        """``text, item, first and last start`` proposals for a chunk of texts.

        Hits of one alignment differ in their start by the edits before them, so starts
        within a fifth of the item are one proposal.
        """
        out, sure = [], []
        starts = np.arange(len(hashes), dtype=np.int32)
        padded = _padded(hashes)
        keep = lambda partial: np.flatnonzero(self.early[partial >> np.uint64(64 - _TABLE_BITS)])
        for walk, (live, _, keys, _) in enumerate(_keys(padded, starts, self.walks, self.samples, self.seed, keep)):
            for s, key in enumerate(keys):
                known, item, offset = self.posts[walk * self.samples + s]
                if not len(known):
                    continue
                lo = np.searchsorted(known, key)
                hit = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == key)
                count = np.searchsorted(known, key[hit], "right") - lo[hit]
                at = np.repeat(lo[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                out.append((np.repeat(live[hit], count), item[at].astype(np.int64), offset[at].astype(np.int64)))
        for size, known in self.short.items():
            runs = _run_hash(hashes, size)
            hit = np.flatnonzero(np.isin(runs, np.array(list(known), np.uint64)))
            for at in hit:
                sure += [(int(np.searchsorted(first, at, "right")) - 1, k, int(at)) for k in known[int(runs[at])]]
        for text, k, at in sure:
            yield text, k, at - int(first[text]), at - int(first[text])
        if not sum(len(x[0]) for x in out):
            return
        word, item, offset = (np.concatenate(x) for x in zip(*out))
        text = np.searchsorted(first, word, "right") - 1
        start = word - offset - first[text]
        order = np.lexsort((word, start, item, text))
        word, item, text, start = word[order], item[order], text[order], start[order]
        reach = np.maximum(2, np.array(self.words) // 5)[item]
        fresh = np.ones(len(word), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > reach[1:])
        lo = np.flatnonzero(fresh)
        hi = np.r_[lo[1:], len(word)]
        for a, b in zip(lo, hi):
            yield int(text[a]), int(item[a]), int(start[a]), int(start[b - 1])


def _padded(hashes: np.ndarray) -> np.ndarray:
    return np.concatenate([hashes, np.zeros(STEPS + 1, np.uint64)])


def _run_hash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = mix(out ^ hashes[k:k + n])
    return out


def _form(found, lo: int, hi: int) -> str:
    """Words ``lo`` to ``hi`` joined by single spaces."""
    if hi <= lo:
        return ""
    raw, base = found.data[found.start[lo]:found.end[hi - 1]].tobytes(), int(found.start[lo])
    return b" ".join(raw[a - base:b - base] for a, b in zip(found.start[lo:hi].tolist(), found.end[lo:hi].tolist())).decode()


def scan(items: Items, batches: Iterator[pa.RecordBatch], max_edits: float = MAX_EDITS):
    """Arrow batches of ``doc_id, item, edits, item_chars``: the best window of each item in each text."""
    ids: list = []  # of the texts with proposals since the last batch went out
    best: dict[tuple[int, int], int] = {}
    unsure: dict[tuple[int, str], set[int]] = {}  # copies of a passage are compared once

    def out():
        pairs = list(unsure)
        for (k, window), edits in zip(pairs, edit_distances(items.forms, pairs).tolist()):
            if edits <= int(max_edits * len(items.forms[k])):
                for text in unsure[k, window]:
                    best[text, k] = min(edits, best.get((text, k), edits))
        rows = sorted(best.items())
        done = pa.RecordBatch.from_pydict({
            "doc_id": pa.array([ids[t] for (t, _), _ in rows], pa.int64()),
            "item_id": pa.array([items.ids[k] for (_, k), _ in rows], pa.int64()),
            "edits": pa.array([e for _, e in rows], pa.int64()),
            "item_chars": pa.array([len(items.forms[k]) for (_, k), _ in rows], pa.int64())})
        ids.clear()
        best.clear()
        unsure.clear()
        return done

    for batch in batches:
        for part in chunks(batch, "text"):
            found = find_words(part.column("text"), PUNCTUATION)
            if not len(found.start):
                continue
            places: dict[int, int] = {}
            for text, k, start, last in items.candidates(hash_words(found), found.first):
                if text not in places:
                    places[text] = len(ids)
                    ids.append(part.column("doc_id")[text].as_py())
                place, form = places[text], items.forms[k]
                if best.get((place, k)) == 0:
                    continue
                base, end = int(found.first[text]), int(found.first[text + 1])
                # A window a little larger than the item; the distance picks the best part of it.
                extra = int(max_edits * items.words[k]) + 1
                lo, hi = max(base, base + start - extra), min(end, base + last + items.words[k] + extra)
                window = _form(found, lo, hi)
                if items.words[k] < WALKED or int(max_edits * len(form)) == 0:  # word for word only
                    if f" {form} " in f" {window} ":
                        best[place, k] = 0
                elif form in window:
                    best[place, k] = 0
                else:
                    unsure.setdefault((k, window), set()).add(place)
            if len(unsure) >= _TOGETHER or len(best) >= _TOGETHER:
                yield out()
    yield out()


def _blocks(benchmark: DataFrame, most: int) -> Iterator[tuple[list, list]]:
    """Items in blocks of at most ``most`` words, read one partition at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.toLocalIterator():
        words = len(r.text or "") // 2 + 1
        if ids and size + words > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text or "")
        size += words
    if ids:
        yield ids, texts


def benchmark_passages(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, recall: float = 0.997,
                       seed: int = 1, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, item_id, edits, item_chars``: items that stand in a document with at most
    ``max_edits`` of their characters edited, each with its least distance.

    An item under five words (``WALKED``) must stand word for word; one without words never
    matches.  Null texts are empty.  Repeated rows each report; a document without
    an id reports a null one.  A table without rows gives none.
    """
    spark = docs.sparkSession
    walks, samples = repeats(recall)
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text"))
    schema = "doc_id long, item_id long, edits long, item_chars long"
    out = spark.createDataFrame([], schema)
    rows = id_and_text(docs)
    for ids, texts in _blocks(items, block_words):
        block = send(spark, Items(ids, texts, walks, samples, seed))

        def run(batches, block=block):
            yield from scan(received(Items, block), batches, max_edits)
        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark passage: columns as they came.

    A row is known by a hash of its id and text, so rows without an id are judged like others.
    """
    row = unused(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = benchmark_passages(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, **options)
    return keyed.join(found.select(F.col("doc_id").alias(row)).distinct(), row, "left_anti").drop(row)
