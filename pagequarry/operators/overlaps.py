"""Which word sets may overlap by more than a threshold, and by how much they do: numpy inside Arrow batches.

Sets are rows of 64-bit word hashes until they are in a family; there the words themselves are compared.
"""

import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Functions travel inside the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Buckets in which words are counted, and the ranges of buckets that tasks add up.
BUCKETS, RANGES = 1 << 22, 64
#: Sets of a family that one task pairs with each other.
FAMILY = 2_000
#: Prefix words that meet in one task; sets, prefix words and pairs that a task takes up at once.
PART, ROWS, TOKENS, PAIRS = 2_500_000, 2_000, 500_000, 500_000
#: Sizes of sets go by their doublings.
DOUBLINGS = 32
#: A set of more words than one of these takes a sketch of twice as many longs.
STEPS = np.array([80, 180, 420, *(900 << k for k in range(16))])


def mix(h):
    """A permutation of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def starts(lengths):
    """Where runs of these lengths begin, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(lengths)])


def within(lengths):
    """0, 1, ... inside each run."""
    return np.arange(int(lengths.sum())) - np.repeat(starts(lengths)[:-1], lengths)


def runs(begin, lengths):
    """Indices of runs of ``lengths`` that begin at ``begin``."""
    return np.repeat(begin, lengths) + within(lengths)


def lists(column):
    """Values and lengths of a column of lists."""
    return column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def blobs(data, lengths):
    """A binary column of runs of ``data``."""
    at = (starts(lengths) * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def unblob(column, dtype):
    """All values of a binary column, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    return np.frombuffer(b"" if body is None else body, np.uint8)[at[0]:at[-1]].view(dtype), np.diff(at).astype(np.int64) // np.dtype(dtype).itemsize


def level(count):
    """Eight levels to a doubling; 8 is a count of one and nothing else."""
    return np.ceil(8 * np.log2(1 + count)).astype(np.uint8)


def doubling(n):
    """The doubling that sizes lie in."""
    return np.log2(np.maximum(n, 1)).astype(np.int64)


def word_levels(hashed: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How frequent the words of each bucket of hashes are, as ``level`` of the sets that hold one, and the words
    in sets of each doubling of size.  Tasks count in their own memory and send compressed ranges of counts."""
    width = BUCKETS // RANGES

    def count(batches):
        seen, sizes = np.zeros(BUCKETS, np.int32), np.zeros(DOUBLINGS, np.int64)
        for b in batches:
            words, n = lists(b.column("hashes"))
            np.add.at(seen, words.to_numpy().view(np.uint64) & np.uint64(BUCKETS - 1), 1)
            np.add.at(sizes, doubling(n), n)
        some = [(r, part) for r, part in enumerate(seen.reshape(RANGES, width)) if part.any()] + [(RANGES, sizes.view(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in some], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for _, x in some], pa.binary())],
                                         ["range", "counts"])

    def add(batches):
        seen = {}
        for b in batches:
            for r, x in zip(b.column("range").to_pylist(), b.column("counts").to_pylist()):
                seen[r] = seen.get(r, 0) + np.frombuffer(zlib.decompress(x), np.int32 if r < RANGES else np.int64).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([(level(x) if r < RANGES else x).tobytes() for r, x in seen.items()], pa.binary())],
                                         ["range", "levels"])

    table = hashed.select("hashes").mapInArrow(count, "range int, counts binary").repartition("range").mapInArrow(add, "range int, levels binary").toArrow()
    levels, sizes = np.zeros((RANGES, width), np.uint8), np.zeros(DOUBLINGS, np.int64)
    for r, x in zip(table["range"].to_pylist(), table["levels"].to_pylist()):
        if r < RANGES:
            levels[r] = np.frombuffer(x, np.uint8)
        else:
            sizes = np.frombuffer(x, np.int64)
    return levels.ravel(), sizes


def shares(sizes: np.ndarray, threshold: float, tasks: int) -> np.ndarray:
    """Parts of the prefix words of each doubling: of ``PART`` words, or fewer if there are idle tasks."""
    words = np.ceil(sizes * (1 - threshold))
    return np.maximum(1, np.ceil(words / max(1, min(PART, words.sum() / tasks)))).astype(np.int64)


def sketches(h, row, n):
    """A set of ``n`` words as bits, each word flipping one, in as many longs as its size asks for.

    Flips cancel, so the bits in which two sets differ are at most the words in which they differ: a lower
    bound on the difference.  Halves of a sketch, one flipped by the other, are the sketch of half the size.
    """
    longs = np.left_shift(1, np.searchsorted(STEPS, n))
    bit = (h >> np.uint64(40)).astype(np.int64) & (longs[row] * 64 - 1)
    out = np.zeros(int(longs.sum()), np.uint64)
    np.bitwise_xor.at(out, starts(longs)[row] + (bit >> 6), np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)))
    return out, longs


def prefixes(hashed: DataFrame, levels, threshold: float, block: int, parts: np.ndarray) -> DataFrame:
    """The rarest words of each set that a set above the threshold must share one of, one row a set and part.

    ``words`` are hashes, each mixed with the block of its word where a word has more than ``block`` sets, and ``at``
    their places in the set.  A word of one set meets none and stays out, but counts for the places.

    Sets of each doubling of size have ``parts`` of their own, so that many words of a large set, whose sketch is
    large, meet in one.  A set goes to its doubling and to those of the smaller sets that it may be a pair with.
    """
    sent = hashed.sparkSession.sparkContext.broadcast(levels)
    before = starts(parts)
    blocks = np.maximum(1, np.ceil((2 ** (np.arange(256) / 8) - 1) / block)).astype(np.int64)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                words, n = lists(part.column("hashes"))
                yield packed(part.column("node").to_numpy(), words.to_numpy().view(np.uint64), n)

    def packed(node, h, n):
        row = np.repeat(np.arange(len(n)), n)
        bits, longs = sketches(h, row, n)
        rare = sent.value[h & np.uint64(BUCKETS - 1)]
        order, at = np.lexsort((h, rare, row)), within(n)
        kept = (at < np.repeat(n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1, n)) & (rare[order] != 8)
        order, at = order[kept], at[kept]
        times = blocks[rare[order]]
        place, row, at, other, times = *(np.repeat(x, times) for x in (h[order], row[order], at)), within(times), np.repeat(times, times)
        own = (mix(node.view(np.uint64))[row] % times.astype(np.uint64)).astype(np.int64)
        pair = (np.minimum(own, other) << 32) + np.maximum(own, other) + 1
        place = np.where(times > 1, mix(place ^ mix(pair.astype(np.uint64))), place)
        least, most = doubling(np.ceil(n * threshold - 1e-9)), doubling(n)
        times = (most - least + 1)[row]
        double = least[np.repeat(row, times)] + within(times)
        place, row, at = (np.repeat(x, times) for x in (mix(place), row, at))
        part = before[double] + (place % parts[double].astype(np.uint64)).astype(np.int64)
        place = (place >> np.uint64(32)).astype(np.uint32)  # two words alike in these bits only meet more sets
        order = np.lexsort((part, row))
        place, row, at, part = place[order], row[order], at[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])])) if len(row) else np.zeros(0, np.int64)
        size, of = np.diff(np.append(first, len(row))), row[first]
        return pa.RecordBatch.from_arrays([
            pa.array(part[first].astype(np.int32)), pa.array(node[of]), pa.array(n[of].astype(np.int32)),
            blobs(bits[runs(starts(longs)[of], longs[of])], longs[of]), blobs(place, size), blobs(at.astype(np.int32), size)],
            ["part", "node", "n", "bits", "words", "at"])
    return hashed.select("node", "hashes").mapInArrow(run, "part int, node long, n int, bits binary, words binary, at binary")


class Sketches:
    """The sketches of rows of ``prefixes``, by the longs that they have or are folded to."""

    def __init__(self, bits, longs):
        self.kind = np.round(np.log2(np.maximum(longs, 1))).astype(np.int64)
        self.bits, self.begin, self.folded = bits, starts(longs)[:-1], {}

    def of(self, kind):
        """Sketches of this kind and of the next one folded to it, and where a row has its own."""
        if kind not in self.folded:
            rows = [np.flatnonzero(self.kind == kind + k) for k in (0, 1)]
            own, twice = (self.bits[self.begin[r][:, None] + np.arange(1 << kind + k)] for k, r in enumerate(rows))
            at = np.zeros(len(self.kind), np.int64)
            at[np.concatenate(rows)] = np.arange(sum(map(len, rows)))
            self.folded[kind] = np.concatenate([own, twice[:, :1 << kind] ^ twice[:, 1 << kind:]]), at
        return self.folded[kind]

    def differing(self, a, b):
        """A lower bound on the words in which the rows differ; 0 where their sketches are of too different sizes."""
        out = np.zeros(len(a), np.int64)
        kind, most = np.minimum(self.kind[a], self.kind[b]), np.maximum(self.kind[a], self.kind[b])
        for k in np.unique(kind):
            table, at = self.of(int(k))
            mine, step = np.flatnonzero((kind == k) & (most <= k + 1)), max(1, (1 << 21) >> int(k))
            for lo in range(0, len(mine), step):
                m = mine[lo:lo + step]
                out[m] = np.bitwise_count(table[at[a[m]]] ^ table[at[b[m]]]).sum(axis=1)
        return out


def tie(label, a, b):
    """Joins the rows ``a`` and ``b`` in ``label``, the smallest row that each one hangs together with."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def linked(threshold: float):
    """A task of ``prefixes`` rows to links ``a, b`` of nodes: what may be above the threshold hangs together by them.

    Two sets that share a word are tied if their sizes, the word's places and their sketches allow it.
    A task names one node for each that hangs together with another, not their pairs.
    """
    share, apart = threshold / (1 + threshold), (1 - threshold) / (1 + threshold)

    def pairs(place, n, pos):
        """Pairs of tokens, sorted by place and size, that sizes and places allow: the smaller set first."""
        fresh = np.concatenate([[True], place[1:] != place[:-1]])
        wide = int(n.max()) + 3
        key = (np.cumsum(fresh) - 1) * wide + n
        most = np.minimum((n - pos + 1e-9) / share - n, n / threshold + 1e-6)
        end = np.searchsorted(key, key - n + np.minimum(np.ceil(most).astype(np.int64) + 1, wide))
        count = np.maximum(end - np.arange(len(n)) - 1, 0)
        sums, lo = np.cumsum(count), 0
        while lo < len(n):
            hi = max(lo + 1, int(np.searchsorted(sums, (sums[lo - 1] if lo else 0) + PAIRS, "right")))
            many = count[lo:hi]
            for cut in range(0, max(1, int(many[0])) if hi == lo + 1 else 1, PAIRS):
                some = np.minimum(many - cut, PAIRS) if hi == lo + 1 else many
                a = np.repeat(np.arange(lo, hi), some)
                b = a + 1 + cut + within(some)
                total = n[a] + n[b]
                good = (np.minimum(n[a] - pos[a], n[b] - pos[b]) > total * share - 1e-9) & (n[a] > n[b] * threshold)
                yield a[good], b[good]
            lo = hi

    def run(batches):
        read = [b for b in batches if b.num_rows]
        if not read:
            return
        column = {c: pa.concat_arrays([b.column(c) for b in read]) for c in read[0].schema.names}
        del read
        node, size = column["node"].to_numpy(), column["n"].to_numpy().astype(np.int64)
        (words, count), (places, _) = unblob(column["words"], np.uint32), unblob(column["at"], np.int32)
        known = Sketches(*unblob(column["bits"], np.uint64))
        rows, label = np.repeat(np.arange(len(node), dtype=np.int32), count), np.arange(len(node))
        cuts = np.uint32(len(words) // TOKENS + 1)
        for cut in range(int(cuts)):
            mine = np.flatnonzero(words % cuts == cut)
            if not len(mine):
                continue
            mine = mine[np.lexsort((size[rows[mine]], words[mine]))]
            row = rows[mine].astype(np.int64)
            for a, b in pairs(words[mine], size[row], places[mine].astype(np.int64)):
                a, b = row[a], row[b]
                new = label[a] != label[b]
                a, b = np.divmod(np.unique(a[new] * len(node) + b[new]), len(node))
                good = known.differing(a, b) < (size[a] + size[b]) * apart + 1e-9
                tie(label, a[good], b[good])
        tied = np.flatnonzero(node != node[label])
        yield pa.RecordBatch.from_arrays([pa.array(node[tied]), pa.array(node[label[tied]])], ["a", "b"])
    return run


def overlapping(threshold: float):
    """Rows ``word, i, j, side, id, node, words``, all of a place one after another, to pairs ``a, b, similarity`` of ids.

    At a place of one block all rows meet each other, at one of two blocks those of either side.
    """
    names = ["a", "b", "similarity"]

    def whole(batches):
        """Batches of whole places."""
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            last = np.logical_and.reduce([x == x[-1] for x in (table[c].to_numpy() for c in ("word", "i", "j"))])
            begin = table.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
            if begin:
                yield table.slice(0, begin)
            rest = table.slice(begin)
        if rest is not None:
            yield rest

    def run(batches):
        for table in whole(batches):
            yield from met(table.combine_chunks())

    def met(table):
        word, i, j, side, node = (table[c].to_numpy() for c in ("word", "i", "j", "side", "node"))
        ids = pa.concat_arrays(table["id"].chunks)
        rank = pc.rank(ids, sort_keys="ascending", tiebreaker="min").to_numpy(zero_copy_only=False).astype(np.int64)
        words, n = lists(pa.concat_arrays(table["words"].chunks))
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        place = np.cumsum(np.concatenate([[False], (word[1:] != word[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        order = np.lexsort((node, rank, side, n, place))
        same = [x[order][1:] == x[order][:-1] for x in (place, side, rank, node)]
        order = order[np.concatenate([[True], ~np.logical_and.reduce(same)])]  # a row that comes twice counts once
        codes = codes[runs(starts(n)[:-1][order], n[order])]
        n, rank, side, place, cross = n[order], rank[order], side[order], place[order], (i != j)[order]
        at, wide = starts(n), int(n.max()) + 3
        end = np.searchsorted(place * wide + n, place * wide + np.minimum(np.ceil(n / threshold + 1e-6).astype(np.int64) + 1, wide))
        mark, out, held = np.zeros(int(codes.max()) + 1, np.uint8), [], 0
        for x in np.flatnonzero(end > np.arange(len(n)) + 1):
            mine = codes[at[x]:at[x + 1]]
            mark[mine] = 1
            common = np.add.reduceat(mark[codes[at[x + 1]:at[end[x]]]], at[x + 1:end[x]] - at[x + 1], dtype=np.int64)
            mark[mine] = 0
            y = np.arange(x + 1, end[x])
            similarity = common / (n[x] + n[y] - common)
            first = rank[x] < rank[y]
            good = (similarity > threshold) & (rank[x] != rank[y])
            if cross[x]:
                good &= (side[x] != side[y]) & (np.where(first, side[x], side[y]) == 0)
            y, similarity, first = y[good], similarity[good], first[good]
            out.append((np.where(first, x, y), np.where(first, y, x), similarity))
            held += len(y)
            if held > PAIRS:
                yield batch(ids, order, out)
                out, held = [], 0
        if held:
            yield batch(ids, order, out)

    def batch(ids, order, out):
        a, b, similarity = map(np.concatenate, zip(*out))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(order[a])), ids.take(pa.array(order[b])), pa.array(similarity)], names)
    return run


def hashes(words: str):
    """The words of a set as 64-bit hashes; an equal hash of two words only adds a candidate."""
    return F.transform(words, lambda w: F.xxhash64(w))
