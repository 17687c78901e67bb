"""Which strings of one table lie inside which strings of another, in one pass over the containing side.

The contained strings are cut into blocks of bounded size.  A task compiles a block into an Aho-Corasick
automaton and reads its share of the containing strings through it letter by letter, so the work is the
letters read plus the answers, also where a whole family of names shares its rarest gram.
"""

import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import grams, rarest_grams
from .shared import materialize, skew_join

# Functions and classes travel inside the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Letters of the contained strings in one automaton (about 60 MB), and of the containing strings that a task reads through it.
BLOCK, SHARE = 300_000, 1_000_000
#: A contained string of more letters stays out of the automaton and is searched for by itself.
LONG = 10_000
#: Buckets whose sizes (some 20 bytes each) may be sent to every task.
FEW = 500_000
_ALPHABET = sys.maxunicode + 1


class Automaton:
    """Strings as a trie whose nodes know the longest proper suffix that is also a node."""

    def __init__(self, strings: Iterable[str]):
        self.strings = list(strings)
        self.long = [i for i, s in enumerate(self.strings) if len(s) > LONG]
        self.step: dict[int, int] = {}
        parent, letter, depth = [0], [0], [0]
        self.end = {}
        for i, s in enumerate(self.strings):
            if len(s) > LONG:
                continue
            node = 0
            for c in map(ord, s):
                key = node * _ALPHABET + c
                child = self.step.get(key)
                if child is None:
                    child = self.step[key] = len(parent)
                    parent.append(node)
                    letter.append(c)
                    depth.append(depth[node] + 1)
                node = child
            self.end[i] = node
        #: Nodes from the root outwards: a node's suffix stands before it.
        self.order = sorted(range(1, len(parent)), key=depth.__getitem__)
        self.suffix = [0] * len(parent)
        for node in self.order:
            if parent[node]:
                self.suffix[node] = self._move(self.suffix[parent[node]], letter[node])

    def _move(self, node: int, c: int) -> int:
        child = self.step.get(node * _ALPHABET + c)
        while child is None and node:
            node = self.suffix[node]
            child = self.step.get(node * _ALPHABET + c)
        return child or 0

    def nodes(self, text: str) -> set[int]:
        """The nodes that the text visits."""
        node, seen = 0, set()
        for c in map(ord, text):
            node = self._move(node, c)
            seen.add(node)
        return seen

    def _long_in(self, text: str) -> Iterator[int]:
        return (i for i in self.long if len(self.strings[i]) <= len(text) and self.strings[i] in text)

    def pairs(self, texts) -> Iterator[tuple[str, str]]:
        """Each string with each text that holds it."""
        ends = {node: i for i, node in self.end.items()}
        nearest = [0] * len(self.suffix)  # this node if a string ends here, else the next along the suffixes
        for node in self.order:
            nearest[node] = node if node in ends else nearest[self.suffix[node]]
        for text in texts:
            found = set()
            for node in self.nodes(text):
                node = nearest[node]
                while node and node not in found:
                    found.add(node)
                    node = nearest[self.suffix[node]]
            for node in found:
                yield self.strings[ends[node]], text
            for i in self._long_in(text):
                yield self.strings[i], text

    def first_inside(self, orders, texts) -> Iterator[tuple[str, int]]:
        """Each text that holds a string, with the lowest order of one."""
        least: list = [None] * len(self.suffix)
        for i, node in self.end.items():
            least[node] = orders[i]
        for node in self.order:
            least[node] = _lower(least[node], least[self.suffix[node]])
        for text in texts:
            best = None
            for node in self.nodes(text):
                best = _lower(best, least[node])
            for i in self._long_in(text):
                best = _lower(best, orders[i])
            if best is not None:
                yield text, best

    def first_holder(self, texts, orders) -> Iterator[tuple[str, int]]:
        """Each string that some text holds, with the lowest order of such a text."""
        least: list = [None] * len(self.suffix)
        held: dict[int, int] = {}
        for text, order in zip(texts, orders):
            for node in self.nodes(text):
                least[node] = _lower(least[node], order)
            for i in self._long_in(text):
                held[i] = _lower(held.get(i), order)
        for node in reversed(self.order):  # who visits a node has read its suffix too
            least[self.suffix[node]] = _lower(least[self.suffix[node]], least[node])
        for i, node in self.end.items():
            held[i] = least[node]
        for i, order in held.items():
            if order is not None:
                yield self.strings[i], order


def _lower(a, b):
    return b if a is None or (b is not None and b < a) else a


def _placed(short: DataFrame, long: DataFrame, s: str, t: str, block: int, share: int):
    """Both sides with the ``place`` where they meet.

    If the contained strings need several automata, each goes to the bucket of its rarest gram and a
    containing string to the buckets of its grams.  A bucket is a grid: its contained strings are cut
    into blocks, its containing strings into shares, and each block meets each share in one place.
    """
    buckets = -(-(short.agg(F.sum(F.char_length(s))).first()[0] or 0) // block)
    if buckets <= 1:
        shares = max(1, -(-(long.agg(F.sum(F.char_length(t))).first()[0] or 0) // share))
        grid = {"bucket": F.lit(0), "blocks": F.lit(1), "shares": F.lit(shares)}
        here, there = short.withColumns(grid), long.withColumns(grid)
    else:
        bucket = F.pmod(F.xxhash64("gram"), F.lit(buckets)).alias("bucket")
        keys = materialize(rarest_grams(short, long, s, t), "rarest")
        here = short.join(keys, s).select(*short.columns, bucket)
        held = skew_join(grams(long, t, True), keys.select("gram").distinct(), "gram", [t], "left_semi")
        there = held.select(*long.columns, bucket).distinct()
        here, there = materialize(here, "contained"), materialize(there, "containing")

        def cuts(side, col, size, name):
            return side.groupBy("bucket").agg(F.ceil(F.sum(F.char_length(col)) / size).cast("int").alias(name))
        grid = cuts(here, s, block, "blocks").join(cuts(there, t, share, "shares"), "bucket")
        if buckets <= FEW:
            here, there = here.join(F.broadcast(grid), "bucket"), there.join(F.broadcast(grid), "bucket")
        else:
            here, there = skew_join(here, grid, "bucket", [s], "inner"), skew_join(there, grid, "bucket", [t], "inner")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def one(col, n):
        return F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    here = here.withColumn("_share", every("shares")).withColumn("_block", one(s, "blocks"))
    there = there.withColumn("_block", every("blocks")).withColumn("_share", one(t, "shares"))
    place = F.struct("bucket", "_block", "_share").alias("place")
    return here.select(place, *short.columns), there.select(place, *long.columns)


def _meet(short, long, s, t, block, share, answer, schema) -> DataFrame:
    here, there = _placed(short, long, s, t, block, share)
    columns = [f.split(" ")[0] for f in schema]

    def run(a, b):
        rows = answer(Automaton(a[s]), a, b) if len(a) and len(b) else ()
        return pd.DataFrame(list(rows), columns=columns)
    # A place is few bytes but much work: Spark would join many places in a task by their bytes.
    n = int(short.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    here, there = here.repartition(n, "place"), there.repartition(n, "place")
    return here.groupBy("place").cogroup(there.groupBy("place")).applyInPandas(run, ", ".join(schema))


def _distinct(df: DataFrame, col: str, order: str | None = None) -> DataFrame:
    """Dealt to all cores: names are few bytes, so Spark would leave them, and the grams of all, to a task or two."""
    named = df.where(F.col(col) != "")
    once = named.select(col).distinct() if order is None else named.groupBy(col).agg(F.min(F.col(order).cast("long")).alias(order))
    return once.repartition(df.sparkSession.sparkContext.defaultParallelism, F.col(col))


def containing_pairs(short: DataFrame, long: DataFrame, s: str, t: str, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """Distinct ``s, t`` with ``s`` inside ``t``; null and empty strings are in no pair."""
    short, long = materialize(_distinct(short, s), "short"), materialize(_distinct(long, t), "long")
    return _meet(short, long, s, t, block, share, lambda a, x, y: a.pairs(y[t]), [f"{s} string", f"{t} string"])


def _holders(short, long, s, t, order, block, share):
    """Per place: each ``s`` with the lowest ``order`` of a ``t`` that contains it."""
    return _meet(short, long, s, t, block, share, lambda a, x, y: a.first_holder(y[t], y[order].tolist()), [f"{s} string", f"{order} long"])


def _inside(long, short, t, s, order, block, share):
    """Per place: each ``t`` with the lowest ``order`` of an ``s`` inside it."""
    return _meet(short, long, s, t, block, share, lambda a, x, y: a.first_inside(x[order].tolist(), y[t]), [f"{t} string", f"{order} long"])


def first_contained(long: DataFrame, short: DataFrame, t: str, s: str, order: str, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """For each distinct ``t``, the lowest ``order`` of an ``s`` inside it."""
    short, long = materialize(_distinct(short, s, order), "short"), materialize(_distinct(long, t), "long")
    return _inside(long, short, t, s, order, block, share).groupBy(t).agg(F.min(order).alias(order))


def first_overlap(left: DataFrame, right: DataFrame, a: str, b: str, order: str, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """For each distinct ``a``, the lowest ``order`` of a ``b`` that contains it or lies in it."""
    left, right = materialize(_distinct(left, a), "left"), materialize(_distinct(right, b, order), "right")
    both = _holders(left, right, a, b, order, block, share).unionByName(_inside(left, right, a, b, order, block, share))
    return both.groupBy(a).agg(F.min(order).alias(order))
