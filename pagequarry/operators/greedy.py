"""Counting in order with a limit per row: a row is taken while fewer were taken before it than it has room for.

Whether a row is taken depends on all rows before it.  But what a range of rows does to the count is a function
of the count at its start, ``T + n - (cuts at or below T)`` with one cut per row, and such functions can be
composed.  So ranges are summed up side by side, their starts are found by one fold, and each range is walked again.
"""

import sys
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, ranked

# The functions travel inside the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 100_000
_ROWS = 10_000


def cuts(rooms: Iterable[int]) -> list[int]:
    """The cuts of a range, sorted: from a count ``T`` at its start it takes one row less for each cut at or below ``T``."""
    found: list[int] = []
    for n, room in enumerate(rooms):
        # The row is passed over from the least start whose count, n rows later, fills its room.
        low, high = max(0, room - n), max(0, room)
        while low < high:
            middle = (low + high) // 2
            if middle + n - bisect_right(found, middle) >= room:
                high = middle
            else:
                low = middle + 1
        insort(found, low)
    return found


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of bounded number to a batch."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def taken_before(rows: DataFrame, group: str, order: str, room: str, width: int = WIDTH) -> DataFrame:
    """Adds ``taken``: how many rows of the group, in the order of a ``long`` unique in it, were taken
    before this one, where a row is taken if that number is below its ``room``.

    Four passes at most, whatever the rows.  Groups of up to ``width`` rows need one.  Of longer ones the
    cuts, one number a row, are read in order by the one task that folds a group, a range at a time.
    """
    placed = ranked(rows.select(group, order, room), order, [group], name="_n")
    placed = materialize(placed.withColumn("_range", F.floor((F.col("_n") - 1) / F.lit(width))), "placed")

    def in_order(df, *more):
        return df.repartition(group, "_range").sortWithinPartitions(group, "_range", order) \
            .select(group, "_range", F.col(order).cast("long"), F.col(room).cast("long"), *more)
    longer = placed.where("_range > 0").select(group).distinct()
    starts = None
    if not longer.isEmpty():
        numbers = pa.schema([("g", pa.string()), ("r", pa.int64()), ("c", pa.int64())])

        def summed(batches):
            def out():
                for (g, r), part in groupby(_rows(batches), itemgetter(0, 1)):
                    for c in cuts(x[3] for x in part):
                        yield g, r, c
            yield from _batches(out(), numbers)

        def folded(batches):
            def out():
                for g, ranges in groupby(_rows(batches), itemgetter(0)):
                    count = 0
                    for r, part in groupby(ranges, itemgetter(1)):
                        yield g, r, count
                        count += sum(x[2] > count for x in part)
            yield from _batches(out(), numbers)
        shape = f"{group} string, _range long, _cut long"
        long_cuts = in_order(placed.join(longer, group, "left_semi")).mapInArrow(summed, shape)
        starts = long_cuts.repartition(group).sortWithinPartitions(group, "_range").mapInArrow(
            folded, f"{group} string, _range long, _start long")

    known = placed.withColumn("_start", F.lit(0).cast("long")) if starts is None else \
        placed.join(materialize(starts, "starts"), [group, "_range"], "left").withColumn("_start", F.coalesce("_start", F.lit(0)))
    counted = pa.schema([("g", pa.string()), ("o", pa.int64()), ("t", pa.int64())])

    def walked(batches):
        def out():
            for (g, _), part in groupby(_rows(batches), itemgetter(0, 1)):
                count = None
                for _, _, o, room, start in part:
                    count = start if count is None else count
                    yield g, o, count
                    count += count < room
        yield from _batches(out(), counted)
    answers = in_order(known, F.col("_start").cast("long")).mapInArrow(walked, f"{group} string, {order} long, taken long")
    return rows.join(answers, [group, order])
