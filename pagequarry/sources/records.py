"""Records that are longer than a line, read from files of any size by many tasks.

Spark's text source cuts a file into byte ranges at a separator, without knowing what the pieces mean: a
line break may lie inside a quoted cell, a brace inside a string, a line may continue the one before.  A
small automaton decides it, with two states (in quotes or not) and a depth, and it runs in parallel:

1. Each range is walked once from either state, and summed up in one row: where it ends, and how many
   records end in it at each depth.
2. The rows of a file's ranges, composed in order, give every range its true start (``starts``).
3. Each range is walked again from there and emits its records with their exact number.  Only the first and
   the last record of a range may go on in another one; those are glued by their number (``cut_records``).

Nothing is sorted or shuffled but these pieces, two a range.
"""

import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# The automata travel inside the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"  # a path is written with one or three slashes
_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*', re.DOTALL)
_STRINGS = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)

#: Walks a piece: (text, inside) -> inside after it, change of depth, whether a record may end (or start) here.
Machine = Callable[[str, bool], tuple[bool, int, bool]]


def csv_line(text: str, inside: bool) -> tuple[bool, int, bool]:
    """A line of CSV.  A quote opens a cell at its start only, and is doubled inside; a blank line is no record."""
    if not inside and '"' not in text:
        return False, 0, text.strip() != ""
    at = 0
    if not inside:
        at = 1 + text.startswith("\ufeff")  # the mark that some files begin with
        inside = text[at - 1] == '"'
        if not inside:
            at = text.find(',"') + 2
            inside = at > 1
    while inside:
        at = _QUOTED.match(text, at).end()
        if at >= len(text):
            return True, 0, False
        at = text.find(',"', at) + 2
        inside = at > 1
    return False, 0, True


def json_piece(text: str, inside: bool) -> tuple[bool, int, bool]:
    """What stands before a ``}``, and that brace."""
    at = 0
    if inside:
        at = _STRING.match(text).end()
        if at >= len(text) or text[at] != '"':  # the string goes on, or a lone backslash takes the brace
            return True, 0, False
        at += 1
    plain = _STRINGS.sub("", text[at:])
    open_at = plain.find('"')
    if open_at >= 0:
        plain = plain[:open_at]
    depth = plain.count("{") + plain.count("[") - plain.count("]")
    return (True, depth, False) if open_at >= 0 else (False, depth - 1, True)


def log_line(pattern: str) -> Machine:
    """A line that starts a record if it matches, else continues the one before."""
    head = re.compile(pattern)
    return lambda text, inside: (False, 0, head.match(text) is not None)


def pieces(spark, path: str, separator: str) -> DataFrame:
    """``path, block, value``: what stands between separators, with the byte range that it was read in."""
    return spark.read.option("lineSep", separator).text(path).select(
        F.regexp_replace("_metadata.file_path", _SCHEME, "").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], list[str], int]]:
    """The range, the values and the first row of each run of rows from one range."""
    paths, blocks, values = batch.column("path"), batch.column("block"), batch.column("value").to_pylist()
    if values and paths[0] == paths[-1] and blocks[0] == blocks[-1]:  # a task reads its ranges one after the other
        yield (paths[0].as_py(), blocks[0].as_py()), values, 0
        return
    paths, blocks, lo = paths.to_pylist(), blocks.to_pylist(), 0
    for hi in range(1, len(values) + 1):
        if hi == len(values) or blocks[hi] != blocks[lo] or paths[hi] != paths[lo]:
            yield (paths[lo], blocks[lo]), values[lo:hi], lo
            lo = hi


_SIDE = "inside boolean, depth long, ends map<long,long>"
_SUMMARY = f"path string, block long, head string, leads boolean, outer struct<{_SIDE}>, inner struct<{_SIDE}>"


def summaries(parts: DataFrame, machine: Machine) -> DataFrame:
    """One row per range: how it ends, entered outside (``outer``) or inside (``inner``) of quotes, its change of depth, and
    at each relative depth the number of pieces where a record may end; its first character; whether its first piece is no start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides, head, leads = None, [], "", False

        def row():
            side = [{"inside": s[0], "depth": s[1], "ends": list(s[2].items())} for s in sides]
            return {"path": now[0], "block": now[1], "head": head, "leads": leads, "outer": side[0], "inner": side[1]}

        def batch_of(rows):
            return pa.RecordBatch.from_pylist(rows, kind)
        side_type = pa.struct([("inside", pa.bool_()), ("depth", pa.int64()), ("ends", pa.map_(pa.int64(), pa.int64()))])
        kind = pa.schema([("path", pa.string()), ("block", pa.int64()), ("head", pa.string()), ("leads", pa.bool_()),
                          ("outer", side_type), ("inner", side_type)])
        for batch in batches:
            done = []
            for place, values, _ in _runs(batch):
                if place != now:
                    if now:
                        done.append(row())
                    now, sides, head = place, [[False, 0, Counter()], [True, 0, Counter()]], ""
                    leads = not machine(values[0], False)[2]
                for text in values:
                    head = head or text.lstrip("\ufeff \t\r\n")[:1]
                    for side in sides:
                        side[0], change, ended = machine(text, side[0])
                        side[1] += change
                        if ended:
                            side[2][side[1]] += 1
            if done:
                yield batch_of(done)
        if now:
            yield batch_of([row()])
    return parts.mapInArrow(run, _SUMMARY)


def starts(found: DataFrame, level: int | None) -> DataFrame:
    """``path, block, inside, depth, before, level``: the true state at the start of each range, and the records that end before it.

    The state in a file's later ranges is a composition of the earlier ones, over one row per range.  ``level`` is the
    depth between records; without one it is 1 in a file that opens an array, else 0.
    """
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # A range maps the two states to two: it keeps them, swaps them, or has one end.  The last range with one end,
    # and the swaps since, tell the state.
    one = F.col("outer.inside") == F.col("inner.inside")
    swap = (F.col("outer.inside") & ~F.col("inner.inside")).cast("int")
    swaps = F.coalesce(F.sum("_swap").over(earlier), F.lit(0))
    fixed = F.last("_fixed", ignorenulls=True).over(earlier)
    stated = found.withColumn("_swap", F.when(one, 0).otherwise(swap)) \
        .withColumn("_total", F.sum("_swap").over(W.partitionBy("path").orderBy("block"))) \
        .withColumn("_fixed", F.when(one, (F.col("outer.inside").cast("int") + F.col("_total")) % 2)) \
        .withColumn("inside", (F.coalesce(fixed, F.lit(0)) + swaps) % 2 == 1) \
        .withColumn("_side", F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))) \
        .withColumn("depth", F.coalesce(F.sum("_side.depth").over(earlier), F.lit(0)))
    opened = F.first(F.nullif("head", F.lit("")), ignorenulls=True).over(whole)
    stated = stated.withColumn("level", F.lit(level).cast("long") if level is not None else F.when(opened == "[", 1).otherwise(0).cast("long"))
    ended = F.coalesce(F.try_element_at("_side.ends", F.col("level") - F.col("depth")), F.lit(0))
    return stated.withColumn("_ended", ended).withColumn("before", F.coalesce(F.sum("_ended").over(earlier), F.lit(0))) \
        .withColumn("leads", F.first("leads").over(whole)) \
        .withColumn("records", F.sum("_ended").over(whole)) \
        .select("path", "block", "inside", "depth", "before", "level", "leads", "records")


_FRAGMENT = "path string, block long, idx long, whole boolean, ended boolean, value string"


def cut_records(spark, path: str, separator: str, machine: Machine, level: int | None = 0, leading: bool = False) -> DataFrame:
    """``path, idx, ended, value``: the records of all files under ``path``, numbered from 0 in each file.

    A record ends with a piece where the automaton says so at the depth ``level``; with ``leading`` a record starts there
    instead, and what stands before a file's first start is a record too.  What follows a file's last end is a last
    record that is not ``ended`` and may be blank.  The ranges' start states are sent to all tasks: one small row per input split.
    """
    parts = pieces(spark, path, separator)
    known = starts(summaries(parts, machine), level)
    entered = parts.join(F.broadcast(known.drop("records")), ["path", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth, between, idx, first, held = None, False, 0, 0, 0, 0, []
        kind = pa.schema([("path", pa.string()), ("block", pa.int64()), ("idx", pa.int64()), ("whole", pa.bool_()), ("ended", pa.bool_()), ("value", pa.string())])
        rows: list[tuple] = []

        def flush(last: bool) -> None:
            nonlocal held
            if held:
                rows.append((*now, idx, not last and idx != first, not last, separator.join(held)))
            held = []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

        for batch in batches:
            columns = {c: batch.column(c) for c in ("inside", "depth", "before", "level", "leads")}
            for place, values, at in _runs(batch):
                if place != now:
                    flush(True)
                    state = {c: v[at].as_py() for c, v in columns.items()}
                    now, inside, depth, between = place, state["inside"], state["depth"], state["level"]
                    idx = first = state["before"] - (leading and not state["leads"])
                for text in values:
                    inside, change, ended = machine(text, inside)
                    depth += change
                    cut = ended and depth == between
                    if leading and cut:
                        flush(False)
                        idx += 1
                    held.append(text)
                    if cut and not leading:
                        flush(False)
                        idx += 1
            if rows:
                yield batch_of()
                rows.clear()
        flush(True)
        if rows:
            yield batch_of()
    found = entered.mapInArrow(run, _FRAGMENT)
    glued = found.where("NOT whole").groupBy("path", "idx").agg(F.sort_array(F.collect_list(F.struct("block", "value"))).alias("parts"),
                                                                      F.max("ended").alias("ended")) \
        .select("path", "idx", "ended", F.array_join("parts.value", separator).alias("value"))
    return found.where("whole").select("path", "idx", "ended", "value").unionByName(glued)


def numbered(records: DataFrame, name: str, skip: int = 0) -> DataFrame:
    """``name, value``: records numbered from 0 over all files in path order, without the first ``skip`` of each file.

    The offsets have one row per file.
    """
    sizes = records.groupBy("path").agg((F.max("idx") + 1 - skip).alias("n"))
    before = W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("path", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return records.where(F.col("idx") >= skip).join(F.broadcast(offsets), "path").select((F.col("offset") + F.col("idx") - skip).alias(name), "value")
