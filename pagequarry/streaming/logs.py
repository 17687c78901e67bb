"""Log records out of a stream of text files, where a record may go on in the next file or micro-batch.

Lines are joined inside each byte range by a narrow pass.  What a range can't tell are its two ends: lines that
continue an earlier record, and a last record that may go on.  Only these reach the stateful operator, keyed by
log, which holds one open record per log.  A timer gives the record up when its log has been quiet.
"""

import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.report import log_level
from ..sources import files
from ..sources.records import _SCHEME, _runs, log_line
from . import streams

# The processor travels inside the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Parts of a range: lines before its first record, its last record, and the whole ones between.
HEAD, LAST, WHOLE = 0, 1, 2


def log_stream(spark, folder: str, files_per_batch: int = 100) -> DataFrame:
    """``path, block, arrived, value`` of the lines of all files below a folder, in micro-batches by modification time."""
    lines = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.regexp_replace("_metadata.file_path", _SCHEME, "").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                        F.current_timestamp().alias("arrived"), F.regexp_replace("value", r"\r\z", "").alias("value"))


def fragments(lines: DataFrame, head: str = files.LOG_HEAD) -> DataFrame:
    """``path, block, part, arrived, value``: the records of each range, and the pieces at its ends."""
    starts = log_line(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, arrived, held, rows = None, HEAD, None, [], []

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                              ["path", "block", "part", "arrived", "value"])
        types = [pa.string(), pa.int64(), pa.int32(), pa.timestamp("us", "UTC"), pa.string()]
        for batch in batches:
            for place, values, at in _runs(batch):
                if place != now:
                    if held:
                        rows.append((*now, part, arrived, "\n".join(held)))
                    now, part, held, arrived = place, HEAD, [], batch.column("arrived")[at].as_py()
                for text in values:
                    if starts(text, False)[2]:
                        if held:
                            rows.append((*now, HEAD if part == HEAD else WHOLE, arrived, "\n".join(held)))
                        part, held = LAST, []
                    held.append(text)
            if rows:
                yield batch_of()
                rows.clear()
        if held:
            rows.append((*now, part, arrived, "\n".join(held)))
            yield batch_of()
    return lines.select("path", "block", "arrived", "value").mapInArrow(run, "path string, block long, part int, arrived timestamp, value string")


class OpenRecord(StatefulProcessor):
    """Holds the open record of each log; appends continuation lines to it, and emits it when the next one starts or the
    log has been quiet for ``quiet`` seconds of arrival time."""

    def __init__(self, quiet: float):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "value string")

    def _timer(self, at=None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(int((at.timestamp() + self.quiet) * 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["path", "block", "part"])  # two rows a range at most
        open_one = self.held.get()[0] if self.held.exists() else None
        done = []
        for part, value in zip(batch["part"], batch["value"], strict=True):
            if part == HEAD:  # without an open record it stands alone, never lost
                open_one = value if open_one is None else f"{open_one}\n{value}"
            else:
                if open_one is not None:
                    done.append(open_one)
                open_one = value
        self.held.update((open_one,))
        self._timer(batch["arrived"].max())
        yield pd.DataFrame({"log": [key[0]] * len(done), "value": done}, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            value = self.held.get()[0]
            self.held.clear()
            yield pd.DataFrame({"log": [key[0]], "value": [value]}, dtype=object)

    def close(self) -> None:
        pass


def log_records(lines: DataFrame, log: Column, quiet: float = 60, name: str = "log_records") -> DataFrame:
    """``log, value, batch, place`` of all records that arrived: whole ones at once, a file's last one when it is known to be
    complete.  At the end of the input the records still open are read out of the state, with the batch null.

    ``log`` tells from ``path`` which files follow each other; theirs must arrive in order (in a batch: by path).
    """
    spark = lines.sparkSession
    cut = fragments(lines).withColumn("log", log)
    ends = cut.where(F.col("part") != WHOLE).withWatermark("arrived", "0 seconds").groupBy("log") \
        .transformWithStateInPandas(OpenRecord(quiet), "log string, value string", "append", "eventTime")
    with streams.rocksdb(spark):
        found, checkpoint = streams.run_at(cut.where(F.col("part") == WHOLE).select("log", "value").unionByName(ends), "append", name)
    try:
        held = spark.read.format("statestore").option("stateVarName", "held").load(checkpoint).select(F.col("key.log").alias("log"), "value.value")
    except AnalysisException:  # no batch ran
        return found
    return found.unionByName(held, allowMissingColumns=True)


def log_levels(lines: DataFrame, log: Column, quiet: float = 60) -> DataFrame:
    """Records per hour and level; the level is that of the whole record, the hour that of its first line."""
    records = files.log_fields(log_records(lines, log, quiet))
    return records.groupBy(F.date_trunc("hour", "at").cast("timestamp_ntz").alias("hour"), log_level("value").alias("level")).agg(F.count("*").alias("n"))
