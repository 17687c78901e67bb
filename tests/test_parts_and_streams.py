"""Tables of parts under a manifest, and the streams that keep them or hold state."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

from pagequarry.operators.report import log_level
from pagequarry.sources import files, parts
from pagequarry.streaming import logs, streams

SCHEMA = "k long, v string"


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def files_of(folder):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{folder}/data/**/*.parquet", recursive=True)}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string, n long")


def test_upsert_keeps_the_last_row_and_touches_few_buckets(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), frame(spark, []).schema
    assert parts.versions(spark, folder) == [] and parts.read_table(spark, folder, schema).count() == 0
    parts.upsert(frame(spark, [(k, "a", 0) for k in range(100)] + [(5, "b", 1), (5, "c", 2), (None, "n", 0)]), folder, 0, ["k"], F.col("n"), 16)
    want = {k: "a" for k in range(100)} | {5: "c", None: "n"}
    assert {r.k: r.v for r in parts.read_table(spark, folder, schema).collect()} == want
    before = files_of(folder)
    assert parts.upsert(frame(spark, [(7, "x", 0)]), folder, 1, ["k"], F.col("n"), 16)
    assert len(set(files_of(folder)) - set(before)) == 1  # one bucket
    assert {r.k: r.v for r in parts.read_table(spark, folder, schema).collect()} == want | {7: "x"}
    assert {r.k: r.v for r in parts.read_table(spark, folder, schema, 0).collect()} == want  # the version before
    now = files_of(folder)
    assert not parts.upsert(frame(spark, [(7, "again", 0)]), folder, 1, ["k"], F.col("n"), 16)
    assert files_of(folder) == now
    assert not parts.upsert(frame(spark, [(8, "late", 0)]), folder, 0, ["k"], F.col("n"), 16)


def test_null_is_a_key_like_any_other(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), frame(spark, []).schema
    for v in range(3):
        parts.upsert(frame(spark, [(None, f"n{v}", 0), (1, f"a{v}", 0)]), folder, v, ["k"], F.col("n"), 4)
    assert rows_of(parts.read_table(spark, folder, schema).where("k = 1")) == [(1, "a2", 0)]
    assert parts.read_table(spark, folder, schema).where("k is null").count() == 1


def test_a_failed_update_leaves_the_table(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), frame(spark, []).schema
    parts.upsert(frame(spark, [(1, "a", 0), (2, "b", 0)]), folder, 0, ["k"], F.col("n"), 4)
    bad = frame(spark, [(1, "c", 0), (3, "d", 0)]).withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("stop"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="stop"):
        parts.upsert(bad, folder, 1, ["k"], F.col("n"), 4)
    # Data without a manifest, as of a driver that was lost before the commit, is not seen and is replaced.
    frame(spark, [(1, "torn", 0)]).withColumn("part", F.lit(0)).write.partitionBy("part").mode("overwrite").parquet(f"{folder}/data/version=1")
    assert rows_of(parts.read_table(spark, folder, schema)) == [(1, "a", 0), (2, "b", 0)]
    parts.upsert(frame(spark, [(1, "c", 0)]), folder, 1, ["k"], F.col("n"), 4)
    assert rows_of(parts.read_table(spark, folder, schema)) == [(1, "c", 0), (2, "b", 0)]


def test_one_changed_row_rewrites_one_part(spark, tmp_path):
    folder = str(tmp_path / "t")
    table = spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    parts.create_by_range(table, folder, "k", 100)
    before = files_of(folder)
    unchanged = table.withColumn("changed", F.lit(False))
    assert parts.update_by_range(unchanged, folder, "k", 100) is None and files_of(folder) == before
    one = table.withColumn("changed", F.col("k") == 250).withColumn("v", F.when(F.col("changed"), "b").otherwise(F.col("v")))
    assert parts.update_by_range(one, folder, "k", 100) == 1
    new = set(files_of(folder)) - set(before)
    assert len(new) == 1 and "version=1/part=2/" in new.pop()
    assert parts.read_table(spark, folder, table.schema).where("v = 'b'").count() == 1
    assert parts.read_table(spark, folder, table.schema, 0).where("v = 'a'").count() == 1000
    with pytest.raises(ValueError):
        parts.read_table(spark, folder, table.schema, 7)


def test_expire_removes_what_no_version_needs(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), frame(spark, []).schema
    for v in range(5):
        parts.upsert(frame(spark, [(v % 2, f"v{v}", 0), (10 + v, "x", 0)]), folder, v, ["k"], F.col("n"), 8)
    want = rows_of(parts.read_table(spark, folder, schema))
    assert parts.expire(spark, folder, 2) == [0, 1, 2] and parts.versions(spark, folder) == [3, 4]
    assert rows_of(parts.read_table(spark, folder, schema)) == want
    parts.upsert(frame(spark, [(k, "y", 0) for k in range(20)]), folder, 5, ["k"], F.col("n"), 8)
    parts.expire(spark, folder, 1)
    assert all("version=5" in f for f in files_of(folder)) and parts.read_table(spark, folder, schema).count() == 20


def arrive(spark, folder, batches, schema):
    """One file per batch, with later modification times."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)


def test_stream_upserts_equal_the_last_of_each_key(spark, tmp_path):
    batches = [[(k, f"{b}-{k}") for k in range(b, b + 5)] + [(b, f"{b} again")] for b in range(6)]
    arrive(spark, str(tmp_path / "in"), batches, SCHEMA)
    folder = str(tmp_path / "out")
    got = streams.upsert_stream(streams.folder_stream(spark, str(tmp_path / "in")), folder, ["k"], 8)
    want = {}
    for rows in batches:
        want |= dict(rows)
    assert {r.k: r.v for r in got.collect()} == want
    assert parts.versions(spark, f"{folder}/table") == list(range(6))
    # A later run continues from the checkpoint and adds only the new file.
    arrive(spark, str(tmp_path / "in"), [[(0, "new")]], SCHEMA)
    got = streams.upsert_stream(streams.folder_stream(spark, str(tmp_path / "in")), folder, ["k"], 8)
    assert {r.k: r.v for r in got.collect()} == want | {0: "new"} and parts.versions(spark, f"{folder}/table")[-1] == 6


def test_new_urls_reads_no_earlier_batch(spark, tmp_path):
    batches = [[(f"u{k}.example.com",) for k in range(b * 3, b * 3 + 6)] + [(" ",), (None,)] for b in range(6)]
    arrive(spark, str(tmp_path / "in"), batches, "url string")
    known = spark.createDataFrame([("https://u4.example.com",), ("https://u4.example.com",)], "url string")
    read = []
    from pyspark.sql.streaming import StreamingQueryListener

    class Rows(StreamingQueryListener):
        def onQueryStarted(self, event): pass
        def onQueryIdle(self, event): pass
        def onQueryTerminated(self, event): pass
        def onQueryProgress(self, event): read.append(sum(s.numInputRows for s in event.progress.sources))
    listener = Rows()
    spark.streams.addListener(listener)
    try:
        got = sorted(r.url for r in streams.new_urls(streams.folder_stream(spark, str(tmp_path / "in")), known).collect())
        time.sleep(1)
    finally:
        spark.streams.removeListener(listener)
    assert got == sorted(f"https://u{k}.example.com" for k in range(21) if k != 4)
    assert len(read) >= 6 and max(read) <= 8  # the input of a batch, never the rows before it


LINES = ["2024-01-02 03:04:{:02d},000 - INFO - one", "Traceback", "  ERROR: deep", "2024-01-02 04:04:{:02d},000 - WARNING - two", "2024-01-02 05:00:{:02d},000 - INFO - x"]


@pytest.mark.parametrize("cut", [2, 3])
def test_records_cut_between_batches_equal_the_batch_answer(spark, tmp_path, cut):
    text = ["still from before", *[line.format(k) for k in range(6) for line in LINES], "its last line"]
    for k, lo in enumerate(range(0, len(text), cut * 7)):
        for name in ("a", "b"):
            (tmp_path / "in" / name).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / name / f"{k:03d}.log").write_text("\n".join(text[lo:lo + cut * 7]) + "\n")
        time.sleep(0.01)
    (tmp_path / "whole.log").write_text("\n".join(text) + "\n")
    log = F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1)
    got = logs.log_records(logs.log_stream(spark, str(tmp_path / "in"), 4), log)
    batch = [r.value for r in files.log_records(spark, str(tmp_path / "whole.log")).collect()]
    assert sorted((r.log, r.value) for r in got.collect()) == sorted((n, v) for n in "ab" for v in batch)
    levels = files.log_fields(files.log_records(spark, str(tmp_path / "whole.log"))).groupBy(
        F.date_trunc("hour", "at").cast("timestamp_ntz").alias("hour"), log_level("value").alias("level")).agg((2 * F.count("*")).alias("n"))
    assert set(map(tuple, logs.log_levels(logs.log_stream(spark, str(tmp_path / "in"), 4), log).collect())) == set(map(tuple, levels.collect()))


def test_a_quiet_log_is_flushed_by_its_timer(spark, tmp_path):
    for k in range(4):
        name = "quiet" if k == 0 else "busy"
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}-{k}.log").write_text(f"2024-01-02 03:04:0{k},000 - INFO - {name} {k}\n more\n")
        time.sleep(0.02)
    log = F.regexp_extract("path", r"/([a-z]+)-\d+\.log$", 1)
    got = logs.log_records(logs.log_stream(spark, str(tmp_path / "in"), 1), log, quiet=0).collect()
    quiet = [r for r in got if r.log == "quiet"]
    assert len(quiet) == 1 and quiet[0].batch is not None and quiet[0].value.endswith("quiet 0\n more")
    assert len(got) == 4
