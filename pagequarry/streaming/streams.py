"""Structured Streaming forms.  All take any streaming DataFrame, run to the end
of the available input, and return the table their sink wrote.

Checkpoints and sinks live in the shared folder.  Each micro-batch writes its
own directory named by the batch id, so a repeated batch replaces itself.
"""

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.records import page_fields
from ..operators.shared import last_per_key, new_path
from ..functions.urls import normalize_url
from ..sources import parts


def table_stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder as a stream, be it one file or a folder of part files.  A stream's plain path must be a
    folder; a pattern may name either."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def folder_stream(spark, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream of micro-batches."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run(stream: DataFrame, mode: str, name: str, prepare=None) -> DataFrame:
    """``run_at`` without the checkpoint."""
    return run_at(stream, mode, name, prepare)[0]


def run_at(stream: DataFrame, mode: str, name: str, prepare=None) -> tuple[DataFrame, str]:
    """Write each micro-batch to ``batch=<id>`` and read all of them back, with the
    row's ``place`` in its batch.  ``prepare(batch, before)`` may change a batch;
    ``before`` has the rows of the earlier ones.  Also returns the checkpoint."""
    spark = stream.sparkSession
    folder = new_path(spark, name)
    schema = T.StructType([*stream.schema.fields, T.StructField("place", T.LongType())])

    def read():
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/out")

    def save(batch, batch_id):
        if prepare:
            # Batches are numbered from 0; a repeated one does not see its own earlier rows.
            before = read().where(F.col("batch") < batch_id) if batch_id else batch.limit(0)
            batch = prepare(batch, before)
        batch.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    query = (stream.writeStream.outputMode(mode).queryName(folder.rsplit("/", 1)[-1].replace("-", "_"))
             .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
             .foreachBatch(save).start())
    query.awaitTermination()
    return read(), f"{folder}/checkpoint"


def latest(df: DataFrame, keys) -> DataFrame:
    """Newest state of each key: of the last batch, and there of the last row."""
    return last_per_key(df, keys, F.struct("batch", "place")).drop("batch", "place")


def progress(results: DataFrame, failed, total: int, time: str) -> DataFrame:
    """Completed, succeeded and failed so far, their share of ``total``, and the time from the
    first to the last result."""
    at = F.unix_seconds(F.col(time).cast("timestamp"))
    counts = results.agg(F.count("*").alias("completed"), F.count_if(~failed).alias("success"),
                         F.count_if(failed).alias("failed"), (F.max(at) - F.min(at)).alias("seconds")).withColumn("job", F.lit(0))
    now = latest(run(counts, "update", "progress"), ["job"]).drop("job")
    share = F.when(F.lit(total) > 0, F.col("completed") / total * 100).otherwise(F.lit(0.0))

    def unit(size, within, letter):
        n = F.floor((F.col("seconds") % within if within else F.col("seconds")) / size)
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(letter)))
    elapsed = F.concat_ws(" ", unit(3600, None, "h"), unit(60, 3600, "m"), F.concat((F.col("seconds") % 60).cast("string"), F.lit("s")))
    return now.withColumns({"percent": share, "elapsed": elapsed}).drop("seconds")


@contextmanager
def rocksdb(spark):
    """State in RocksDB, which keeps keys on disk and checkpoints only what changed."""
    settings = {"providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
                "rocksdb.changelogCheckpointing.enabled": "true"}
    before = {f"spark.sql.streaming.stateStore.{k}": spark.conf.get(f"spark.sql.streaming.stateStore.{k}", None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(f"spark.sql.streaming.stateStore.{k}", v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def new_urls(urls: DataFrame, known: DataFrame, keep: str | None = None) -> DataFrame:
    """Arriving URLs that are not known: each once.  What arrived before is looked up by key in the state store, so a
    batch reads nothing of the earlier ones.  With ``keep``, a URL is forgotten that long after it arrived."""
    arriving = urls.where(F.trim("url") != "").select(normalize_url("url").alias("url")).join(known.select("url").distinct(), "url", "left_anti")
    if keep:
        once = arriving.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["url"]).select("url")
    else:
        once = arriving.dropDuplicates(["url"])
    with rocksdb(urls.sparkSession):
        return run(once, "append", "new_urls").drop("batch", "place")


def first_seen(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once, with state bounded by the watermark."""
    timed = events.select(key, F.col(time).cast("timestamp").alias("at")).withWatermark("at", delay)
    return run(timed.dropDuplicatesWithinWatermark([key]).select(key), "append", "first_seen").drop("batch", "place")


def upsert_stream(stream: DataFrame, folder: str, keys, buckets: int = 64) -> DataFrame:
    """Merges arriving rows by key into the table of parts in ``folder``; the last that arrived stays.  A micro-batch is one
    version of the table, so a repeated one changes nothing and a failed one leaves the version before it."""
    def save(batch, batch_id):
        parts.upsert(batch, f"{folder}/table", batch_id, list(keys), F.monotonically_increasing_id(), buckets)

    query = (stream.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).foreachBatch(save).start())
    query.awaitTermination()
    return parts.read_table(stream.sparkSession, f"{folder}/table", stream.schema)


def extract_upsert(pages: DataFrame, buckets: int = 64) -> DataFrame:
    """Fields of arriving pages, merged by page: the last version that arrived replaces a page's record."""
    return upsert_stream(page_fields(pages), new_path(pages.sparkSession, "extract"), ["page_id"], buckets)
