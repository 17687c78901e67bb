"""Building blocks that keep joins, ranks and lineage safe at scale."""

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: A lookup table that measures at most this is sent to all tasks.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Without that setting a local session (one process, so every folder is shared)
    gets a temporary one; on a cluster it is an error, because each executor
    would write to its own disk and the read-back would miss rows.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="pagequarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "step", **options) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage, survives
    lost executors, and lets later steps read only the columns they need.
    ``options`` go to the Parquet writer."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def skew_join(left: DataFrame, right: DataFrame, key: str, spread_by=None, how: str = "left") -> DataFrame:
    """Join on one column when a few keys may hold most of the left rows.

    Every left row gets one of as many salts as there are shuffle partitions.
    The distinct ``(key, salt)`` pairs, few per key however hot it is, look the
    right side up; their answers then meet the left rows on both columns, so a
    hot key fills all partitions evenly.  Rows without a key cannot match and
    bypass the join.  Nothing is listed, counted or broadcast.

    ``spread_by`` names columns that tell left rows apart, so that a task run
    again sends each row to the same place; without it the salt follows the
    row's position in its input split.  The left side is read twice:
    materialize it first if it is expensive.
    """
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.xxhash64(*spread_by) if spread_by else F.monotonically_increasing_id()
    keyed = left.where(F.col(key).isNotNull()).withColumn("_salt", F.pmod(number, F.lit(salts)).cast("int"))
    answers = keyed.select(key, "_salt").distinct().join(right, key)
    joined = keyed.join(answers, [key, "_salt"], how).drop("_salt")
    if how not in ("left", "left_anti"):
        return joined
    return joined.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)


def measured(df: DataFrame, name: str = "lookup") -> tuple[DataFrame, int]:
    """The table, written as by ``materialize``, and about the bytes that it takes in
    memory, counted while it is written.  A task run again can only count twice."""
    values = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in df.columns]
    seen = Observation()
    width = 32 + 24 * len(values)
    written = materialize(df.observe(seen, F.sum(sum(values, F.lit(width).cast("long"))).alias("bytes")), name)
    return written, seen.get["bytes"] or 0


def lookup_join(left: DataFrame, right: DataFrame, key: str, spread_by=None, how: str = "left", limit: int | None = None,
                kept: str | None = None) -> DataFrame:
    """``skew_join`` for a right side that is often small, with scalar columns and one row per key.

    The right side is written and measured.  Up to ``limit`` bytes it is sent to the tasks and
    the left side is read once and not shuffled; beyond, the join is salted, and written if it is
    to be ``kept`` under a name for several reads.
    """
    table, size = measured(right)
    if size <= (BROADCAST_BYTES if limit is None else limit):
        return left.join(F.broadcast(table), key, how)
    joined = skew_join(left, table, key, spread_by, how)
    return materialize(joined, kept) if kept else joined


def components(links: DataFrame) -> DataFrame:
    """Connected components of links ``a long, b long`` as ``node, component`` (the smallest node).

    Alternating star contraction: each round ties larger neighbours, then smaller
    ones, to the smallest neighbour, until every node hangs on its root.  Each
    star is an aggregate and a join on ids; a node with very many links is split
    by the join's salts.  Rounds grow with the logarithm of a component's size.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = both.groupBy("u").agg(F.min("v").alias("m"))
        large = skew_join(both, small, "u", ["v"], "inner").where("v > u") \
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = materialize(large, "stars")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = skew_join(large, small, "u", ["v"], "inner").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = materialize(tied.where("u != v").distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def running_total(df: DataFrame, order: str, value: Column, keys=(), name: str = "total",
                  width: int = 1_000_000) -> DataFrame:
    """Inclusive running sum in the order of a ``long`` that is unique per key.

    A window without keys, or with one hot key, would sort in a single task.
    Here the order is cut into ranges of ``width``; a range holds at most
    ``width`` rows of a key because the order is unique.  Sums run inside each
    range, and the running total over the ranges (one row per key and range)
    gives each range its offset.
    """
    df = df.withColumns({"_value": value.cast("long"), "_key": F.struct(F.lit(0).alias("all"), *keys),
                         "_range": F.floor(F.col(order) / F.lit(width))})
    # One column for key and range: the window's shuffle also serves the join,
    # and a struct with a NULL inside still equals itself.
    df = df.withColumn("_part", F.struct("_key", "_range"))
    before = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = df.groupBy("_part").agg(F.sum("_value").alias("_sum")).select("_part", "_part.*", "_sum") \
        .select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    summed = df.withColumn("_at", F.sum("_value").over(inside)).drop("_value", "_key", "_range")
    return summed.join(offsets, "_part").withColumn(name, F.col("_offset") + F.col("_at")) \
        .drop("_part", "_offset", "_at")


def ranked(df: DataFrame, order: str, keys=(), name: str = "rank", width: int = 1_000_000) -> DataFrame:
    """Exact 1-based row number over a unique ``long`` order, overall or per key."""
    return running_total(df, order, F.lit(1), keys, name, width)


def first_per_key(df: DataFrame, keys, order: Column) -> DataFrame:
    """The first row of each key, by an aggregate with map-side combine.  A whole row
    as its value makes Spark sort rather than hash, so keep the columns few."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def last_per_key(df: DataFrame, keys, order: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def one_per_key(df: DataFrame, keys, order: str = "pos") -> DataFrame:
    """One row per key, as in a map: the last by ``order`` where there is such a
    column, else the greatest of the other columns."""
    rest = [c for c in df.columns if c not in keys]
    return last_per_key(df, keys, F.col(order) if order in rest else F.struct(*rest)).drop(order)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
