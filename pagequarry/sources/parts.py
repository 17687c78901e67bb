"""Tables of immutable parts under a manifest: an update rewrites only the parts that it touches.

    <folder>/data/version=<v>/part=<p>/...     rows of a part as version v wrote them
    <folder>/manifests/version=<v>/...         one file: for every part the version to read, and its rows

A version exists once its manifest does, and that is a single file which appears by one rename.  So a failed
update leaves the table as it was, a repeated one replaces what it wrote before, and older versions stay readable
as backups until ``expire``.  A manifest has one row per part; it is the only thing that the driver reads.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import last_per_key, materialize

_MANIFEST = "part long, source long, n long"


def versions(spark, folder: str) -> list[int]:
    """Committed versions, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifests")
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(path):
        return []
    names = [s.getPath() for s in system.listStatus(path) if s.getPath().getName().startswith("version=")]
    # Without its mark of success a manifest may be half written.
    return sorted(int(p.getName().split("=")[1]) for p in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark, folder: str, version: int | None = None) -> dict[int, tuple[int, int]]:
    """Per part the version that holds it and its rows; of the latest version without one given."""
    known = versions(spark, folder)
    if version is None:
        if not known:
            return {}
        version = known[-1]
    elif version not in known:
        raise ValueError(f"no version {version} in {folder}")
    rows = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifests/version={version}").collect()
    return {r.part: (r.source, r.n) for r in rows}


def _read(spark, folder: str, parts: dict[int, tuple[int, int]], schema) -> DataFrame:
    paths = [f"{folder}/data/version={source}/part={part}" for part, (source, n) in sorted(parts.items()) if n]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark, folder: str, schema, version: int | None = None) -> DataFrame:
    """The table as of a version: one set of files per part."""
    return _read(spark, folder, manifest(spark, folder, version), schema)


def commit(rows: DataFrame, folder: str, version: int, touched: list[int], base: dict[int, tuple[int, int]]) -> None:
    """Writes the new content of the touched parts (rows with a column ``part``), then the manifest."""
    spark = rows.sparkSession
    data = f"{folder}/data/version={version}"
    rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(data)
    try:
        sizes = {r.part: r.n for r in spark.read.parquet(data).groupBy(F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n")).collect()}
    except AnalysisException:  # no rows at all, so no file to tell a schema
        sizes = {}
    new = {p: v for p, v in base.items() if p not in touched} | {p: (version, sizes.get(p, 0)) for p in touched}
    entries = spark.createDataFrame([(p, s, n) for p, (s, n) in sorted(new.items())], _MANIFEST)
    entries.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifests/version={version}")


def upsert(rows: DataFrame, folder: str, version: int, keys: list[str], order: Column, buckets: int = 64) -> bool:
    """Merges rows into a table whose parts are hash buckets of the keys: the last row of a key by ``order`` replaces it.

    Only the buckets that the rows fall into are read and written.  A version that is committed already stays as it is,
    so a repeated micro-batch changes nothing.  Returns whether it wrote one.
    """
    spark = rows.sparkSession
    if version in versions(spark, folder):
        return False
    before = [v for v in versions(spark, folder) if v < version]
    base = manifest(spark, folder, before[-1]) if before else {}
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    new = materialize(last_per_key(rows.withColumn("_order", order), keys, F.col("_order")).drop("_order").withColumn("part", bucket), "upsert")
    touched = [r.part for r in new.select("part").distinct().collect()]
    old = _read(spark, folder, {p: base[p] for p in touched if p in base}, rows.schema)
    # A struct with a NULL inside still equals itself, so NULL is a key like any other.
    kept = old.withColumn("_key", F.struct(*keys)).join(new.select(F.struct(*keys).alias("_key")), "_key", "left_anti") \
        .drop("_key").withColumn("part", bucket)
    commit(kept.unionByName(new), folder, version, touched, base)
    return True


def create_by_range(rows: DataFrame, folder: str, order: str, width: int) -> None:
    """Version 0 of a table whose parts are ranges of ``width`` numbers of a long column."""
    placed = rows.withColumn("part", F.floor(F.col(order) / width))
    commit(placed, folder, 0, [r.part for r in placed.select("part").distinct().collect()], {})


def update_by_range(updated: DataFrame, folder: str, order: str, width: int) -> int | None:
    """Writes the parts in which a row is ``changed`` (a boolean column of ``updated``, which holds the whole table).

    Returns the new version, or None if no row changed.  The version before it is the backup.
    """
    spark = updated.sparkSession
    placed = updated.withColumn("part", F.floor(F.col(order) / width))
    touched = [r.part for r in placed.where("changed").select("part").distinct().collect()]
    if not touched:
        return None
    known = versions(spark, folder)
    changed = placed.join(F.broadcast(spark.createDataFrame([(p,) for p in touched], "part long")), "part", "left_semi")
    commit(changed.drop("changed"), folder, known[-1] + 1, touched, manifest(spark, folder, known[-1]))
    return known[-1] + 1


def expire(spark, folder: str, keep: int) -> list[int]:
    """Removes all but the last ``keep`` versions, and the data that no version left needs.  Returns the versions removed."""
    known = versions(spark, folder)
    gone, left = known[:-keep], known[-keep:]
    needed = {(part, source) for v in left for part, (source, n) in manifest(spark, folder, v).items() if n}
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for v in gone:
        held = {(part, source) for part, (source, n) in manifest(spark, folder, v).items() if n}
        for part, source in held - needed:
            system.delete(path(f"{folder}/data/version={source}/part={part}"), True)
        system.delete(path(f"{folder}/manifests/version={v}"), True)
    return gone
