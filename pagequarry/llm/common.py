"""Blocks that several operators share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.shared import components, materialize, skew_join  # noqa: F401


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of an Arrow batch.  Texts are long, and a batch lies in the JVM and in Python at once.
BATCH_ROWS, _DEFAULT_ROWS = 1000, "10000"


def small_batches(spark) -> None:
    """Smaller Arrow batches for tasks over texts, unless the session has set a size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``doc_id long, text string``, so that further columns cannot clash."""
    small_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(df: DataFrame) -> int:
    """Tasks of a shuffle, as the session sets them for its data."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def send(spark, thing):
    """Broadcasts an object by its attributes, so that tasks need not import its class."""
    return spark.sparkContext.broadcast(vars(thing))


def received(kind, sent):
    """The object of class ``kind`` that was sent."""
    thing = kind.__new__(kind)
    thing.__dict__.update(sent.value)
    return thing
