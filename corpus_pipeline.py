"""The corpus pipeline: toxic documents go, then copies, near copies and benchmark passages; the rest is encoded.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept.
All but the last return the columns of the documents.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagequarry.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from pagequarry.llm.common import materialize, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a classifier learned from ``labels`` calls toxic."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays, ignoring the case of A-Z: the largest id."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the smallest id."""
    return simhash.drop_near(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash_near_dedup", near),
          ("benchmark_decontamination", clean), ("bpe_encoding", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each one's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
