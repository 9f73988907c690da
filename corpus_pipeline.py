"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing and sharding of documents.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Near duplicates are documents
that share 80% of their five-word shingles.

Defined cases, for all stages: texts that are null, empty or without letters go with language ID; null and repeated ids
are told apart by their texts; of rows equal in id and text one stays; a null source is a source of its own; extra columns
stay whatever their names, but for those that sharding adds (size, text_crc32, shard, slot); empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineora.llm.common import cut
from lineora.llm.decontaminate import decontaminated
from lineora.llm.jaccard import one_of_each
from lineora.llm.langid import in_known_language
from lineora.llm.mixture import mixture
from lineora.llm.sharding import sharded


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones."""
    return in_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that with the smallest id."""
    return one_of_each(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row with a benchmark item."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """24 shards of near equal bytes, with a slot for each row."""
    return sharded(docs, shards=24, keep=True)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Learned vectors and a seeded selection are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
