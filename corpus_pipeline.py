"""The corpus pipeline: language, near-duplicates, benchmark passages, mix, shards.

Each stage takes what the one before it kept, as written and read again, and calls one operator of
``strandloom.llm``. All stages but the last return the columns of ``documents``; the last one returns where each
row of the mix goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontam, dedup, langid, mixing, sharding
from strandloom.llm.runtime import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier doesn't reject. Null, empty and letterless texts go; null ids and repeated rows are
    judged by their text, and an empty table stays empty."""
    return langid.accepted(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more. Rows without an id stay,
    different texts of one id are different documents, texts without words are no duplicates of others."""
    return dedup.distinct_documents(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a stretch that holds 0.8 or more of a benchmark item's five-word shingles. Null and empty texts and null
    ids stay, and all documents do where the benchmark is empty."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents left out, taken once, or taken twice. A null source is a source of its own; a text without
    words weighs nothing; rows of one id go the same way."""
    return mixing.mixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix; copies of a text share a shard, null texts are one group, repeated rows have slots
    of their own."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language", known_language),
    ("near-dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", sharded),
]

#: A trained model, components of a graph and a heap's schedule have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
