"""Gram matrix and eigenspace kept up by micro-batches of whole bins.

A batch is a part: its Gram matrix, or its own truncated decomposition, named by the batch's number, so that a batch that runs
again replaces its part and nothing counts twice. Gram matrices of parts add up. Decompositions merge: side by side, the left
vectors of all parts times their singular values have the singular values and left vectors of all bins together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import spectral, svd
from ..plans.stored import stored


def _by_batch(entries: DataFrame, checkpoint: str, write):
    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_gram(entries: DataFrame, out: str, checkpoint: str):
    """Write the Gram matrix of each micro-batch of a stream of (sample, bin, x). A bin's entries come in one batch."""

    def write(batch: DataFrame, number: int) -> None:
        spectral.gram(stored(batch.select("sample", "bin", "x"), "gram-batch")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _by_batch(entries, checkpoint, write)


def streamed_gram(spark: SparkSession, out: str) -> DataFrame:
    """(sample_i, sample_j, g) of all batches so far."""
    return spark.read.parquet(out).groupBy("sample_i", "sample_j").agg(F.sum("g").alias("g"))


def stream_eigenspace(entries: DataFrame, out: str, checkpoint: str, rank: int):
    """Write the leading left vectors and singular values of each micro-batch of a stream of (sample, bin, x)."""

    def write(batch: DataFrame, number: int) -> None:
        found = svd.decompose(stored(batch.select("sample", "bin", "x"), "svd-batch"), rank)
        found.frame().write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _by_batch(entries, checkpoint, write)


def streamed_eigenspace(spark: SparkSession, out: str, rank: int) -> svd.Decomposition:
    """The decomposition of all batches so far: exact where no batch has more than its rank, else of what its rank holds."""
    parts = spark.read.parquet(out)
    beside = parts.select("sample", F.concat_ws(":", "batch", "dim").alias("bin"), (F.col("u") * F.col("s")).alias("x"))
    return svd.decompose(stored(beside, "svd-parts"), rank)
