"""Streaming counts: new read files update the abundance table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmer import bin_counts
from ..operators.abundance import saturated


def stream_bin_counts(texts: DataFrame, out: str, checkpoint: str, key: str, text: str, k: int, bits: int):
    """Write the bin counts of each micro-batch of a stream as a part of a table; counts of parts add up.

    A batch's part is named by its number, so a batch that is run again after a failure replaces its own part.
    """

    def write(batch: DataFrame, number: int) -> None:
        bin_counts(batch, key, text, k, bits).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_counts(spark, out: str, key: str) -> DataFrame:
    """(sample, bin, cnt) of all batches so far."""
    return saturated(spark.read.parquet(out).select(F.col(key).alias("sample"), "bin", "cnt"))
