"""Sinks: partitioned FASTQ text, FASTA, tables and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fastq_text(reads: DataFrame) -> DataFrame:
    """One row of four lines for each read, before its other columns."""
    record = F.concat_ws("\n", "id", "seq", "plus", "qual").alias("value")
    return reads.select(record, *[c for c in reads.columns if c not in ("id", "seq", "plus", "qual")])


def write_fastq(reads: DataFrame, path: str, by: tuple[str, ...] = ("cluster", "sample"), records_per_file: int = 1_000_000, order: tuple[str, ...] = ("part", "rec_no")) -> None:
    """FASTQ text in a folder for each value of ``by``; a file holds at most so many reads, in order of ``order``.

    Reads are counted, and sorted by as many ranges of folder and order as they fill files, so a folder with most of the
    reads is the work of most of the tasks, and small folders share one.
    """
    tasks = max(1, -(-reads.count() // records_per_file))
    keys = [c for c in (*by, *order) if c in reads.columns]
    rows = fastq_text(reads).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    rows.select("value", *by).write.option("maxRecordsPerFile", records_per_file).partitionBy(*by).text(path)


def write_fasta(reads: DataFrame, path: str, per_sample: int | None = None) -> None:
    """FASTA text; with ``per_sample``, the first reads of each sample only (a feature of the classifier's input)."""
    rows = reads if per_sample is None else reads.where(F.col("rec_no") < per_sample)
    rows.select(F.concat(F.lit(">"), F.expr("substring(id, 2)"), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)


def write_report(report: DataFrame, path: str, sep: str = ",") -> None:
    report.coalesce(1).write.option("header", True).option("sep", sep).csv(path)
