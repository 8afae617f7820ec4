"""Importers of older intermediate files and mapper input; see ``ranges`` for how files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmer import mapper_windows
from .ranges import read_bin_lists, read_conditioned, read_count_vectors  # noqa: F401  readers of older files
from .ranges import read_hashq_ranges as read_hashq  # noqa: F401


def named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows with the ``name`` of their key, or the key itself: a table in place of a pickled mapping."""
    return rows.join(names.select(key, "name"), key, "left").withColumn("name", F.coalesce("name", F.col(key).cast("string")))


def read_stdin_reads(lines: DataFrame) -> DataFrame:
    """Reads from numbered FASTQ lines (line_no, line), as a mapper gets them: every fourth line starts a record."""
    group = F.floor(F.col("line_no") / 4).alias("rec_no")
    at = lambda i: F.max(F.when(F.col("line_no") % 4 == i, F.col("line")))
    return lines.groupBy(group).agg(at(0).alias("id"), at(1).alias("seq"), at(2).alias("plus"), at(3).alias("qual"))


def mapper_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(id, at, seq, qual) of reads (id, seq, qual): a mapper's k-mers, up to the first with more than two bases of quality 2."""
    n = mapper_windows(F.col("seq"), F.col("qual"), k)
    rows = reads.where(n > 0).select("id", "seq", "qual", F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    cut = lambda c: F.substring(c, F.col("at") + 1, F.lit(k)).alias(c)
    return rows.select("id", "at", cut("seq"), cut("qual"))
