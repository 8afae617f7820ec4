"""FASTQ, hashed-read, FASTA, alignment, profile and log sources.

A FASTQ record spans four lines. ``ranges.read_fastq_ranges`` reads files of any size by byte ranges; ``read_fastq`` takes a
file (a chunk of about a million reads, see ``sinks.write_fastq``) as one value of one task.
"""

from __future__ import annotations

import gzip
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

READS = "sample string, part string, rec_no long, id string, seq string, plus string, qual string"
_BATCH = 20_000


def parse_fastq(data: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(id, sequence, plus line, quality) of every whole record.

    A record begins at a line with ``@``; the three lines after it belong to it whatever they begin with, so a
    quality line that begins with ``@`` or ``+`` splits nothing. A cut record at the end is left out.
    """
    stream = io.TextIOWrapper(io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data), encoding="latin-1", newline="\n")
    for line in stream:
        if line.startswith("@"):
            rest = [stream.readline() for _ in range(3)]
            if rest[1].startswith("+") and rest[2]:
                yield line.rstrip("\r\n"), *(x.rstrip("\r\n") for x in rest)


def read_fastq(spark: SparkSession, path: str, max_reads: int | None = None) -> DataFrame:
    """Reads of FASTQ files (gzip or not), the first ``max_reads`` of each if given. sample: file name up to its first
    ``.``; part: what follows ``.fastq``. A file is one value, 2 GB at most; see ``read_fastq_lines`` for larger ones."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READS.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = name.rsplit("/", 1)[-1]
                sample, part = name.split(".")[0], name.partition(".fastq")[2].strip(".")
                rows: list[tuple] = []
                for i, record in enumerate(itertools.islice(parse_fastq(content.as_py()), max_reads)):
                    rows.append((sample, part, i, *record))
                    if len(rows) == _BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_schema())
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_schema())

    return files.mapInArrow(run, READS)


def read_fastq_lines(spark: SparkSession, path: str, max_reads: int | None = None) -> DataFrame:
    """The same rows from files of any size, read by splits: records are four lines each, from a file's first line on.

    Lines are counted in each split, and the splits' sums give every line its number in the file; no task sees more
    than a split. A cut record at the end, or one whose third line isn't a plus line, is left out.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = lines.groupBy("path", "block").agg(F.count("*").alias("n"))
    sums = sums.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"))
    number = F.col("above") + F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    numbered = lines.join(sums, ["path", "block"]).withColumn("no", number)
    line = lambda i: F.max(F.when(F.col("no") % 4 == i, F.col("line")))
    records = numbered.groupBy("path", F.floor(F.col("no") / 4).alias("rec_no")).agg(*[line(i).alias(n) for i, n in enumerate(("id", "seq", "plus", "qual"))])
    whole = records.where("id like '@%' and plus like '+%' and qual <> ''")
    if max_reads is not None:
        whole = whole.where(F.col("rec_no") < max_reads)
    name = F.substring_index("path", "/", -1)
    part = F.btrim(F.regexp_extract(name, r"\.fastq(.*)$", 1), F.lit("."))
    return whole.select(F.substring_index(name, ".", 1).alias("sample"), part.alias("part"), "rec_no", "id", "seq", "plus", "qual")


def _schema() -> pa.Schema:
    return pa.schema([(f.split()[0], pa.int64() if f.endswith("long") else pa.string()) for f in READS.split(", ")])


def quality_offset(reads: DataFrame, peek: int = 1000) -> DataFrame:
    """(sample, part, q_offset): 33 if three times the low codes (under 74) outnumber the others among the first reads, else 64."""
    codes = F.transform(F.split("qual", ""), lambda c: F.ascii(c))
    low = F.size(F.filter(codes, lambda c: c < 74))
    total = F.length("qual")
    seen = reads.where(F.col("rec_no") < peek).groupBy("sample", "part").agg(F.sum(low).alias("low"), F.sum(total - low).alias("high"))
    return seen.select("sample", "part", F.when(F.col("low") * 3 > F.col("high"), 33).otherwise(64).alias("q_offset"))


def id_types(reads: DataFrame, peek: int = 125) -> DataFrame:
    """(sample, part, id_type) by the first two neighbours of a file that are named as mates: 1 for ``id 1…`` and ``id 2…``
    with the same rest, 2 for first words that end in ``/1`` and ``/2`` or ``.1`` and ``.2``; 0 for none."""
    near = Window.partitionBy("sample", "part").orderBy("rec_no")
    rows = reads.where(F.col("rec_no") < peek).withColumn("after", F.lead("id").over(near))
    word = lambda c, i: F.get(F.split(F.trim(F.col(c)), r"\s+"), i)
    first, second = lambda c: word(c, 0), lambda c: word(c, 1)
    rest = lambda x: x.substr(F.lit(2), F.length(x))
    one = (first("id") == first("after")) & second("id").startswith("1") & second("after").startswith("2") & (rest(second("id")) == rest(second("after")))
    stem = lambda c: first(c).substr(F.lit(1), F.length(first(c)) - 2)
    mark = lambda c: F.right(first(c), F.lit(2))
    ends = ((mark("id") == "/1") & (mark("after") == "/2")) | ((mark("id") == ".1") & (mark("after") == ".2"))
    kind = F.when(one, 1).when((stem("id") == stem("after")) & ends, 2)
    return rows.groupBy("sample", "part").agg(F.coalesce(F.min_by(kind, F.when(kind.isNotNull(), F.col("rec_no"))), F.lit(0)).alias("id_type"))


def clean_bases(seq: Column) -> Column:
    """Upper-case bases; null for a read with more than five distinct symbols."""
    upper = F.upper(seq)
    return F.when(F.size(F.array_distinct(F.split(upper, ""))) <= 5, upper)


def read_fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Contig lengths from FASTA headers: the fourth token when ``_`` counts as a blank."""
    lines = spark.read.text(path).where("value like '>%'")
    return lines.select(F.expr("try_cast(get(split(replace(value, '_', ' '), ' '), 3) as int)").alias("length")).where("length is not null")


def read_blast(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of tabular output with comment lines, as (path, line_no, block, qseqid, qstart, qend, sseqid, score).

    A block ends at any line without five fields. Lines of a file are numbered by a whole-file scan.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = text.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    fields = F.split("line", "\t")
    lines = lines.withColumn("f", fields).withColumn("broken", (F.size("f") != 5).cast("int"))
    upto = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("block", F.sum("broken").over(upto)).where("broken = 0")
    f = lambda i, kind="string": F.col("f")[i].cast(kind)
    return rows.select("path", "line_no", "block", f(0).alias("qseqid"), f(1, "int").alias("qstart"), f(2, "int").alias("qend"), f(3).alias("sseqid"), f(4, "double").alias("score"))


def read_taxprof(spark: SparkSession, path: str) -> DataFrame:
    """Taxonomic profile rows (name, pct, count); the header is skipped."""
    return spark.read.csv(path, sep="\t", header=True, schema="name string, pct double, count double")


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """(lib, sample) of a ragged CSV in one file: the row's number is the library."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.split("value", "\n")).alias("lib", "row"))
    return rows.select("lib", F.explode(F.split("row", ",")).alias("sample")).select("lib", F.trim("sample").alias("sample")).where("sample <> ''")


def read_job_logs(spark: SparkSession, path: str) -> DataFrame:
    """(path, metric, value) of ``key : number`` lines; the last value of a metric in a file wins."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = text.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    pattern = r"^\s*([A-Za-z][A-Za-z ]*?)\s*:\s*(-?[0-9.]+)"
    rows = lines.select("path", "line_no", F.regexp_extract("line", pattern, 1).alias("metric"), F.regexp_extract("line", pattern, 2).try_cast("double").alias("v"))
    return rows.where("metric <> '' and v is not null").groupBy("path", "metric").agg(F.max_by("v", "line_no").alias("value"))
