"""Data sources that read files by byte ranges: FASTQ records, dense vectors of numbers, lists of bins.

A range starts anywhere in a file. A reader of records finds the first record that begins in its range and reads on to the
end of the last one that does, so every record is read once, whatever the ranges, and nothing is shuffled. A vector's range
is a range of bins, and who wants some bins only names them to the reader (a filter pushed to a Python source is shared by all
scans of a DataFrame in Spark 4.1, so none is pushed). Compressed files are one range each.

Files are opened by the tasks: their folder must be mounted on every node or lie in a store that Arrow's file systems open
(``s3://…``, ``gs://…``, ``hdfs://…``). ``fastq.read_fastq_lines`` reads whatever Spark reads, at the price of shuffles.
"""

from __future__ import annotations

import dataclasses
import fnmatch
import glob
import gzip
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

RANGE_BYTES = 64 << 20
#: Records and values of a batch.
BATCH_RECORDS = 20_000
BATCH_VALUES = 1 << 20
#: Files' offsets are broadcast up to so many ranges.
BROADCAST_RANGES = 100_000


@dataclasses.dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int
    number: int
    skip: int = 0


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path, folder or pattern names, in order."""
    if "://" not in path and not path.startswith("file:"):
        found = glob.glob(path)
        found = [os.path.join(d, f) for d in found if os.path.isdir(d) for f in os.listdir(d)] + [f for f in found if not os.path.isdir(f)]
        return sorted((os.path.abspath(f), os.path.getsize(f)) for f in found if os.path.isfile(f) and not os.path.basename(f).startswith(("_", ".")))
    from pyarrow import fs

    system, inner = _system(path)
    folder, _, pattern = inner.rpartition("/")
    whole = system.get_file_info(inner)
    if whole.type == fs.FileType.File:
        return [(path, whole.size)]
    if whole.type == fs.FileType.Directory:
        folder, pattern = inner, "*"
    prefix = path[: len(path) - len(inner)]
    listed = system.get_file_info(fs.FileSelector(folder))
    return sorted((prefix + x.path, x.size) for x in listed if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern) and not x.base_name.startswith(("_", ".")))


def _opened(path: str):
    system, inner = _system(path)
    return system.open_input_file(inner)


def _packed(path: str) -> bool:
    with _opened(path) as f:
        return f.read(2) == b"\x1f\x8b"


def ranges(path: str, size: int, step: int, packed: bool) -> list[tuple[int, int]]:
    return [(0, size)] if packed else [(a, min(size, a + step)) for a in range(0, size, step)]


class _Lines:
    """Lines of a stream with their places."""

    def __init__(self, stream, at: int, block: int = 1 << 20):
        self.stream, self.at, self.block, self.held, self.place = stream, at, block, b"", 0

    def next(self) -> tuple[int, bytes] | None:
        """(place, line with its end), or none at the end."""
        end = self.held.find(b"\n", self.place)
        while end < 0:
            more = self.stream.read(self.block)
            if not more:
                break
            seen = len(self.held) - self.place
            self.held, self.place = self.held[self.place :] + more, 0
            end = self.held.find(b"\n", seen)
        line = self.held[self.place : end + 1 if end >= 0 else len(self.held)]
        if not line:
            return None
        place = self.at
        self.at, self.place = self.at + len(line), self.place + len(line)
        return place, line


def records(stream, at: int, end: int, lines: int = 4, within: bool = False) -> Iterator[list[bytes]]:
    """Records of ``lines`` lines that begin before byte ``end`` of a file, from a stream that is at byte ``at``; ``within``: the
    stream may be within a line, which is left to the range before.

    A record begins at a line with ``@`` whose next but one begins with ``+``; no quality line does, as a sequence comes
    two lines after it. Lines that begin no record are passed over, and so is a record cut at the file's end.
    """
    source = _Lines(stream, at)
    if within:
        source.next()
    window: list[tuple[int, bytes]] = []

    def fill() -> bool:
        while len(window) < lines:
            line = source.next()
            if line is None:
                return False
            window.append(line)
        return True

    while fill() and window[0][0] < end:
        if window[0][1][:1] == b"@" and window[2][1][:1] == b"+" and (lines < 5 or b"bins:" in window[4][1]):
            yield [x.rstrip(b"\r\n") for _, x in window]
            window = []
        else:
            window.pop(0)


class RecordSource(DataSource):
    """``strandloom_records``: options path, lines (4, or 5 for hashed reads), rangeBytes, countOnly."""

    @classmethod
    def name(cls) -> str:
        return "strandloom_records"

    def schema(self) -> str:
        if self.options.get("countonly", "false") == "true":
            return "path string, number int, n long"
        return "path string, number int, nth long, id string, seq string, plus string, qual string" + (", rest string" if self.options.get("lines") == "5" else "")

    def reader(self, schema: StructType) -> DataSourceReader:
        return RecordReader(self.options)


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.lines = options["path"], int(options.get("lines", "4"))
        self.step, self.count_only = int(options.get("rangebytes", str(RANGE_BYTES))), options.get("countonly", "false") == "true"

    def partitions(self) -> list[Range]:
        return [Range(path, a, b, n) for path, size in files(self.path) for n, (a, b) in enumerate(ranges(path, size, self.step, size > 1 and _packed(path)))]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as raw:
            packed = partition.start == 0 and raw.read(2) == b"\x1f\x8b"
            # the byte before the range tells whether a line begins with it
            start = max(0, partition.start - 1)
            raw.seek(start)
            found = records(gzip.GzipFile(fileobj=raw) if packed else raw, start, 1 << 62 if packed else partition.end, self.lines, partition.start > 0)
            if self.count_only:
                yield pa.RecordBatch.from_pydict({"path": [partition.path], "number": pa.array([partition.number], pa.int32()), "n": [sum(1 for _ in found)]})
                return
            held: list[list[bytes]] = []
            done = 0
            for record in found:
                held.append(record)
                if len(held) == BATCH_RECORDS:
                    yield self._batch(partition, held, done)
                    done, held = done + len(held), []
            if held:
                yield self._batch(partition, held, done)

    def _batch(self, partition: Range, held: list[list[bytes]], done: int) -> pa.RecordBatch:
        n = len(held)
        text = [pa.array([x.decode("latin-1") for x in column], pa.string()) for column in zip(*held)]
        names = ["id", "seq", "plus", "qual", "rest"][: self.lines]
        return pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array([partition.number] * n, pa.int32()), pa.array(range(done, done + n), pa.int64()), *text], names=["path", "number", "nth", *names])


class VectorSource(DataSource):
    """``strandloom_vectors``: options path, dtype (of files without a header of their own), kind (dense or list), rangeBytes, low, high.

    Dense files give (name, bin, value) of entries that aren't zero, lists (name, bin) of their numbers.
    """

    @classmethod
    def name(cls) -> str:
        return "strandloom_vectors"

    def schema(self) -> str:
        if self.options.get("kind", "dense") == "list":
            return "name string, bin long"
        return f"name string, bin long, value {'double' if np.dtype(self.options.get('dtype', '<u2')).kind == 'f' else 'long'}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return VectorReader(self.options)


class VectorReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.dense = options["path"], options.get("kind", "dense") != "list"
        self.dtype = np.dtype(options.get("dtype", "<u2" if self.dense else "<i8"))
        self.step = int(options.get("rangebytes", str(RANGE_BYTES)))
        self.low, self.high = int(options.get("low", "0")), int(options.get("high", str(1 << 62)))

    def _header(self, path: str) -> tuple[int, np.dtype]:
        """Bytes before the values, and their type."""
        with _opened(path) as f:
            if f.read(6) != b"\x93NUMPY":
                return 0, self.dtype
            f.seek(0)
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            _, _, dtype = read(f)
            return f.tell(), dtype

    def partitions(self) -> list[Range]:
        out = []
        for path, size in files(self.path):
            skip, dtype = self._header(path)
            entries, step = (size - skip) // dtype.itemsize, max(1, self.step // dtype.itemsize)
            low, high = (min(self.low, entries), min(self.high, entries)) if self.dense else (0, entries)
            out += [Range(path, a, min(high, a + step), n, skip) for n, a in enumerate(range(low, high, step))]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        skip, dtype = self._header(partition.path)
        name = os.path.basename(partition.path).split(".")[0]
        with _opened(partition.path) as f:
            for at in range(partition.start, partition.end, BATCH_VALUES):
                f.seek(skip + at * dtype.itemsize)
                values = np.frombuffer(f.read(min(BATCH_VALUES, partition.end - at) * dtype.itemsize), dtype)
                if not self.dense:
                    yield pa.RecordBatch.from_pydict({"name": pa.array([name] * len(values)), "bin": pa.array(values.astype(np.int64))})
                    continue
                there = np.flatnonzero(values)
                if len(there):
                    kind = np.float64 if self.dtype.kind == "f" else np.int64
                    yield pa.RecordBatch.from_pydict({"name": pa.array([name] * len(there)), "bin": pa.array(there + at), "value": pa.array(values[there].astype(kind))})


def _source(spark: SparkSession, source: type[DataSource], **options) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def _numbered(spark: SparkSession, path: str, lines: int, range_bytes: int) -> DataFrame:
    """Records with ``rec_no``: the ranges' counts, told by a pass that only counts, give each range's first number."""
    options = {"path": path, "lines": str(lines), "rangeBytes": str(range_bytes)}
    counts = _source(spark, RecordSource, **options, countOnly="true")
    before = F.sum("n").over(Window.partitionBy("path").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    above = counts.select("path", "number", F.coalesce(before, F.lit(0)).alias("above"))
    if above.count() <= BROADCAST_RANGES:
        above = F.broadcast(above)
    return _source(spark, RecordSource, **options).join(above, ["path", "number"]).withColumn("rec_no", F.col("above") + F.col("nth"))


def read_fastq_ranges(spark: SparkSession, path: str, max_reads: int | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of ``fastq.read_fastq`` from files of any size, by byte ranges; no read is shuffled."""
    rows = _numbered(spark, path, 4, range_bytes)
    rows = rows if max_reads is None else rows.where(F.col("rec_no") < max_reads)
    name = F.substring_index("path", "/", -1)
    part = F.btrim(F.regexp_extract(name, r"\.fastq(.*)$", 1), F.lit("."))
    return rows.select(F.substring_index(name, ".", 1).alias("sample"), part.alias("part"), "rec_no", "id", "seq", "plus", "qual")


def read_hashq_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Hashed reads (sample, rec_no, id, seq, plus, qual, k, bins): four FASTQ lines and one of ``[k, bins: [k, b1, b2, ...]]``."""
    rows = _numbered(spark, path, 5, range_bytes)
    values = F.transform(F.regexp_extract_all("rest", F.lit(r"(\d+)")), lambda x: x.cast("long"))
    name = F.substring_index(F.substring_index("path", "/", -1), ".hashq", 1)
    return rows.select(name.alias("sample"), "rec_no", "id", "seq", "plus", "qual", values[0].cast("int").alias("k"), F.slice(values, 2, 1 << 30).alias("bins"))


def read_vectors(spark: SparkSession, path: str, dtype: str = "<u2", range_bytes: int = RANGE_BYTES, low: int = 0, high: int = 1 << 62) -> DataFrame:
    """(sample, bin, value) of the entries that aren't zero of dense vectors, one file a sample; NumPy files tell their own
    type. Only the bytes of bins from low to high - 1 are read."""
    return _source(spark, VectorSource, path=path, dtype=dtype, rangeBytes=str(range_bytes), low=str(low), high=str(high)).withColumnRenamed("name", "sample")


def read_count_vectors(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, low: int = 0, high: int = 1 << 62) -> DataFrame:
    """(sample, bin, cnt) of dense vectors of 16-bit counters."""
    return read_vectors(spark, path, "<u2", range_bytes, low, high).withColumnRenamed("value", "cnt")


def read_conditioned(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, low: int = 0, high: int = 1 << 62) -> DataFrame:
    """(sample, bin, x) of dense vectors of 32-bit floats."""
    return read_vectors(spark, path, "<f4", range_bytes, low, high).withColumnRenamed("value", "x")


def read_bin_lists(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(name, bin) of NumPy files of bin numbers: nonzero bins of a sample, or members of a cluster."""
    return _source(spark, VectorSource, path=path, kind="list", rangeBytes=str(range_bytes))
