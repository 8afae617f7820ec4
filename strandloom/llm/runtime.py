"""Session helpers: the shared folder, tables that cut lineage, Arrow kernels."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_own_dir: list[str] = []

#: Rows of an Arrow batch in a session that uses these kernels, at most: what a Python worker holds stays small.
BATCH_ROWS = 1000
#: And bytes of one, so that long texts don't swell the JVM's Arrow buffers either; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests, one machine) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="strandloom-"))
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, whatever executors are lost later."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(path: str) -> str:
    """Path on a mounted shared folder; other stores need the folder mounted on every node."""
    for scheme in ("file://", "file:"):
        if path.startswith(scheme):
            return "/" + path[len(scheme) :].lstrip("/")
    if "://" in path:
        raise RuntimeError(f"{path}: memory-mapped files need a shared folder mounted as a file system")
    return path


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a kernel for one batch. Lowers the session's rows and bytes of a batch to BATCH_ROWS and
    BATCH_BYTES, and at the end of a task gives memory back, as workers wait for the next task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from kernel(batch)
        release_memory()

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))
    size = spark.conf.get(_ARROW_BYTES).removesuffix("b")
    if not size.isdigit() or int(size) > BATCH_BYTES:
        spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))


def marked(df: DataFrame, text: str, name: str, kernel: Callable[[pa.Array], pa.Array], kind: str) -> DataFrame:
    """df with a column that an Arrow kernel makes of the text alone; the other columns stay in the JVM."""

    @F.arrow_udf(kind)
    def of_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield kernel(texts)
        release_memory()

    bound_batches(df.sparkSession)
    return df.withColumn(name, of_batches(F.col(f"`{text}`")))


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):  # another C library
            ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Within, Arrow batches have so many rows at most: for actions on large rows."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)
