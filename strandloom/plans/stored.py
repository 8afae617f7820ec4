"""Tables between steps of a query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset (tests, one machine) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="strandloom-"))
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write and read again: what several parts of a plan use is made once, and lineage ends here."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, column: str, buckets: int | None = None, path: str | None = None, dealt: bool = False) -> DataFrame:
    """``stored`` with the rows of a bucket in one sorted file: joins and sums by the column read it without an exchange.

    The table has a name of its own in the session's catalog, as buckets are known by the catalog only. ``dealt``: the rows
    are hashed by the column over as many partitions already.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    rows = df if dealt else df.repartition(buckets, column)
    rows.write.bucketBy(buckets, column).sortBy(column).option("path", path or new_path(spark, label)).mode("overwrite").saveAsTable(name)
    return spark.table(name)
