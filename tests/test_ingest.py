import gzip

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import ingest
from strandloom.sources import legacy
from strandloom.sources.fastq import READS


def reads(spark, n, mate):
    return spark.createDataFrame([("s", "", i, f"@r{i}/{mate}", "ACGT", "+", "IIII") for i in range(n)], READS)


def test_mates_interleave_in_chunks(spark):
    rows = ingest.interleave_chunks(reads(spark, 5, 1), reads(spark, 5, 2), chunk_reads=4).orderBy("rec_no").collect()
    assert [r["id"] for r in rows[:4]] == ["@r0/1", "@r0/2", "@r1/1", "@r1/2"]
    assert [r["part"] for r in rows] == ["000"] * 4 + ["001"] * 4 + ["002"] * 2
    assert {r["part"] for r in ingest.single_chunks(reads(spark, 5, 1), 2).collect()} == {"000", "001", "002"}


def test_chunks_by_bytes(spark):
    rows = reads(spark, 50, 1).withColumn("seq", F.repeat(F.lit("A"), F.lit(100_000)))
    got = ingest.byte_chunks(rows, megabytes=1).groupBy("part").count().collect()
    assert sum(r["count"] for r in got) == 50 and len(got) == 5 and max(r["count"] for r in got) <= 10


def test_mapper_rows_and_counters(spark):
    hashed = reads(spark, 2, 1).withColumn("bins", F.array(F.lit(1), F.lit(2)))
    out, seen = ingest.counted(ingest.mapper_rows(hashed, F.col("id")), "mapper", F.max("bin").alias("top"))
    assert {(r["id"], r["bin"]) for r in out.collect()} == {(f"@r{i}/{m}", b) for i in range(2) for m in (1, 2) for b in (1, 2)}
    assert seen.get == {"rows": 8, "top": 2}
    assert ingest.hash_parts(22) == 5


def test_older_files(spark, tmp_path):
    text = "@a\nACGT\n+\nIIII\n[k, bins: [4, 10, 255]]\n@b\nAC\n+\nII\n[k, bins: [4, 7]]\n"
    (tmp_path / "s.x.hashq.000.gz").write_bytes(gzip.compress(text.encode()))
    rows = legacy.read_hashq(spark, str(tmp_path / "*.gz")).orderBy("rec_no").collect()
    assert [(r["sample"], r["id"], r["k"], r["bins"]) for r in rows] == [("s.x", "@a", 4, [10, 255]), ("s.x", "@b", 4, [7])]
    (tmp_path / "s.count.hash").write_bytes(np.array([0, 3, 0, 65535], dtype="<u2").tobytes())
    assert {tuple(r) for r in legacy.read_count_vectors(spark, str(tmp_path / "*.hash")).collect()} == {("s", 1, 3), ("s", 3, 65535)}
    np.save(tmp_path / "7.npy", np.array([5, 9]))
    assert {tuple(r) for r in legacy.read_bin_lists(spark, str(tmp_path / "*.npy")).collect()} == {("7", 5), ("7", 9)}
    names = spark.createDataFrame([(1, "one")], "k int, name string")
    assert {tuple(r) for r in legacy.named(spark.createDataFrame([(1,), (2,)], "k int"), names, "k").collect()} == {(1, "one"), (2, "2")}
    lines = spark.createDataFrame(list(enumerate(text.split("\n")[:4])), "line_no long, line string")
    assert tuple(legacy.read_stdin_reads(lines).first()) == (0, "@a", "ACGT", "+", "IIII")
