import gzip

from pyspark.sql import functions as F

from strandloom.sources import fastq, sinks
from strandloom.streaming.counts import stream_bin_counts, streamed_counts

RECORDS = [("@r1/1", "ACGT", "+", "@III"), ("@r1/2", "TTTT", "+r1", "+I@I"), ("@r2/1", "acgtn", "+", "IIIII")]


def text(records):
    return "".join("\n".join(r) + "\n" for r in records)


def test_quality_lines_split_nothing_and_cut_records_are_left_out(spark, tmp_path):
    (tmp_path / "s1.x.fastq.001").write_text(text(RECORDS) + "@cut\nACG")
    (tmp_path / "s2.fastq").write_bytes(gzip.compress(text(RECORDS[:1]).encode()))
    rows = fastq.read_fastq(spark, str(tmp_path)).orderBy("sample", "rec_no").collect()
    assert [(r["sample"], r["part"], r["rec_no"]) for r in rows] == [("s1", "001", 0), ("s1", "001", 1), ("s1", "001", 2), ("s2", "", 0)]
    assert [(r["id"], r["seq"], r["plus"], r["qual"]) for r in rows[:3]] == RECORDS


def test_encodings_and_naming_are_inferred(spark):
    def reads(sample, ids, qual):
        return [(sample, "", i, x, "ACGT", "+", qual) for i, x in enumerate(ids)]

    rows = reads("a", ["@x 1:N", "@x 2:N"], "IIII") + reads("b", ["@x/1", "@x/2"], "hhhh") + reads("c", ["@x", "@y"], "IIII")
    df = spark.createDataFrame(rows, fastq.READS)
    assert {r["sample"]: r["q_offset"] for r in fastq.quality_offset(df).collect()} == {"a": 33, "b": 64, "c": 33}
    assert {r["sample"]: r["id_type"] for r in fastq.id_types(df).collect()} == {"a": 1, "b": 2, "c": 0}
    bases = spark.createDataFrame([("acgtn",), ("ACGTNX",)], "s string").select(fastq.clean_bases(F.col("s"))).collect()
    assert [r[0] for r in bases] == ["ACGTN", None]


def test_partitioned_fastq_comes_back(spark, tmp_path):
    rows = [(i % 2, f"s{i % 3}", "", i, f"@r{i}", "ACGT", "+", "IIII") for i in range(30)]
    df = spark.createDataFrame(rows, "cluster int, " + fastq.READS)
    sinks.write_fastq(df, str(tmp_path / "out"), records_per_file=3)
    found = spark.read.text(str(tmp_path / "out")).where("value like '@r%'").groupBy("cluster", "sample").count().collect()
    assert sum(r["count"] for r in found) == 30 and len(found) == 6
    sinks.write_fasta(df, str(tmp_path / "fa"), per_sample=6)
    assert spark.read.text(str(tmp_path / "fa")).where("value like '>%'").count() == 6


def test_tabular_sources(spark, tmp_path):
    (tmp_path / "b").write_text("# x\nq1\t1\t9\ts1\t50\nq1\t1\t9\ts1\t40\n# y\nq1\t1\t9\ts1\t30\nq2\t2\t5\ts2\t7\n")
    from strandloom.operators.reports import alignment_scores

    scores = {r["sseqid"]: r["score"] for r in alignment_scores(fastq.read_blast(spark, str(tmp_path / "b"))).collect()}
    assert scores == {"s1": 80.0, "s2": 7.0}
    (tmp_path / "libs").write_text("a,b\nc\n")
    assert {(r["lib"], r["sample"]) for r in fastq.read_libraries(spark, str(tmp_path / "libs")).collect()} == {(0, "a"), (0, "b"), (1, "c")}
    (tmp_path / "j.out").write_text("CPU time : 5.5 sec.\nMax Memory : 10 MB\nCPU time : 7 sec.\n")
    assert {(r["metric"], r["value"]) for r in fastq.read_job_logs(spark, str(tmp_path / "j.out")).collect()} == {("CPU time", 7.0), ("Max Memory", 10.0)}
    (tmp_path / "c.fa").write_text(">NODE_1_length_500_cov_3\nACGT\n>bad\n")
    assert [r[0] for r in fastq.read_fasta_lengths(spark, str(tmp_path / "c.fa")).collect()] == [500]
    (tmp_path / "t").write_text("name\tpct\tcount\nX\t50.0\t2\n")
    assert tuple(fastq.read_taxprof(spark, str(tmp_path / "t")).first()) == ("X", 50.0, 2.0)


def test_streamed_batches_add_up(spark, tmp_path):
    schema = "source string, text string"
    for i in range(3):
        spark.createDataFrame([("s", "abcdefgh"), ("t", "abc")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_bin_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "source", "text", 3, 16).awaitTermination()
    rows = streamed_counts(spark, str(tmp_path / "out"), "source").collect()
    assert {r["sample"] for r in rows} == {"s", "t"} and all(r["cnt"] == 3 for r in rows) and len(rows) == 7
