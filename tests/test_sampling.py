import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import hyperplane
from strandloom.sources import fastq, sinks


@pytest.fixture(scope="module")
def reads(spark):
    rng = np.random.default_rng(1)
    rows = []
    for sample, part, n in (("a", "1", 50), ("a", "2", 3), ("b", "1", 400), ("c", "1", 2)):
        for i in range(n):
            size = int(rng.integers(3, 30)) if sample != "c" else 5
            rows.append((sample, part, i, f"@{i}", "".join(rng.choice(list("ACGT"), size)), "+", "I" * size))
    return spark.createDataFrame(rows, fastq.READS)


def test_exactly_so_many_kmers_of_each_file(reads):
    available = {(r["sample"], r["part"]): r["n"] for r in reads.groupBy("sample", "part").agg(F.sum(F.greatest(F.length("seq") - 7, F.lit(0))).alias("n")).collect()}
    for n in (1, 20, 100_000):
        got = {(r["sample"], r["part"]): r["count"] for r in hyperplane.bottom_kmers(reads, 8, n).groupBy("sample", "part").count().collect()}
        assert got == {f: min(n, k) for f, k in available.items() if k}


def test_the_sample_does_not_depend_on_how_reads_lie(reads):
    rows = lambda df: sorted(tuple(r) for r in hyperplane.bottom_kmers(df, 8, 20, seed=3).collect())
    assert rows(reads.coalesce(1)) == rows(reads.repartition(9, "rec_no"))
    a, b = (hyperplane.sample_kmers(df, 8, 40) for df in (reads.coalesce(1), reads.repartition(5)))
    assert (a == b).all() and a.shape == (10 + 10 + 10 + 0, 8)
    assert hyperplane.sample_kmers(reads.where("false"), 8, 40).shape == (0, 8)


def test_kmers_are_windows_of_their_reads(reads):
    short = reads.withColumn("kept", F.least(F.length("seq"), F.lit(10))).withColumn("q_offset", F.lit(64))
    texts = [r["seq"][:10] for r in reads.collect()]
    got = hyperplane.bottom_kmers(short, 8, 7).collect()
    assert all(len(r["seq"]) == len(r["qual"]) == 8 and r["q_offset"] == 64 and any(r["seq"] in t for t in texts) for r in got)


def test_naming_by_the_first_mates(spark):
    def types(*ids):
        df = spark.createDataFrame([("s", "", i, x, "A", "+", "I") for i, x in enumerate(ids)], fastq.READS)
        return fastq.id_types(df).first()["id_type"]

    assert types("@x/1", "@x/2", "@y 1:N", "@y 2:N") == 2  # the first found, not the smaller
    assert types("@y 1:N", "@y 2:N", "@x/1", "@x/2") == 1
    assert types("@y 1:N", "@y 2:Y") == 0  # what follows the mate's digit differs
    assert types("@x.1 length=5", "@x.2 length=6") == 2 and types("@x/1", "@x.2") == 0 and types("@x") == 0


def test_a_hot_cluster_is_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 7 + 1).cast("int").alias("cluster"), F.lit("s").alias("sample"), F.lit("").alias("part"), F.col("id").alias("rec_no"),
        F.format_string("@r%d", "id").alias("id"), F.lit("ACGT").alias("seq"), F.lit("+").alias("plus"), F.lit("IIII").alias("qual"),
    ).repartition(6)
    sinks.write_fastq(rows, str(tmp_path / "out"), records_per_file=200)
    found = spark.read.text(str(tmp_path / "out")).where("value like '@r%'").withColumn("file", F.input_file_name())
    sizes = {(r["cluster"], r["file"]): r["count"] for r in found.groupBy("cluster", "file").count().collect()}
    assert sum(sizes.values()) == 5000 and max(sizes.values()) <= 200
    hot = [f for (c, f) in sizes if c == 0]
    assert len({f.rsplit("/part-", 1)[1][:5] for f in hot}) >= 20  # tasks
    assert fastq.read_fastq(spark, str(tmp_path / "out/*/*")).count() == 5000


def test_mapper_bits_ties_and_terminals(spark):
    wheels = [(0, 0, [1.0, 0.0], [0.0, 0.0], 0.0, 0.0), (0, 1, [0.0, 1.0], [0.0, 0.0], 0.0, -0.5), (1, 0, [1.0, 1.0], [0.0, 0.0], 0.0, 0.0)]
    sure = 1 - 10**-4
    rows = [(s, "II") for s in ("AT", "TA", "CG", "GG", "TT")]
    base = {"A": -1, "T": 1, "C": -1j, "G": 1j}
    df = spark.createDataFrame(rows, "seq string, qual string")
    got = {r["seq"]: r for r in hyperplane.mapper_bins(df, wheels, terminals=True).collect()}
    bit = lambda z: int(z.real > 0 if z.real else z.imag > 0)
    for s, _ in rows:
        c = [base[x] * sure for x in s]

        def bins(v):
            return [bit(v[0]) + 2 * bit(v[1] + 0.5j), bit(v[0] + v[1])]

        ahead, back = bins(c), bins([-x for x in c[::-1]])
        assert got[s]["bins"] == [a if a < b else b for a, b in zip(ahead, back)]
        assert np.allclose(complex(*got[s]["first"]), c[0]) and np.allclose(complex(*got[s]["last"]), c[-1])
