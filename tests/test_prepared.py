import random

import numpy as np
from pyspark.sql import functions as F

from strandloom.operators import hyperplane, ingest, spectral
from strandloom.sources import fastq

K = 5


def planes(spokes=6):
    rng = np.random.default_rng(3)
    return [(w, s, rng.normal(size=K).tolist(), rng.normal(size=K).tolist(), 0.1, 0.0) for w in range(2) for s in range(spokes)]


def test_reads_of_any_encoding_and_naming_hash_alike(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGT") for _ in range(rng.choice([3, 5, 30, 60]))) for _ in range(40)]
    codes = [[rng.randrange(2, 41) for _ in s] for s in seqs]
    rows = []
    for offset, name in ((33, "@r{}/{}"), (64, "@r{} {}:N")):
        for i, (s, q) in enumerate(zip(seqs, codes)):
            rows.append((f"o{offset}", "", i, name.format(i // 2, i % 2 + 1), s if offset == 33 else s.lower(), "+", "".join(chr(x + offset) for x in q)))
    rows.append(("o33", "", 99, "@odd", "ACGTNX", "+", "IIIIII"))
    ready = ingest.prepared(spark.createDataFrame(rows, fastq.READS), K)
    assert {(r["sample"], r["q_offset"]) for r in ready.select("sample", "q_offset").distinct().collect()} == {("o33", 33), ("o64", 64)}
    got = {(r["sample"], r["rec_no"]): r for r in hyperplane.hash_reads(ready, planes(), K).collect()}
    assert len(got) == 2 * len(seqs)
    for i, (s, q) in enumerate(zip(seqs, codes)):
        bad = [j for j in range(K - 1, len(q)) if q[j] < 3]
        kept = bad[2] + 1 if len(bad) >= 3 else len(s)
        coords = hyperplane.coordinates(s[:kept], "".join(chr(x + 33) for x in q[:kept]))
        want = hyperplane.kmer_bins(coords, planes(), K).ravel().tolist()
        assert got["o33", i]["bins"] == got["o64", i]["bins"] == want
        assert (got["o33", i]["kept"], got["o33", i]["seq"]) == (kept, s)
    pairs = [r["pair_key"] for r in got.values()]
    assert all(pairs.count(p) == 2 for p in pairs)


def test_a_read_without_qualities_keeps_its_bases(spark):
    ready = ingest.prepared(spark.createDataFrame([("s", "", 0, "@a", "ACGTACGT", "+", None)], fastq.READS), K, 33, 0)
    assert (ready.first()["kept"], ready.first()["pair_key"]) == (8, "@a")
    empty = ingest.prepared(spark.createDataFrame([], fastq.READS), K)
    assert hyperplane.hash_reads(empty, planes(), K).count() == 0


def test_ties_of_strands_go_either_way():
    wheels = [(0, s, *([x] * K for x in (1.0, 0.0)), 0.1, 0.0) for s in range(21)]  # all bits alike: 0 or 2**21 - 1
    coords = hyperplane.coordinates("AAAAA")  # 0 ahead, all ones back: only modulo a million are they told apart
    assert hyperplane.kmer_bins(coords, wheels, K).tolist() == [[0]]
    flat = hyperplane.coordinates("NNNNN")
    assert hyperplane.kmer_bins(flat, wheels, K, tie_forward=False).tolist() == [[0]]


def test_lines_of_split_files_make_the_same_reads(spark, tmp_path):
    rng = random.Random(2)
    for name in ("s1.x.fastq.001", "s2.fastq"):
        lines = [f"@r{i}\n{''.join(rng.choice('ACGT') for _ in range(30))}\n+\n{'@' * 30}" for i in range(500)]
        (tmp_path / name).write_text("\n".join(lines) + "\n@cut\nACG")
    whole = fastq.read_fastq(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3001b")
    try:
        split = fastq.read_fastq_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, split)) == sorted(map(tuple, whole.collect())) and len(split) == 1000
    for read in (fastq.read_fastq, fastq.read_fastq_lines):
        assert read(spark, str(tmp_path), max_reads=3).groupBy("sample").agg(F.max("rec_no").alias("m"), F.count("*").alias("n")).select("m", "n").distinct().collect() == [(2, 3)]


def test_eigenspace_comes_back(spark):
    u = np.arange(6, dtype=float).reshape(3, 2)
    names, v, s = spectral.load_eigenspace(spectral.eigenspace_frame(spark, ["a", "b", "c"], u, np.array([2.0, 1.0])))
    assert names == ["a", "b", "c"] and (v == u).all() and s.tolist() == [2.0, 1.0]
