import gzip
import io
import random

import numpy as np
import pytest

from strandloom.sources import fastq, legacy, ranges


def some_records(n, seed):
    """Quality lines that begin with @ and +, plus lines with names, all lengths."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.randint(1, 9)
        qual = rng.choice("@+I") + "".join(rng.choice("@+IJ!") for _ in range(size - 1))
        out.append((f"@r{i} x", "".join(rng.choice("ACGTN") for _ in range(size)), rng.choice(["+", f"+r{i}"]), qual))
    return out


def text(records, end="\n"):
    return "".join(end.join(r) + end for r in records)


@pytest.mark.parametrize("end,tail", [("\n", ""), ("\r\n", ""), ("\n", "@cut\nACG\n+"), ("\n", "\n\n")])
def test_a_file_cut_at_every_byte_gives_the_records_of_the_whole(end, tail):
    given = some_records(12, len(tail))
    data = (text(given, end) + tail).encode()
    whole = [tuple(x.decode() for x in r) for r in ranges.records(io.BytesIO(data), 0, len(data))]
    assert whole == given
    for cut in range(1, len(data)):
        first = list(ranges.records(io.BytesIO(data), 0, cut))
        stream = io.BytesIO(data)
        stream.seek(cut - 1)
        rest = list(ranges.records(stream, cut - 1, len(data), within=True))
        assert [tuple(x.decode() for x in r) for r in first + rest] == given, cut


@pytest.mark.parametrize("step", [5, 100, 1 << 20])
def test_fastq_by_ranges_is_fastq_by_files(spark, tmp_path, step):
    (tmp_path / "s1.x.fastq.001").write_text(text(some_records(8, 1)) + "@cut\nACG")
    (tmp_path / "s2.fastq").write_bytes(gzip.compress(text(some_records(30, 2)).encode()))
    (tmp_path / "s3.fastq").write_text("")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    columns = ["sample", "part", "rec_no", "id", "seq", "plus", "qual"]
    assert rows(ranges.read_fastq_ranges(spark, str(tmp_path), range_bytes=step).select(columns)) == rows(fastq.read_fastq(spark, str(tmp_path)).select(columns))
    few = ranges.read_fastq_ranges(spark, str(tmp_path / "*.fastq*"), max_reads=3, range_bytes=step)
    assert few.count() == 6
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(id" not in plan and plan.count("Exchange hashpartitioning") <= 1  # of the counts by file


def test_hashed_reads_by_ranges(spark, tmp_path):
    lines = [f"{i}\n{s}\n{p}\n{q}\n[k, bins: [33, {n}, {n * 7}]]\n" for n, (i, s, p, q) in enumerate(some_records(20, 3))]
    (tmp_path / "a.hashq.01").write_text("".join(lines))
    rows = ranges.read_hashq_ranges(spark, str(tmp_path / "a.*"), range_bytes=64).orderBy("rec_no").collect()
    assert [(r["sample"], r["rec_no"], r["k"], r["bins"]) for r in rows] == [("a", n, 33, [n, n * 7]) for n in range(20)]


def test_three_gigabytes_of_counters(spark, tmp_path):
    """A sparse file of 1.6 billion counters, over the limits of one value; a range of bins is one range of bytes."""
    size, there = 3 << 30, {0: 7, 65_535: 1, 33_554_432: 65_535, 1_000_000_000: 3, (3 << 29) - 1: 9}
    with open(tmp_path / "big.count.hash", "wb") as f:
        f.truncate(size)
        for b, n in there.items():
            f.seek(2 * b)
            f.write(int(n).to_bytes(2, "little"))
    counts = ranges.read_count_vectors(spark, str(tmp_path / "*.hash"))
    assert {r["bin"]: r["cnt"] for r in counts.collect()} == there and counts.rdd.getNumPartitions() == 48
    few = ranges.read_count_vectors(spark, str(tmp_path / "*.hash"), low=999_999_999, high=1_000_000_010)
    assert few.rdd.getNumPartitions() == 1 and [tuple(r) for r in few.collect()] == [("big", 1_000_000_000, 3)]


def test_vectors_of_all_kinds(spark, tmp_path):
    x = np.where(np.arange(1000) % 7 == 0, np.arange(1000) / 8, 0).astype("<f4")
    x.tofile(tmp_path / "a.conditioned")
    np.save(tmp_path / "b.npy", x)
    want = {(int(i), float(x[i])) for i in np.flatnonzero(x)}
    for path, dtype in (("a.conditioned", "<f4"), ("b.npy", "<f4")):
        rows = ranges.read_vectors(spark, str(tmp_path / path), dtype, range_bytes=100).collect()
        assert {(r["bin"], r["value"]) for r in rows} == want and len(rows) == len(want)
    for low, high in ((14, 15), (13, 22), (0, 1), (990, 5000), (2000, 3000)):
        got = ranges.read_conditioned(spark, str(tmp_path / "a.conditioned"), 20, low, high)
        assert {(r["bin"], r["x"]) for r in got.collect()} == {(i, v) for i, v in want if low <= i < high}
    np.save(tmp_path / "7.npy", np.array([5, 900, 3]))
    assert sorted(r["bin"] for r in ranges.read_bin_lists(spark, str(tmp_path / "7.npy"), 8).collect()) == [3, 5, 900]
    assert ranges.read_count_vectors(spark, str(tmp_path / "absent*")).count() == 0


def test_mapper_stops_at_low_quality(spark):
    rng = random.Random(4)
    rows = [(f"@{i}", "A" * n, "".join(rng.choice("#I#J") for _ in range(n))) for i, n in enumerate([0, 3, 4, 5, 9, 20, 40, 40])] + [("@x", "A" * 12, "I" * 12)]
    want = []
    for name, s, q in rows:
        for i in range(len(s) - 3):
            if q[i : i + 4].count("#") > 2:  # quality 2
                break
            want.append((name, i, s[i : i + 4], q[i : i + 4]))
    df = spark.createDataFrame(rows, "id string, seq string, qual string")
    assert sorted(tuple(r) for r in legacy.mapper_kmers(df, 4).collect()) == sorted(want)
