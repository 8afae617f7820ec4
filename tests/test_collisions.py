import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from strandloom.functions.kmer import text_kmers
from strandloom.operators import pairs


def brute(rows, k):
    out = Counter()
    by_bin = {}
    for b, kmer, n in rows:
        by_bin.setdefault(b, []).append((kmer, n))
        if n > 1:
            out[0] += n * (n - 1) // 2
    for members in by_bin.values():
        for (x, n), (y, m) in combinations(members, 2):
            out[min(sum(a != b for a, b in zip(x, y)), k - 1)] += n * m
    return dict(out)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_histogram_against_all_pairs(spark, block):
    rng = random.Random(block)
    seen = {("".join(rng.choice("ACé\U0001F600") for _ in range(5)), rng.choice([0, 0, 0, 1, 2])) for _ in range(300)}
    rows = [(b, kmer, rng.choice([1, 1, 3])) for kmer, b in sorted(seen)]
    df = spark.createDataFrame(rows, "bin long, kmer string, n long")
    assert {r["distance"]: r["n_pairs"] for r in pairs.collision_histogram(df, 5, block).collect()} == brute(rows, 5)
    assert pairs.collision_histogram(df.where("false"), 5, block).count() == 0


def test_a_hot_bin_is_dealt_over_many_tasks(spark):
    """One bin with a third of all k-mers: block pairs are even and many."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("long").alias("bin"), F.format_string("%05d", "id").alias("kmer"), F.lit(1).cast("long").alias("n"))
    blocks = pairs.collision_blocks(rows, 100).where("bin = 0").select(F.size("kmers").alias("k"), "blocks").collect()
    assert len(blocks) == 30 and max(r["k"] for r in blocks) < 2 * 100
    got = {r["distance"]: r["n_pairs"] for r in pairs.collision_histogram(rows, 5, 100).collect()}
    assert sum(got.values()) == 3000 * 2999 // 2


def test_kmers_of_texts(spark):
    texts = ["abcabcab", None, "", "ab", "é\U0001F600é\U0001F600é"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = Counter(t[i : i + 3] for t in texts if t for i in range(len(t) - 2))
    got = Counter()
    for r in text_kmers(df, "text", 3, 10).collect():
        got[r["kmer"]] += r["n"]
    assert got == want
