import random

from pyspark.sql import functions as F

from strandloom.operators.partition import spike_report
from strandloom.plans.pipeline import Run, Settings


def test_planted_spikes_gather_in_one_cluster(spark, tmp_path):
    rng = random.Random(3)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    genomes, spike, rows = [dna(2000) for _ in range(4)], dna(1500), []

    def pair(source, sample, name):
        at = rng.randrange(len(source) - 160)
        for mate, q in ((1, source[at : at + 80]), (2, source[at + 80 : at + 160])):
            rows.append((sample, "", len(rows), f"@{name}/{mate}", q, "+", "I" * 80))

    for s in range(6):
        weights = [rng.random() ** 2 for _ in genomes]
        for i in range(90):
            pair(rng.choices(genomes, weights)[0], f"s{s}", f"R{s}x{i}")
        for i in range(30 * (s % 3)):
            pair(spike, f"s{s}", f"Spike{s}x{i}")
    reads = spark.createDataFrame(rows, "sample string, part string, rec_no long, id string, seq string, plus string, qual string")
    out = Run(spark, str(tmp_path), Settings(k=21, hash_size=14, threshold=0.7)).run(reads)
    spiked = sum(r[3].startswith("@Spike") for r in rows)
    best = spike_report(out, F.col("id").startswith("@Spike")).first()
    assert best["spiked"] >= 0.8 * spiked
    assert out.groupBy("sample", "pair_key").agg(F.countDistinct("cluster").alias("n")).where("n > 1").count() == 0
    assert out.groupBy("sample", "rec_no").count().where("count > 1").count() == 0
