"""The whole partitioning run: hash, count, weigh, find covariance, cluster, assign reads.

Stage tables are written below one folder and read again, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import abundance, cluster, hyperplane, ingest, partition, spectral, svd
from .stored import bucketed


@dataclasses.dataclass
class Settings:
    """k: k-mer length; hash_size: planes, so 2**hash_size bins; threshold: cosine similarity within a cluster.

    id_type and q_offset are told from each file's first reads unless they are given.
    """

    k: int = 33
    hash_size: int = 22
    threshold: float = 0.8
    id_type: int | None = None
    q_offset: int | None = None
    both_strands: bool = True
    seed: int = 1
    least_file_reads: int = 0
    rank: int | None = None


class Run:
    """Stages by name; each reads the tables of earlier ones."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings()):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings
        self.kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.kept[name] if name in self.kept else self.spark.read.parquet(f"{self.folder}/{name}")

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write a stage's table and read it again; ``by`` keeps it in buckets, which this session's later stages know."""
        if by:
            self.kept[name] = bucketed(df, name, by, path=f"{self.folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)

    def hash_counting(self, reads: DataFrame) -> None:
        """wheels, hashed_reads, counts, weights, conditioned."""
        s = self.settings
        reads = ingest.prepared(reads, s.k, s.q_offset, s.id_type)
        sample = hyperplane.sample_kmers(reads, s.k, 2 * s.k * s.hash_size, seed=s.seed)
        wheels = hyperplane.make_wheels(sample, s.k, s.hash_size, seed=s.seed)
        self.keep(hyperplane.wheels_frame(self.spark, wheels), "wheels")
        hashed = hyperplane.hash_reads(reads, wheels, s.k, both_strands=s.both_strands).drop("kept", "q_offset")
        hashed = self.keep(hyperplane.paired_bins(hashed), "hashed_reads")
        counts = self.keep(abundance.counts_of_reads(hashed), "counts", "bin")
        weights = self.keep(abundance.idf_weights(counts), "weights", "bin")
        self.keep(abundance.conditioned(counts, weights, s.hash_size), "conditioned", "bin")

    def kmer_clustering(self) -> None:
        """lsi, vectors, centroids, members, cluster_stats."""
        s, conditioned = self.settings, self.table("conditioned")
        samples = conditioned.select("sample").distinct().count()
        if samples <= spectral.MOST_SAMPLES:
            names, u, sigma = spectral.eigenspace(spectral.gram(conditioned), s.rank)
            self.keep(spectral.eigenspace_frame(self.spark, names, u, sigma), "lsi")
            vectors = self.keep(spectral.projected(conditioned, names, u), "vectors")
        else:
            found = svd.decompose(conditioned, s.rank, seed=s.seed)
            self.keep(found.frame(), "lsi")
            vectors = self.keep(found.projected(), "vectors")
        centroids = self.keep(cluster.leader_clusters(vectors, s.threshold, seed=s.seed), "centroids")
        members = self.keep(cluster.assign_nearest(vectors, centroids, s.threshold), "members", "bin")
        self.keep(cluster.cluster_priors(members, self.table("weights"), samples, s.hash_size), "cluster_stats")

    def read_partitioning(self) -> DataFrame:
        """read_partitions: reads with their cluster. Mates share their bins, and so their cluster."""
        hashed = self.table("hashed_reads")
        if self.settings.least_file_reads:
            hashed = partition.large_files(hashed, self.settings.least_file_reads)
        hashed = hashed.withColumn("read", F.concat_ws("\t", "sample", "part", "pair_key"))
        bins = self.keep(partition.bin_table(self.table("members"), self.table("weights")), "bin_table", "bin")
        evidence = partition.read_evidence(hashed.dropDuplicates(["read"]), bins)
        best = partition.best_cluster(evidence, self.table("cluster_stats"))
        return self.keep(partition.partitioned_reads(hashed.drop("bins"), best), "read_partitions")

    def run(self, reads: DataFrame) -> DataFrame:
        self.hash_counting(reads)
        self.kmer_clustering()
        return self.read_partitioning()
