import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import cluster, metric
from strandloom.plans.stored import stored

VECTORS = "bin long, vec array<double>"


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, [float(y) for y in x]) for i, x in enumerate(v)], VECTORS)


def centres(spark, v):
    return stored(spark.createDataFrame([(i, [float(y) for y in x], i % 7) for i, x in enumerate(v)], "cluster int, c array<double>, n long"), "centres")


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("dims,threshold,block,pivots", [(3, 0.2, 2, 3), (3, 0.9, 5, 8), (16, 0.4, 7, 4), (2, 0.999, 1, 1)])
def test_metric_join_has_the_pairs_of_all_against_all(spark, dims, threshold, block, pivots):
    rng = np.random.default_rng(dims)
    v, c = rng.normal(size=(300, dims)), rng.normal(size=(60, dims))
    v[5], c[7], c[9] = 0, 0, c[8]  # a vector and a centroid without direction, two equal centroids
    with np.errstate(invalid="ignore"):
        dist = 1 - unit(v) @ unit(c).T
    want = sorted((i, j) for i, j in zip(*np.nonzero(dist < 1 - threshold)))
    got = metric.near(frame(spark, v), "bin", centres(spark, c), 1 - threshold, block=block, pivots=pivots).collect()
    assert sorted((r["bin"], r["cluster"]) for r in got) == want
    assert all(abs(r["dist"] - dist[r["bin"], r["cluster"]]) < 1e-12 for r in got)


def test_assignment_by_broadcast_by_join_and_plainly(spark):
    rng = np.random.default_rng(4)
    v, c = rng.normal(size=(200, 3)), rng.normal(size=(40, 3))
    dist = 1 - unit(v) @ unit(c).T
    want = []
    for i in range(200):
        near = sorted((d, j) for j, d in enumerate(dist[i]) if d < 0.8)[:5]
        want += [(i, j, n + 1, round(d, 9)) for n, (d, j) in enumerate(near)]
    vectors, given = frame(spark, v), centres(spark, c)
    key = lambda df: sorted((r["bin"], r["cluster"], r["rank"], round(r["dist"], 9)) for r in df.collect())
    assert key(cluster.assign_nearest(vectors, given, 0.2)) == sorted(want)
    assert key(cluster.assign_nearest(vectors, given, 0.2, broadcast_bytes=0)) == sorted(want)
    none = given.where("false")
    assert cluster.assign_nearest(vectors, none, 0.2).count() == 0 and metric.near(vectors, "bin", none, 0.5, 5).count() == 0
    assert cluster.assign_nearest(vectors.where("false"), given, 0.2, broadcast_bytes=0).count() == 0


def test_bounds_spare_most_comparisons(spark):
    """Centroids in tight cells: a vector meets its own neighbourhood only."""
    rng = np.random.default_rng(8)
    c = np.repeat(np.eye(8), 50, axis=0) + rng.normal(scale=0.02, size=(400, 8))
    v = np.repeat(np.eye(8), 100, axis=0) + rng.normal(scale=0.02, size=(800, 8))
    given = centres(spark, c)
    pivots = metric._pivots(given, 32, 1)
    blocks = metric._blocks(given, pivots, 25)
    sent = metric.routed(frame(spark, v), "bin", blocks, pivots, 0.05)
    compared = sent.join(blocks.select("block", F.size("ids").alias("k")), "block").agg(F.sum(F.size("keys") * F.col("k"))).first()[0]
    assert compared < 0.35 * 400 * 800


def test_clusters_of_a_hundred_thousandth_are_found(spark):
    """200,000 vectors, two of them in a direction of their own, over many tasks; counts add up to the vectors."""
    n = 200_000
    noise = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000 - 0.5) * 0.1
    main = F.pmod(F.col("id"), F.lit(5))
    axis = lambda d: F.when(F.col("id") < n - 2, (main == d).cast("double")).otherwise(1.0 if d == 5 else 0.0)
    vectors = spark.range(n).select(F.col("id").alias("bin"), F.array(*[axis(d) + noise(d) for d in range(6)]).alias("vec"))
    found = cluster.leader_clusters(vectors, 0.8, part_rows=20_000).collect()
    assert [r["n"] for r in found if abs(r["c"][5]) > 0.5] == [2]
    assert sum(r["n"] for r in found) == n and len(found) == 6
    c = unit(np.array([r["c"] for r in found]))
    assert (1 - (c @ c.T) + np.eye(6) * 2 >= 0.2).all()


def test_leaders_depend_on_the_vectors_only(spark):
    v = np.random.default_rng(3).normal(size=(500, 5))
    found = lambda df: [(r["cluster"], r["n"], tuple(np.round(r["c"], 9))) for r in cluster.leader_clusters(df, 0.5, part_rows=100).orderBy("cluster").collect()]
    a, b = found(frame(spark, v)), found(frame(spark, v).repartition(7, "bin"))
    assert a == b and sum(x[1] for x in a) == 500 and [x[0] for x in a] == list(range(len(a)))
    assert cluster.leader_clusters(frame(spark, v).where("false"), 0.5).count() == 0
    assert cluster.leader_clusters(frame(spark, np.zeros((3, 2))), 0.5).count() == 0


def test_recentred_clusters_cover_all_vectors(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([np.eye(4)[i] * (i + 1) + rng.normal(scale=0.02, size=(20, 4)) for i in range(4)])
    centroids, members = cluster.recentred(frame(spark, v), 0.8)
    assert centroids.count() == 4
    rows = members.collect()
    assert {r["bin"] for r in rows} == set(range(80)) and len(rows) == 80
    assert len({(r["bin"] // 20, r["cluster"]) for r in rows}) == 4
