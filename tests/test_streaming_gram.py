import shutil

import numpy as np

from strandloom.operators import spectral
from strandloom.streaming import gram

SCHEMA = "sample string, bin long, x double"


def test_batches_in_any_order_and_twice_give_the_whole(spark, tmp_path):
    rng = np.random.default_rng(2)
    a = np.where(rng.random((9, 60)) < 0.5, rng.normal(size=(9, 60)), 0)
    rows = [(f"s{i}", int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))]
    order = [2, 0, 1]
    for n in order:  # bins of a batch lie together
        part = spark.createDataFrame([r for r in rows if r[1] % 3 == n], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for turn in range(2):  # the second run has lost its checkpoint and does every batch again
        gram.stream_gram(stream(), str(tmp_path / "gram"), str(tmp_path / f"cp{turn}")).awaitTermination()
    gram.stream_eigenspace(stream(), str(tmp_path / "svd"), str(tmp_path / "cs"), 9).awaitTermination()
    whole = spark.createDataFrame(rows, SCHEMA)
    key = lambda df: {(r["sample_i"], r["sample_j"]): round(r["g"], 9) for r in df.collect()}
    assert key(gram.streamed_gram(spark, str(tmp_path / "gram"))) == key(spectral.gram(whole))
    _, s, _ = np.linalg.svd(a, full_matrices=False)
    found = gram.streamed_eigenspace(spark, str(tmp_path / "svd"), 6)
    assert np.allclose(found.sigma, s[:6], rtol=1e-8)
    shutil.rmtree(tmp_path / "svd" / "batch=0")
    assert gram.streamed_eigenspace(spark, str(tmp_path / "svd"), 6).energy < found.energy
