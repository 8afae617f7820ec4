import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import topk
from strandloom.llm.oracles import ORACLES
from strandloom.llm.queries import op11_exact_top_k

from ..conftest import canonical

VECTORS = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k=topk.K, every=topk.EVERY):
    """(query_id, rank, vec_id, score) from all pairs of rows."""
    usable = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, x) in enumerate(usable):
        if i is None or i % every:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), j is None, j or 0, j) for b, (j, y) in enumerate(usable) if a != b)
        out += [(i, n + 1, s[3], -s[0]) for n, s in enumerate(scores[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_rows_of_the_sql(spark, duck, sf_dir):
    assert canonical(op11_exact_top_k(spark, sf_dir).toPandas()) == canonical(duck.execute(ORACLES["op11_exact_top_k"]).df())


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=7)]) for i in range(40, 160)]
    rows += [(i, [0.5, -0.25, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(300, 340)]  # ties of whole scores
    rows += [(100, rows[60][1]), (100, [1.0] * 7), (None, [3.0] * 7), (200, None), (250, [1.0, None]), (400, [float("nan")] * 7), (450, [float("inf")] * 7)]
    rows += [(500, []), (550, [2.0, 1.0]), (600, [1.0] * 9), (-50, [0.1] * 7)]
    return rows


@pytest.mark.parametrize("lists,chunk,block", [(2, 4096, 512), (3, 16, 2), (1, 50, 3), (11, 7, 1)])
def test_against_all_pairs(spark, odd, lists, chunk, block):
    """Ties, repeated ids and rows, null and non-finite components, lengths of all kinds, clashing columns."""
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in odd], VECTORS).repartition(3)
    fine = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.scaled(F.col("embedding")).alias("vec"))
    asked = F.coalesce(F.col("vec_id") % topk.EVERY == 0, F.lit(False))
    assert got(topk.top_k(fine, asked, lists=lists, chunk_rows=chunk, block_rows=block)) == brute(odd)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (2, [0.0, -1.0])]
    frame = lambda r: spark.createDataFrame([(i, v, "", "") for i, v in r], VECTORS)
    assert got(topk.nearest_vectors(frame(rows))) == brute(rows)
    assert got(topk.nearest_vectors(frame(rows[:1]))) == []
    assert got(topk.nearest_vectors(frame([]))) == []
    assert got(topk.nearest_vectors(frame([(50, None)]))) == []


def test_large_components_stay_exact(spark):
    rows = [(50 * i, [float(2**17 + i), float(-(2**16) - 3 * i), float(i)]) for i in range(20)]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    assert got(topk.nearest_vectors(df)) == brute(rows)
    with pytest.raises(ValueError):
        topk.nearest_vectors(spark.createDataFrame([(0, [1e9]), (1, [1e9])], "vec_id long, embedding array<double>"))


def test_the_cutoff_spares_most_entries(spark):
    """What the second phase hands on is a small share of all local scores, and the answer is in it."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    seen = []
    whole = topk._local
    try:
        topk._local = lambda pairs, kind, exact, k: seen.append(whole(pairs, kind, exact, k)) or seen[-1]
        n = topk.nearest_vectors(df).count()
    finally:
        topk._local = whole
    queries, rows = df.where("vec_id % 50 = 0").count(), df.count()
    entries = seen[1].agg(F.sum(F.length("q") / 2)).first()[0]
    assert n == topk.K * queries
    assert entries < 0.2 * queries * rows * topk.LISTS


def test_no_matrix_goes_through_the_driver(spark, odd, monkeypatch):
    """Neither in the phases that are written nor in the last: a broadcast of matrices is collected by the driver."""
    plans = []
    written = topk.table

    def seen(df, label):
        plans.append(df)
        return written(df, label)

    monkeypatch.setattr(topk, "table", seen)
    plans.append(topk.nearest_vectors(spark.createDataFrame([(i, v, "", "") for i, v in odd], VECTORS)))
    mode = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = "\n".join(df._jdf.queryExecution().explainString(mode) for df in plans)
    sent = re.findall(r"\) BroadcastExchange\s+Input \[\d+\]: \[(.*?)\]", text)
    assert "SortMergeJoin" in text and not [x for x in sent if "mat" in x]
