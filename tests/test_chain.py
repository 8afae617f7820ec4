import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import chain


def plainly(rows):
    out, lib, edge = [], -1, None
    for s, lo, hi in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if edge is None or lo > edge:
            lib, edge = lib + 1, hi
        out.append((lib, s))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "sample string, lo double, hi double")


@pytest.mark.parametrize("part,n,width", [(4, 60, 5), (1, 20, 30), (7, 100, 0), (4096, 50, 3), (3, 90, 200)])
def test_windows_are_those_of_a_walk(spark, part, n, width):
    rng = random.Random(part * n)
    rows = [(f"s{i:03d}", float(lo), float(lo + rng.randint(0, width))) for i in range(n) for lo in [rng.randint(0, 150)]]
    got = sorted((r["lib"], r["sample"]) for r in chain.windows(frame(spark, rows), part).collect())
    assert got == plainly(rows)


def test_few_rows_ties_and_nulls(spark):
    assert chain.windows(frame(spark, [])).count() == 0
    rows = [("a", 1.0, 1.0), ("b", 1.0, 1.0), ("c", 1.0, 2.0), ("d", 2.0, 2.0), ("e", 2.5, 9.0)]
    odd = [("x", None, 1.0), ("y", 1.0, None)]
    assert sorted((r["lib"], r["sample"]) for r in chain.windows(frame(spark, rows + odd), 2).collect()) == plainly(rows)


def test_a_hundred_thousand_samples(spark):
    """No row and no task sees all samples: parts of 4096, and pointers that are doubled."""
    n = 100_000
    lo = F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double")
    rows = spark.range(n).select(F.format_string("s%06d", "id").alias("sample"), lo.alias("lo"), (lo + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(300))).alias("hi"))
    got = chain.windows(rows).toPandas()
    assert len(got) == n
    want = plainly([tuple(r) for r in rows.toPandas().itertuples(index=False)])
    assert sorted(zip(got["lib"], got["sample"])) == want
