import pytest

from strandloom.plans.queries import ORACLES, QUERIES

from .conftest import canonical


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_has_the_rows_of_its_sql(spark, duck, sf_dir, name):
    assert canonical(QUERIES[name](spark, sf_dir).toPandas()) == canonical(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_spectrum_has_the_trace_of_the_gram_matrix(spark, sf_dir):
    from strandloom.plans import queries

    diagonal = QUERIES["gram_matrix"](spark, sf_dir).where("sample_i = sample_j").agg({"g": "sum"}).first()[0] * (1 << queries.BITS)
    names, _, s = queries.spectral.eigenspace(queries.spectral.gram(queries._conditioned(spark, sf_dir)), rank=20)
    assert len(names) == 20
    assert abs((s**2).sum() / diagonal - 1) < 1e-3
