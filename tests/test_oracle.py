import pytest

from scoreloom.plans import catalogue
from tests import parity

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return parity.connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, con, name):
    parity.same(QUERIES[name](spark, sf), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"word_order_similarity"}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
