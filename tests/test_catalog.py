import pytest

from rillflow import catalog
from tests.conftest import SF
from tests.oracle import connect, same

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF, catalog.TABLES)


def test_all_have_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])
