import pytest

from scenewatch.jobs import registry
from tests.compare import connect, rows_of, rows_of_sql


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert rows_of(registry.QUERIES[name](spark, sf_dir)) == rows_of_sql(con, registry.ORACLES[name])
