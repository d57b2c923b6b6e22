import pytest

from tessera.plans import queries

from .oracle import connection, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_matches_oracle(spark, con, name):
    ok, seen = same(spark, queries.queries()[name], queries.oracle_sql()[name], SF, con)
    assert ok, seen
