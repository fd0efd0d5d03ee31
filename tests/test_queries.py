"""Every registered query: against its SQL where it has one, else that it runs and gives rows."""

import pytest

from routecast import registry
from tests.oracle import connect, compare

SF = "/root/testdata/sf0.001"
registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, con, name):
    compare(registry.QUERIES[name](spark, SF), con, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
