"""Every registered query beside its SQL on the smallest tables."""

import pytest

from tests.oracle import compare, connection
from tidemark import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, duck, name):
    assert compare(spark, duck, registry.QUERIES[name], registry.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
