"""Every registered query against its SQL on the smallest tables."""

import pytest

from pressgraph.registry import load_all
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query(spark, con, name):
    fn, sql = load_all()[name]
    ok, note = compare(spark, con, fn, sql, SF)
    assert ok, note
