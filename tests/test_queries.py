"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle_check import compare, connect

from docflow.workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok, note


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
