"""Every engine query against its oracle, at the smallest size."""

import pytest
from oracle import both

from quillspark.plans import queries as Q

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracle(spark, name):
    got, want = both(spark, Q.QUERIES[name], Q.ORACLES[name], FOLDER)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, name):
    Q.QUERIES[name](spark, FOLDER).collect()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
