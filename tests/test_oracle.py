"""Every registered query of the core library against its SQL."""

import pytest

from larder.plans.oracles import ORACLES
from larder.plans.queries import QUERIES
from tests.oracle import compare

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLES[name], SMALL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
