"""Every registered comparison query against its SQL."""

import pytest

from driftloom.plans import registry
from tests.oracle import SF, actual, expected


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, name):
    assert actual(registry.QUERIES[name](spark, SF)) == expected(registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
