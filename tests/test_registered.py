"""Every registered query beside its SQL over the small tables."""

import __spark_entry__ as entry
import pytest
from oracle_check import compare, connect

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    message, _, rows = compare(spark, duck, QUERIES[name], ORACLES.get(name), sf_dir)
    assert message is None
    assert rows > 0


def test_flagship_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
