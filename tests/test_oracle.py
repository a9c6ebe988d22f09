import pytest

import __spark_entry__ as entry
from tests.check import compare

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    assert "MISMATCH" not in compare(spark, "/root/testdata/sf0.001", name, QUERIES[name], ORACLES.get(name))


def test_entry(spark):
    assert entry.entry(spark).count() == 20
