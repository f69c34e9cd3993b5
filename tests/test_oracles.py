"""Every registered query beside its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


# The text operators have their own tests, which may be deleted together with them.
NAMES = sorted(n for n in entry.queries() if n not in entry.LLM_QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    result = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        # Nothing to compare with: the whole result twice, the same rows both times.
        first = sorted(map(str, result.collect()))
        assert first and first == sorted(map(str, entry.queries()[name](spark, SF).collect()))
    else:
        assert compare(result, duck, sql) == []


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
