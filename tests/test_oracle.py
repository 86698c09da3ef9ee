"""Every registered query against its SQL at the smallest scale."""

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(key, spark, sf, duck):
    frame = QUERIES[key](spark, sf)
    if key not in ORACLES:
        assert frame.count() >= 0
        return
    problem = compare(frame, duck, ORACLES[key])
    assert problem is None or problem.startswith("EMPTY"), problem
