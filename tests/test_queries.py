"""Every registered query against its SQL, on the smallest tables."""

import compare
import pytest

import __spark_entry__ as contract
from fleetlens.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def duck(small):
    return compare.connect(small)


# At the smallest scale these find nothing to report; sf0.01 has rows for them.
MAY_BE_EMPTY = set()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(name, spark, small, duck):
    problems = compare.compare(QUERIES[name].frame(spark, small), duck, QUERIES[name].oracle())
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "empty result"]
    assert problems == []


def test_contract(spark):
    assert set(contract.oracle_sql()) >= set(QUERIES)
    assert set(contract.queries()) >= set(contract.oracle_sql())
    assert contract.entry(spark).count() > 0
