"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest
from conftest import same_rows

from tradewire.plans.queries import ORACLES, QUERIES


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) >= 40


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    same_rows(QUERIES[name](spark, sf), duck, ORACLES[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
