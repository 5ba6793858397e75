"""Every registered query with SQL gives its SQL's rows; the others run."""

import pytest

from docloom.plans import change_queries, search_queries, stream_queries, text_queries  # noqa: F401
from docloom.plans.registry import ORACLES, QUERIES
from tests.compare import rows_equal

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    rows_equal(QUERIES[name](spark, SF), ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
