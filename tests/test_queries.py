"""Every registered query of the library against its SQL."""

import pytest
from oracle import rows_of, rows_of_sql

from tessella.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_of_sql(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
