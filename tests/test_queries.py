"""Every registered query of the catalogue against its SQL, on whole tables."""

import pytest
from compare import duck_rows, spark_rows

import __spark_entry__ as entry_point
from codecat.workload import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


def test_each_query_has_sql():
    assert set(queries.queries()) == set(oracles.oracles())
    assert set(queries.queries()) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("key", sorted(queries.queries()))
def test_query(spark, key):
    expected = duck_rows(SF_DIR, entry_point.oracle_sql()[key])
    assert spark_rows(entry_point.queries()[key](spark, SF_DIR)) == expected


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
