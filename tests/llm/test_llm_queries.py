"""The registered queries against their SQL, on whole tables."""

import pytest
from compare import duck_rows, spark_rows

import __spark_entry__ as entry_point
from codecat.llm import queries

SF_DIR = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(entry_point.queries())
    assert {int(k[2:].split("_")[0]) for k in queries.queries()} == set(range(1, 14))


@pytest.mark.parametrize("key", sorted(queries.oracles()))
def test_query(spark, key):
    expected = duck_rows(SF_DIR, queries.oracles()[key])
    assert spark_rows(queries.queries()[key](spark, SF_DIR)) == expected
