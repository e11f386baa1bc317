"""Registered queries against their SQL on the test tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare_duckdb import assert_same, connection  # noqa: E402

from skeinlake.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    assert_same(queries.QUERIES[name](spark, FOLDER), connection(FOLDER), queries.SQL[name])


def test_one_query_for_each_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
