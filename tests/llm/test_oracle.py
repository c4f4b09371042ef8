"""Queries of this package that SQL can state, against DuckDB."""

import pytest

from logfault.llm.queries import ORACLE, QUERIES
from logfault.plans.check import compare


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    problem, rows, _, _ = compare(spark, "/root/testdata/sf0.01", name, QUERIES[name], ORACLE[name])
    assert problem is None
    assert rows > 0


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
