from __future__ import annotations

import pytest

from hexsupport.llm import queries
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))
