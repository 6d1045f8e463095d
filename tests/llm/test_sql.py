"""Queries with SQL against DuckDB."""

from pathlib import Path

import pytest

from tests.test_queries import SF, duck, plain  # noqa: F401
from twinsift.llm import queries


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(queries.ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    theirs = sorted(repr([plain(r[at[c]]) for c in columns]) for r in result.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect()) == theirs
