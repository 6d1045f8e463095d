"""Every query against its SQL in DuckDB, and the driver's entry."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from twinsift.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    result = duck.execute(catalogue.ORACLE_SQL[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    theirs = sorted(repr([plain(r[at[c]]) for c in columns]) for r in result.fetchall())
    assert mine == theirs


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {"exact", "perceptual"} <= {r["match_type"] for r in rows}


def test_names_of_sql_are_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
