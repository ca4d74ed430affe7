"""Queries of the operators against their SQL on the small tables."""

from pathlib import Path

import duckdb
import pytest
from tests_llm_help import SF

import __spark_entry__ as driver
from barloom.llm import queries
from barloom.llm.sql import SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(result.fetchall(), key=str)


def test_one_query_per_operator_and_the_pipeline():
    names = driver.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(SQL) <= set(driver.oracle_sql())
