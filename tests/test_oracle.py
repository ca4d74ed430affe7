"""Every query with a SQL counterpart, unrounded, against DuckDB on sf0.001."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as driver
from barloom import catalog, catalog_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog_sql.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.publish(catalog.RAW[name](spark, SF), 14)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "NestedLoop", "SortAggregate", "Python", "InPandas"):
        assert word not in plan
    got = df.toPandas()
    want = duck.execute(catalog_sql.SQL[name]).df()
    doubles = set(catalog_sql.DOUBLES[name])
    assert {c for c, t in df.dtypes if t == "double"} == doubles
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    keys = [c for c in got.columns if c not in doubles]
    order = keys + sorted(doubles) if keys else sorted(doubles)
    got, want = (x.sort_values(order).reset_index(drop=True) for x in (got, want))
    for c in got.columns:
        if c in doubles:
            w = want[c].astype(float).replace([np.inf, -np.inf], np.nan)
            np.testing.assert_allclose(got[c].astype(float), w, rtol=1e-9, atol=1e-9, err_msg=c)
        elif pd.api.types.is_numeric_dtype(got[c]):
            np.testing.assert_array_equal(got[c].astype(float), want[c].astype(float), err_msg=c)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


def test_entry_and_registry(spark):
    rows = {r["label"]: r["rows"] for r in driver.entry(spark).collect()}
    assert rows == {1: 60, -1: 62}
    assert set(driver.oracle_sql()) <= set(driver.queries())
