"""Repairs against their SQL on events of which several have the same time, and on events over several months."""

from pathlib import Path

import pytest

from barloom import catalog, catalog_sql
from tests.test_oracle import SF, pytestmark  # noqa: F401


@pytest.fixture(scope="module", params=(0, 30), ids=("equal-times", "more-months"))
def copies(request, tmp_path_factory):
    """Three copies of the events under ids of their own; ``param`` days lie between a copy and the next."""
    duckdb = pytest.importorskip("duckdb")
    con, folder = duckdb.connect(), tmp_path_factory.mktemp("copies")
    later = f"ts + INTERVAL ({request.param} * copy) DAY"
    rows = f"SELECT event_id + 1000 * copy AS event_id, {later} AS ts, user_id, event_type, value, props FROM '{Path(SF)}/events.parquet', range(3) c(copy)"
    con.execute(f"COPY ({rows}) TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    return con, str(folder)


@pytest.mark.parametrize("name", ["patch_merge", "repair_absent_month", "repair_missing_hours", "repair_report"])
def test_repairs_match_sql_on_copies(spark, copies, name):
    con, folder = copies
    got = catalog.publish(catalog.RAW[name](spark, folder), catalog.DIGITS[name])
    columns = sorted(got.columns)
    want = con.execute(catalog_sql.published(name)).df()[columns]
    got = got.toPandas()[columns]
    assert len(got) == len(want)
    as_text = lambda df: sorted(map(tuple, df.astype(str).replace({"None": "nan", "<NA>": "nan"}).values.tolist()))
    assert as_text(got) == as_text(want)
