import calendar
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import archive as A
from barloom.sources import read_ticks, replace_months, write_ticks

NOW = datetime(2024, 3, 15)


def tick(ts, seq=0, ask=1.1, symbol="A", bid_volume=1.0):
    return (symbol, ts, seq, ask, 1.0, 1.0, bid_volume)


def slots_of(year, month, asset_class):
    out = []
    for day in range(1, calendar.monthrange(year, month)[1] + 1):
        wd = calendar.weekday(year, month, day)
        hours = range(24) if asset_class == "crypto" or wd < 5 else range(21, 24) if wd == 6 else ()
        out += [datetime(year, month, day, h) for h in hours]
    return out


@pytest.fixture(scope="module")
def february(make_ticks):
    """All trading hours of February 2024 but three."""
    gone = {datetime(2024, 2, 5, 3), datetime(2024, 2, 5, 4), datetime(2024, 2, 29, 23)}
    hours = [h for h in slots_of(2024, 2, "fx") if h not in gone]
    return make_ticks([tick(h + timedelta(minutes=i), i) for h in hours for i in (1, 30)]), sorted(gone)


@pytest.mark.parametrize("asset_class, month", [("fx", 1), ("fx", 2), ("crypto", 2)])
def test_calendar(spark, asset_class, month):
    months = spark.createDataFrame([("A", datetime(2024, month, 1))], "symbol string, month_start timestamp")
    got = sorted(r["slot"] for r in A.trading_calendar(months, asset_class).collect())
    assert got == slots_of(2024, month, asset_class)
    if (asset_class, month) == ("fx", 1):
        assert len(got) == 564


def test_missing_hours_and_ledger(february):
    ticks, gone = february
    assert sorted(r["slot"] for r in A.missing_hours(ticks).collect()) == gone
    row = A.month_ledger(ticks, NOW).first()
    assert (row["month"], row["missing_hours"], row["confirmed_absent"]) == ("2024-02", 3, 3)
    assert row["rows"] == ticks.count()
    assert A.month_ledger(ticks, NOW, verify=False).first()["missing_hours"] == 0


def test_open_months_stay_out_of_the_ledger(february):
    assert A.month_ledger(february[0], datetime(2024, 2, 20)).count() == 0


def test_repair_uses_only_missing_hours(february, make_ticks):
    ticks, gone = february
    patches = make_ticks(
        [tick(gone[0] + timedelta(minutes=5), 900, ask=9.0), tick(datetime(2024, 2, 5, 2, 5), 901, ask=9.0)]
    ).drop("bid_volume")
    repaired = A.repair_missing_hours(ticks, patches)
    new = repaired.where("ask = 9.0").collect()
    assert [r["timestamp"] for r in new] == [gone[0] + timedelta(minutes=5)]
    assert new[0]["bid_volume"] is None
    row = A.repair_report(ticks, repaired).first()
    assert (row["rows_added"], row["still_missing"]) == (1, 2)


def test_complete_archive_is_left_alone(make_ticks):
    full = make_ticks([tick(h) for h in slots_of(2024, 2, "fx")])
    patches = make_ticks([tick(datetime(2024, 2, 3, 12), 1)])
    assert A.repair_missing_hours(full, patches).count() == full.count()


def test_existing_rows_win_and_other_months_are_untouched(make_ticks):
    jan, feb = datetime(2024, 1, 5, 1), datetime(2024, 2, 5, 1)
    base = make_ticks([tick(jan, 1), tick(jan, 2), tick(feb, 5), tick(feb, 4)])
    patch = make_ticks([tick(feb, 1, ask=9.0), tick(feb + timedelta(hours=1), 7, ask=9.0)]).drop("bid_volume")
    rows = A.patch_merge(base, patch).orderBy("timestamp", "seq").collect()
    assert [(r["timestamp"].month, r["seq"]) for r in rows] == [(1, 1), (1, 2), (2, 4), (2, 7)]
    assert rows[2]["ask"] == 1.1 and rows[3]["bid_volume"] is None


def test_hot_timestamp_keeps_one_row(make_ticks):
    at = datetime(2024, 2, 5)
    ticks = make_ticks([tick(at, i) for i in range(500)] + [tick(at, 3, symbol="B")])
    got = A.dedup_keep_first(ticks.withColumn("p", F.lit(0)), "p").orderBy("symbol").collect()
    assert [(r["symbol"], r["seq"]) for r in got] == [("A", 0), ("B", 3)]


def test_month_enumeration(spark):
    months = lambda **kw: [
        r[0].strftime("%Y-%m") for r in A.enumerate_months(spark, (2023, 11), (2024, 6), NOW, **kw).collect()
    ]
    assert months() == ["2023-11", "2023-12", "2024-01", "2024-02", "2024-03"]
    assert months(skip_current=True)[-1] == "2024-02"


def test_upsert_pending_and_totals(spark):
    schema = "symbol string, month string, rows bigint, missing_hours bigint, confirmed_absent bigint"
    old = spark.createDataFrame([("A", "2024-01", 10, 5, 5), ("A", "2024-02", 7, 0, 0)], schema)
    new = spark.createDataFrame([("A", "2024-01", 12, 0, 0), ("B", "2024-01", 0, 9, 9)], schema)
    ledger = A.upsert_ledger(old, new)
    got = {(r["symbol"], r["month"]): (r["rows"], r["missing_hours"]) for r in ledger.collect()}
    assert got == {("A", "2024-01"): (12, 0), ("A", "2024-02"): (7, 0), ("B", "2024-01"): (0, 9)}
    months = ledger.select("symbol", "month")
    assert [tuple(r) for r in A.pending_months(months, ledger).collect()] == [("B", "2024-01")]
    assert A.pending_months(months, ledger, force=True).count() == 3
    assert tuple(A.archive_totals(ledger).first()) == (19, 9, 1)


def test_absent_months_are_missed_and_repaired(spark, make_ticks, tmp_path):
    def tick(month, hour, symbol="A", day=2):
        return (symbol, datetime(2024, month, day, hour), hour, 1.0, 0.9, 1.0, 1.0)

    base = make_ticks([tick(1, 1), tick(3, 1), tick(3, 2, "B")])
    months = A.symbol_months(base.where("symbol = 'A'"), A.enumerate_months(spark, (2024, 1), (2024, 3), datetime(2024, 5, 1)))
    assert months.count() == 3
    ledger = {r["month"]: r for r in A.month_ledger(base, datetime(2024, 5, 1), "crypto", months=months).collect()}
    assert {m: r["rows"] for m, r in ledger.items()} == {"2024-01": 1, "2024-02": 0, "2024-03": 1}
    assert ledger["2024-02"]["missing_hours"] == 29 * 24
    totals = A.archive_totals(A.month_ledger(base, datetime(2024, 5, 1), "crypto", months=months)).first()
    assert (totals["total_rows"], totals["total_errors"]) == (2, 1)

    patches = make_ticks([tick(2, 5), tick(1, 1, day=2), tick(3, 9), tick(4, 1)])
    complete = spark.createDataFrame([("A", "2024-03", 1, 0, 0)], "symbol string, month string, rows bigint, missing_hours bigint, confirmed_absent bigint")
    folder = str(tmp_path / "archive")
    write_ticks(base, folder)
    fixed = A.repair_months(read_ticks(spark, folder), patches, months, complete, "crypto")
    assert {(r["symbol"], r["month"]) for r in fixed.collect()} == {("A", "2024-02")}
    forced = A.repair_months(read_ticks(spark, folder), patches, months, complete, "crypto", force=True)
    assert {(r["symbol"], r["month"], r["seq"]) for r in forced.collect()} == {
        ("A", "2024-02", 5), ("A", "2024-03", 1), ("B", "2024-03", 2), ("A", "2024-03", 9),
    }
    replace_months(forced.drop("month"), folder)
    assert read_ticks(spark, folder).count() == 5
