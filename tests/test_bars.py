from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators.bars import between, build_bars
from tests.conftest import T0


def tick(seconds, mid, seq=0, spread=0.02, symbol="A", volume=1.0):
    return (symbol, T0 + timedelta(seconds=seconds), seq, mid + spread / 2, mid - spread / 2, volume, volume)


def test_bar_values_and_no_empty_bars(make_ticks):
    ticks = make_ticks([tick(10, 100.0), tick(20, 105.0), tick(30, 95.0), tick(3599, 101.0), tick(7200, 50.0)])
    rows = build_bars(ticks).orderBy("bar_start").collect()
    assert [r["bar_start"] for r in rows] == [T0, T0 + timedelta(hours=2)]
    first = rows[0]
    assert (first["open"], first["high"], first["low"], first["close"]) == (100.0, 105.0, 95.0, 101.0)
    assert first["volume"] == 8.0 and first["tick_count"] == 4
    assert first["spread"] == pytest.approx(0.02)


def test_equal_timestamps_are_ordered_by_seq(make_ticks):
    rows = [tick(5, 100.0 + s, seq=s) for s in (7, 3, 9, 5)]
    bar = build_bars(make_ticks(rows)).first()
    assert (bar["open"], bar["close"]) == (103.0, 109.0)


@pytest.mark.parametrize("edge", [2**21, 2**31, 2**62])
@pytest.mark.parametrize("timeframe", ["1h", "1d", "1mo", "1y"])
def test_equal_timestamps_keep_the_order_of_any_seq(make_ticks, timeframe, edge):
    rows = [tick(5, 22.0, seq=edge), tick(5, 11.0, seq=edge - 1), tick(5, 10.0, seq=-1)]
    bar = build_bars(make_ticks(rows), timeframe).first()
    assert (round(bar["open"], 6), round(bar["close"], 6)) == (10.0, 22.0)


def test_null_at_the_open_drops_the_bar(make_ticks):
    missing = ("A", T0, 0, None, 100.0, 1.0, 1.0)
    ticks = make_ticks([missing, tick(10, 100.0), tick(3600, 100.0)])
    assert [r["bar_start"] for r in build_bars(ticks).collect()] == [T0 + timedelta(hours=1)]


def test_all_null_volume_sums_to_zero(make_ticks):
    rows = [("A", T0, 0, 2.0, 1.0, None, 1.0), ("A", T0 + timedelta(seconds=1), 1, 2.0, 1.0, 1.0, None)]
    assert build_bars(make_ticks(rows)).first()["volume"] == 0.0


def test_high_ignores_nan(make_ticks):
    nan = ("A", T0 + timedelta(seconds=5), 1, float("nan"), 1.0, 1.0, 1.0)
    bar = build_bars(make_ticks([tick(0, 100.0), nan, tick(9, 99.0)])).first()
    assert (bar["high"], bar["low"]) == (100.0, 99.0)


@pytest.mark.parametrize(
    "timeframe, expected",
    [("15m", datetime(2024, 1, 10, 7, 30)), ("4h", datetime(2024, 1, 10, 4)), ("1d", datetime(2024, 1, 10)),
     ("1w", datetime(2024, 1, 8)), ("1mo", datetime(2024, 1, 1)), ("1q", datetime(2024, 1, 1))],
)
def test_timeframes(make_ticks, timeframe, expected):
    at = datetime(2024, 1, 10, 7, 42, 1)
    ticks = make_ticks([("A", at, 1, 2.0, 1.0, 1.0, 1.0)])
    assert build_bars(ticks, timeframe).first()["bar_start"] == expected


def test_unknown_timeframe(make_ticks):
    with pytest.raises(ValueError):
        build_bars(make_ticks([]), "2mo")


def test_time_before_the_epoch_falls_into_the_earlier_bar(make_ticks):
    ticks = make_ticks([("A", datetime(1969, 12, 31, 23, 59, 59), 1, 2.0, 1.0, 1.0, 1.0)])
    assert build_bars(ticks).first()["bar_start"] == datetime(1969, 12, 31, 23)


def test_bars_use_hash_aggregation_and_filters_reach_the_scan(spark, make_ticks, tmp_path):
    path = str(tmp_path / "ticks")
    make_ticks([tick(1, 100.0)]).write.parquet(path)
    ticks = between(spark.read.parquet(path), T0, T0 + timedelta(hours=1))
    plan = build_bars(ticks)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan


def test_one_hot_bar_is_the_same_on_any_partitioning(make_ticks):
    rows = [tick(i % 50, 100.0 + (i * 37 % 101) / 10, seq=i) for i in range(2000)]
    one = build_bars(make_ticks(rows).coalesce(1)).first()
    many = build_bars(make_ticks(rows).repartition(13)).first()
    for c in ("open", "high", "low", "close", "volume", "tick_count"):
        assert one[c] == many[c]
    assert one["spread"] == pytest.approx(many["spread"])
    assert build_bars(make_ticks(rows)).select(F.sum("tick_count")).first()[0] == 2000
