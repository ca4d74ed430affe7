"""Hot keys and plan shapes."""

import re

import pytest
from pyspark.sql import functions as F

from barloom import catalog
from barloom.operators import archive, backtest, profile
from barloom.operators.bars import build_bars
from barloom.operators.series import index_series, with_halo
from tests.test_oracle import SF, pytestmark  # noqa: F401


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_over_bars_are_keyed_by_block_or_chunk(spark):
    """Only windows over chunk summaries may be partitioned by symbol alone."""
    for name in ("all_features", "labels_fixed_horizon", "equity_curve", "bar_gaps_top20"):
        plan = plan_of(catalog.RAW[name](spark, SF))
        for line in re.findall(r"Window \[.*", plan):
            partition = line.rsplit("], [", 2)[1] if line.count("], [") >= 2 else line.rsplit("], [", 1)[1]
            wide = "block" in partition or "_chunk" in partition or "_decision" in partition
            assert wide or "_chunk" in line or "block" in line or "_rows" in line, line[:300]


@pytest.fixture(scope="module")
def hot_ticks(make_ticks):
    """One symbol holds most ticks, most of them within one minute."""
    from datetime import timedelta

    from tests.conftest import T0

    rows = []
    for i in range(3000):
        seconds = i % 60 if i % 3 else i * 40
        rows.append(("HOT", T0 + timedelta(seconds=seconds), i, 101.0 + i % 7, 100.0, 1.0, 1.0))
    rows += [(f"S{i % 50}", T0 + timedelta(minutes=i), i, 101.0, 100.0, 1.0, 1.0) for i in range(500)]
    return make_ticks(rows)


def test_hot_symbol_results_are_whole(hot_ticks):
    assert build_bars(hot_ticks).agg(F.sum("tick_count")).first()[0] == 3500
    gaps = profile.tick_gaps(hot_ticks)
    assert gaps.count() == 3500 - 51
    seconds = hot_ticks.where("symbol = 'HOT'").toPandas().timestamp.sort_values().diff().dropna()
    hot = gaps.where("symbol = 'HOT'").toPandas().gap_us
    assert sorted(hot) == sorted((seconds.dt.total_seconds() * 1e6).astype(int))
    merged = archive.patch_merge(hot_ticks, hot_ticks.withColumn("ask", F.lit(5.0)))
    assert merged.count() == hot_ticks.select("symbol", "timestamp").distinct().count()
    assert merged.where("ask = 5").count() == 0


def test_halo_overhead_is_bounded(long_bars):
    indexed = index_series(long_bars)
    assert with_halo(indexed, before=48, block_rows=512).count() < 1.11 * 2670


def test_results_do_not_depend_on_shuffle_partitions(spark, long_bars):
    totals = set()
    for n in (1, 3, 16):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        curve = backtest.run_signal_backtest(long_bars, hold_bars=4, block_rows=64)
        row = curve.agg(F.sum("idx"), F.max("equity"), F.min("drawdown")).first()
        totals.add((row[0], round(row[1], 6), round(row[2], 12)))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(totals) == 1


def exchanges_of(plan, key):
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and key in line]


def test_blocks_are_dealt_once(spark, long_bars):
    """One exchange by block serves the held position, its lags and every step of the averages."""
    plans = [plan_of(catalog.RAW[name](spark, SF)) for name in ("ema_macd", "all_features")]
    plans.append(plan_of(backtest.bar_returns(index_series(long_bars.drop("idx")), hold_bars=4)))
    for plan in plans:
        assert len(exchanges_of(plan, "block#")) == 1, plan


def test_averages_do_not_depend_on_the_order_of_rows(spark, long_bars):
    from barloom.operators.indicators import TREND, add_groups

    def averages(bars):
        rows = add_groups(index_series(bars), (TREND,), 4096).orderBy("symbol", "idx")
        return rows.select("symbol", "idx", "ema_12", "ema_26").collect()

    bars = long_bars.drop("idx")
    once = averages(bars.coalesce(1))
    assert len(once) == 2670 and max(r["idx"] for r in once) > 3 * 512
    for seed in (1, 2):
        assert averages(bars.orderBy(F.rand(seed)).repartition(7)) == once
