import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest as B
from barloom.operators.series import index_series
from barloom.session import materialize


def curve_of(bars, **options):
    return materialize(B.run_signal_backtest(bars, **options), "curve")


def column(df, name):
    return [r[name] for r in df.orderBy("symbol", "idx").collect()]


def test_long_only_equity(make_bars):
    curve = curve_of(make_bars([100.0, 110.0, 121.0], signal=[1, 1, 1]), initial_balance=100.0)
    assert column(curve, "equity") == pytest.approx([100.0, 110.0, 121.0])
    trades = B.extract_trades(curve)
    row = B.backtest_metrics(curve, trades, 100.0).first()
    assert row["total_return"] == pytest.approx(0.21) and row["trades"] == 1.0
    assert trades.first()["trade_return"] == pytest.approx(0.21)
    assert row["profit_factor"] == float("inf") and row["win_rate"] == 1.0


def test_spread_cost_lands_on_the_next_bar(make_bars):
    curve = curve_of(make_bars([100.0, 100.0], spread=[0.1, 0.1], signal=[1, -1]))
    assert column(curve, "strategy_return") == pytest.approx([0.0, -0.001])
    curve = curve_of(make_bars([100.0, 101.0, 100.0], spread=[0.5] * 3, signal=[1, -1, 1]))
    assert column(curve, "strategy_return")[1] == pytest.approx(0.005)


@pytest.mark.parametrize(
    "raw, hold, expected",
    [([1, -1, -1, -1, -1, 1, 1, 1, 1, -1], 4, [1, 1, 1, 1, -1, -1, -1, -1, 1, 1]), ([1, -1, 1], 10, [1, 1, 1])],
)
@pytest.mark.parametrize("block_rows", [16, 8192])
def test_positions_are_held(make_bars, raw, hold, expected, block_rows):
    bars = index_series(make_bars([100.0] * len(raw), signal=raw))
    assert column(B.bar_returns(bars, hold_bars=hold, block_rows=block_rows), "position") == expected


def test_hold_must_be_positive(make_bars):
    with pytest.raises(ValueError):
        B.bar_returns(index_series(make_bars([1.0], signal=[1])), hold_bars=0)


def test_positions_outside_the_domain_fail(make_bars):
    with pytest.raises(Exception, match="cannot be traded"):
        B.run_signal_backtest(make_bars([1.0, 2.0], signal=[1, 0])).collect()


def positions_frame(make_bars, closes, positions):
    """Curve input with given positions and equity equal to the close."""
    df = index_series(make_bars(closes, position=positions))
    from pyspark.sql import Window

    prev = F.coalesce(F.lag("position").over(Window.partitionBy("symbol").orderBy("idx")), F.lit(0))
    return df.withColumn("prev_position", prev).withColumn("equity", F.col("close"))


def test_one_long_trade_ends_where_the_position_ends(make_bars):
    trades = B.extract_trades(positions_frame(make_bars, [100.0, 110.0, 105.0], [1, 1, 0])).collect()
    assert len(trades) == 1
    t = trades[0]
    assert (t["direction"], t["entry_idx"], t["exit_idx"], t["bars_held"]) == ("LONG", 0, 2, 2)
    assert t["win"] and t["trade_pnl_usd"] == 5.0


def test_flat_and_single_bar_series_have_no_trades(make_bars):
    assert B.extract_trades(positions_frame(make_bars, [100.0, 110.0], [0, 0])).count() == 0
    assert B.extract_trades(positions_frame(make_bars, [100.0], [1])).count() == 0


def test_a_flip_on_the_last_bar_is_a_trade_of_length_zero(make_bars):
    trades = B.extract_trades(positions_frame(make_bars, [100.0, 110.0, 120.0], [1, 1, -1])).orderBy("entry_idx")
    rows = [(t["direction"], t["entry_idx"], t["exit_idx"], t["win"]) for t in trades.collect()]
    assert rows == [("LONG", 0, 2, True), ("SHORT", 2, 2, False)]


def plain_backtest(close, spread, raw, hold, balance):
    """The definition as a loop."""
    n = len(close)
    pos = [raw[i - i % hold] for i in range(n)]
    r = [0.0] * n
    for t in range(1, n):
        before = pos[t - 2] if t > 1 else 0
        r[t] = pos[t - 1] * (close[t] / close[t - 1] - 1) - abs(pos[t - 1] - before) * spread[t - 1] / close[t - 1]
    equity = balance * np.cumprod(1 + np.array(r))
    trades, active, entry = [], 0, 0
    for i, p in enumerate(pos):
        if p == active:
            continue
        if active:
            trades.append((entry, i))
        active, entry = p, i
    if active and n > 1:
        trades.append((entry, n - 1))
    return pos, r, equity, trades


@pytest.mark.parametrize("block_rows, hold", [(16, 4), (64, 7), (8192, 1)])
def test_backtest_matches_a_loop_for_any_block(long_bars, block_rows, hold):
    curve = curve_of(long_bars, hold_bars=hold, block_rows=block_rows)
    got = curve.toPandas()
    trades = B.extract_trades(curve, block_rows).toPandas()
    sharpe = {r["symbol"]: r["sharpe"] for r in B.sharpe_ratio(curve).collect()}
    raw = long_bars.toPandas().sort_values(["symbol", "bar_start"])
    for symbol, g in raw.groupby("symbol"):
        pos, r, equity, expected = plain_backtest(
            g.close.tolist(), g.spread.tolist(), g.signal.tolist(), hold, 10_000.0
        )
        c = got[got.symbol == symbol].sort_values("idx")
        assert c.position.tolist() == pos
        np.testing.assert_allclose(c.strategy_return, r, rtol=1e-12, atol=1e-15)
        np.testing.assert_allclose(c.equity, equity, rtol=1e-10)
        np.testing.assert_allclose(c.peak, np.maximum.accumulate(equity), rtol=1e-10)
        np.testing.assert_allclose(c.bar_pnl, np.diff(equity, prepend=equity[0]), atol=1e-7)
        t = trades[trades.symbol == symbol].sort_values("entry_idx")
        assert list(zip(t.entry_idx, t.exit_idx)) == expected
        np.testing.assert_allclose(t.trade_pnl_usd, [equity[b] - equity[a] for a, b in expected], atol=1e-7)
        er = np.diff(equity) / equity[:-1]
        assert sharpe[symbol] == pytest.approx(np.sqrt(252 * 24) * er.mean() / er.std(), rel=1e-9)


def test_without_price_moves_sharpe_and_drawdown_are_zero(make_bars):
    curve = curve_of(make_bars([100.0] * 5, signal=[1] * 5))
    assert B.sharpe_ratio(curve).first()["sharpe"] == 0.0
    assert B.max_drawdown(curve).first()["max_drawdown"] == 0.0
    row = B.backtest_metrics(curve, B.extract_trades(curve)).first()
    assert (row["trades"], row["win_rate"], row["profit_factor"], row["trade_signals"]) == (1.0, 0.0, 0.0, 1.0)


def test_zero_close_counts_as_a_full_loss_and_costs_nothing(make_bars):
    curve = B.run_signal_backtest(make_bars([0.0, 5.0, 5.0], spread=[1.0] * 3, signal=[1, 1, 1]))
    assert column(curve, "strategy_return") == [0.0, -1.0, 0.0]


def test_missing_spread_is_free(make_bars):
    curve = B.run_signal_backtest(make_bars([100.0, 110.0], signal=[1, 1]).drop("spread"))
    assert column(curve, "strategy_return") == pytest.approx([0.0, 0.1])


def test_summaries(make_bars):
    curve = curve_of(make_bars([100.0, 110.0, 100.0, 90.0], signal=[1, -1, -1, 1]), initial_balance=100.0)
    trades = materialize(B.extract_trades(curve), "trades")
    s = B.trade_summary(trades).first()
    assert (s["total_trades"], s["wins"], s["losses"], s["long_trades"], s["short_trades"]) == (3, 2, 1, 2, 1)
    assert s["avg_bars_held"] == 1.0 and s["max_loss_usd"] == 0.0
    e = B.exposure(curve).first()
    assert (e["long_bar_count"], e["short_exposure_pct"]) == (2, 50.0)
    t = B.turnover(curve, trades).first()
    assert t["turnover"] == 0.75 and t["win_rate"] == round(2 / 3, 6)
    assert B.turnover(curve).first()["win_rate"] == 1.0
    held = B.buy_hold_curve(curve).orderBy("bar_start").collect()
    assert [r["buy_hold"] for r in held] == pytest.approx([100.0, 110.0, 100.0, 90.0])
    assert B.trades_table(trades).columns[-2:] == ["entry_time", "exit_time"]


def test_unlabelled_bars_have_no_prediction(make_bars):
    curve = curve_of(make_bars([100.0, 101.0, 102.0, 103.0], signal=[1] * 4), keep=["signal"])
    labeled = curve.where("idx in (0, 2)").select("symbol", "bar_start", F.lit(1).alias("label"), F.lit(1).alias("prediction"))
    rows = B.predictions_table(curve, labeled, "signal").orderBy("bar_start").collect()
    assert [r["prediction"] for r in rows] == [1, None, 1, None]
    assert rows[0]["bar_pnl_usd"] == 0.0


def test_series_without_trades_have_a_summary_of_zeros(spark, make_bars):
    curve = curve_of(make_bars([100.0, 110.0, 100.0], signal=[1, -1, 1]), initial_balance=100.0)
    trades = B.extract_trades(curve).withColumn("symbol", F.lit("B"))
    row = B.trade_summary(trades, curve=curve).first()
    assert row["symbol"] == "A" and {row[c] for c in row.asDict() if c != "symbol"} == {0}
