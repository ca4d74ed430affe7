"""Set-based backtest: positions, bar returns, equity, trades and their metrics.

Per-bar work runs in blocks of a series. Equity is a running product, so each
block contributes its product and its highest local level; the exclusive
product over earlier blocks is carried in by a join on the block key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import ANNUALIZATION, BUY, SELL
from barloom.functions import finite_or_zero
from barloom.operators.series import BLOCK, BLOCK_ROWS, index_series, shift_across, with_halo
from barloom.schema import BAR_START, IDX, SERIES_LEN, SYMBOL
from barloom.session import materialize


@dataclass(frozen=True)
class TradingOptions:
    """Bars between two decisions and the money at the start. The defaults."""

    hold_bars: int = 4
    balance: float = 10_000.0


def validate_positions(df: DataFrame, column: str = "position") -> DataFrame:
    """Fail the job when a position is neither -1 nor +1."""
    p = F.col(column)
    checked = F.when(p.isin(SELL, BUY), p).otherwise(
        F.raise_error(F.lit("a position other than -1 or +1 cannot be traded"))
    )
    return df.withColumn(column, checked.cast("int"))


def bar_returns(
    bars: DataFrame,
    signal: str = "signal",
    hold_bars: int = 1,
    block_rows: int = BLOCK_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Held position and strategy return per bar, in one blocked pass.

    The signal of bar ``k * hold_bars`` is held until the next decision. The
    return of bar t is earned by the position of t-1; turnover at t-1 costs the
    spread of t-1.
    """
    if hold_bars < 1:
        raise ValueError("hold_bars must be >= 1")
    spread = F.col("spread") if "spread" in bars.columns else F.lit(0.0)
    df = bars.select(
        SYMBOL, BAR_START, IDX, SERIES_LEN, "close", spread.alias("spread"),
        F.col(signal).cast("int").alias("_signal"), *keep,
    )
    df = with_halo(df, before=hold_bars + 1, block_rows=block_rows)
    w = Window.partitionBy(SYMBOL, BLOCK).orderBy(IDX)
    decided = F.when(F.pmod(F.col(IDX), F.lit(hold_bars)) == 0, F.col("_signal"))
    held = F.last(decided, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("position", held).withColumns(
        {
            "_position_1": F.lag("position", 1).over(w),
            "_position_2": F.lag("position", 2).over(w),
            "_close_1": F.lag("close", 1).over(w),
            "_spread_1": F.lag("spread", 1).over(w),
        }
    )
    close_1 = F.nullif(F.col("_close_1"), F.lit(0.0))
    price_return = F.coalesce(F.col("close") / close_1, F.lit(0.0)) - 1
    cost = F.coalesce(F.col("_spread_1") / close_1, F.lit(0.0))
    turnover = F.abs(F.col("_position_1") - F.coalesce("_position_2", F.lit(0)))
    earned = F.col("_position_1") * price_return - turnover * cost
    return df.where("is_own").select(
        SYMBOL, BAR_START, IDX, SERIES_LEN, BLOCK, "close", "spread", *keep, "position",
        F.coalesce("_position_1", F.lit(0)).alias("prev_position"),
        F.when(F.col(IDX) == 0, 0.0)
        .otherwise(F.coalesce(finite_or_zero(earned), F.lit(0.0)))
        .alias("strategy_return"),
    )


def equity_curve(returns: DataFrame, initial_balance: float = 10_000.0) -> DataFrame:
    """Equity, its running peak, drawdown and bar PnL. ``returns`` is read twice."""
    key = [SYMBOL, BLOCK]
    w = Window.partitionBy(*key).orderBy(IDX)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    growth = 1 + F.col("strategy_return")
    local = returns.withColumn("_level", F.product(growth).over(running))

    earlier = Window.partitionBy(SYMBOL).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        local.groupBy(*key)
        .agg(F.max_by("_level", IDX).alias("_end"), F.max("_level").alias("_top"))
        .withColumn("_carry", F.coalesce(F.product("_end").over(earlier), F.lit(1.0)))
        .withColumn("_top", F.col("_carry") * F.col("_top"))
        .select(*key, "_carry", F.max("_top").over(earlier).alias("_peak"))
    )
    scale = F.lit(initial_balance) * F.col("_carry")
    before = F.coalesce(F.col("_level_1"), F.lit(1.0))
    equity, peak = F.col("equity"), F.col("peak")
    return (
        local.withColumns(
            {
                "_level_1": F.lag("_level", 1).over(w),
                "_local_peak": F.max("_level").over(running),
            }
        )
        .join(carried, key)
        .withColumns(
            {
                "equity": scale * F.col("_level"),
                "prev_equity": F.when(F.col(IDX) > 0, scale * before),
                "peak": F.greatest(
                    scale * F.col("_local_peak"), F.lit(initial_balance) * F.col("_peak")
                ),
            }
        )
        .withColumn("drawdown", (equity - peak) / F.nullif(peak, F.lit(0.0)))
        .withColumn("bar_pnl", F.coalesce(equity - F.col("prev_equity"), F.lit(0.0)))
        .select(*returns.columns, "equity", "prev_equity", "peak", "drawdown", "bar_pnl")
    )


def extract_trades(curve: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per run of equal non-zero positions.

    Only bars where the position changes matter, plus the last bar as an exit
    marker: each change exits at the next marked bar. A change on the last bar
    is a trade of length zero; a series of one bar has none.
    """
    changed = F.col("position") != F.col("prev_position")
    is_last = F.col(IDX) == F.col(SERIES_LEN) - 1
    marked = curve.where(changed | is_last).select(
        SYMBOL, IDX, SERIES_LEN, BAR_START, "close", "equity", "position",
        changed.alias("_changed"),
    )
    exits = {IDX: "_exit_idx", "close": "_exit_close", "equity": "_exit_equity", BAR_START: "_exit_time"}
    rows = shift_across(marked, F.floor(F.col(IDX) / block_rows), [IDX], exits, forward=True)
    exit_ = {src: F.coalesce(dst, src) for src, dst in exits.items()}
    start = F.col("equity")
    pnl = exit_["equity"] - start
    return rows.where(
        F.col("_changed") & (F.col("position") != 0) & (F.col(SERIES_LEN) > 1)
    ).select(
        SYMBOL,
        F.col(IDX).alias("entry_idx"),
        exit_[IDX].alias("exit_idx"),
        F.col(BAR_START).alias("entry_time"),
        exit_[BAR_START].alias("exit_time"),
        F.when(F.col("position") > 0, "LONG").otherwise("SHORT").alias("direction"),
        F.col("close").alias("entry_price"),
        exit_["close"].alias("exit_price"),
        (exit_[IDX] - F.col(IDX)).alias("bars_held"),
        F.coalesce(exit_["equity"] / F.nullif(start, F.lit(0.0)) - 1, F.lit(0.0)).alias("trade_return"),
        pnl.alias("trade_pnl_usd"),
        (pnl > 0).alias("win"),
    )


def trades_table(trades: DataFrame) -> DataFrame:
    """Trades with times as text, positions in the series left out."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    kept = [c for c in trades.columns if c not in ("entry_idx", "exit_idx", "entry_time", "exit_time")]
    return trades.select(*kept, text("entry_time"), text("exit_time"))


def max_drawdown(curve: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    return curve.groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))


def _equity_return() -> Column:
    prev = F.col("prev_equity")
    return finite_or_zero(
        F.when(F.col(IDX) > 0, F.coalesce((F.col("equity") - prev) / F.nullif(prev, F.lit(0.0)), F.lit(0.0)))
    )


def _sharpe() -> Column:
    r = _equity_return()
    std = F.stddev_pop(r)
    ratio = ANNUALIZATION * F.avg(r) / F.nullif(std, F.lit(0.0))
    return F.coalesce(F.when(std > 0, ratio), F.lit(0.0))


def sharpe_ratio(curve: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """Annualised mean over population deviation of equity returns; 0 if undefined."""
    return curve.groupBy(*by).agg(_sharpe().alias("sharpe"))


def _win_rate() -> Column:
    return F.coalesce(F.avg(F.col("win").cast("int")), F.lit(0.0))


def _profit_factor() -> Column:
    pnl = F.col("trade_pnl_usd")
    gain = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))
    loss = F.abs(F.coalesce(F.sum(F.when(pnl < 0, pnl)), F.lit(0.0)))
    return (
        F.when(gain == 0, 0.0)
        .when(loss == 0, float("inf"))
        .otherwise(gain / F.nullif(loss, F.lit(0.0)))
    )


def trade_ratios(trades: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    return trades.groupBy(*by).agg(
        _win_rate().alias("win_rate"),
        F.count(F.lit(1)).cast("double").alias("trades"),
        _profit_factor().alias("profit_factor"),
    )


def backtest_metrics(
    curve: DataFrame, trades: DataFrame, initial_balance: float = 10_000.0, by: Sequence[str] = (SYMBOL,)
) -> DataFrame:
    """One row per series: return, drawdown, Sharpe, win rate, counts, profit factor."""
    changed = F.col("position") != F.col("prev_position")
    bars = curve.groupBy(*by).agg(
        (F.max_by("equity", IDX) / initial_balance - 1).alias("total_return"),
        F.min("drawdown").alias("max_drawdown"),
        _sharpe().alias("sharpe"),
        F.count_if(changed).cast("double").alias("trade_signals"),
    )
    zero = {"win_rate": 0.0, "trades": 0.0, "profit_factor": 0.0}
    return (
        bars.join(trade_ratios(trades, by), list(by), "left")
        .fillna(zero)
        .select(*by, "total_return", "max_drawdown", "sharpe", *list(zero)[:2], "trade_signals", "profit_factor")
    )


def trade_summary(
    trades: DataFrame, by: Sequence[str] = (SYMBOL,), curve: DataFrame | None = None
) -> DataFrame:
    """Counts and averages per series; with ``curve``, series without a trade have zeros."""
    pnl, win = F.col("trade_pnl_usd"), F.col("win")
    mean = lambda c, digits: F.coalesce(F.bround(F.avg(c), digits), F.lit(0.0))
    summary = trades.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(win).alias("wins"),
        F.count_if(~win).alias("losses"),
        mean(win.cast("int"), 4).alias("win_rate"),
        mean(F.col("bars_held"), 1).alias("avg_bars_held"),
        mean(pnl, 2).alias("avg_pnl_usd"),
        mean(F.when(win, pnl), 2).alias("avg_win_pnl_usd"),
        mean(F.when(~win, pnl), 2).alias("avg_loss_pnl_usd"),
        F.bround(F.max(pnl), 2).alias("max_win_usd"),
        F.bround(F.min(pnl), 2).alias("max_loss_usd"),
        F.count_if(F.col("direction") == "LONG").alias("long_trades"),
        F.count_if(F.col("direction") == "SHORT").alias("short_trades"),
    )
    if curve is None:
        return summary
    counts = [c for c in summary.columns if c not in by]
    return curve.select(*by).distinct().join(summary, list(by), "left").fillna(0, counts)


def exposure(curve: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """Bars long and short, and their share in percent."""
    counts = curve.groupBy(*by).agg(
        F.count_if(F.col("position") > 0).alias("long_bar_count"),
        F.count_if(F.col("position") < 0).alias("short_bar_count"),
        F.count(F.lit(1)).alias("_bars"),
    )
    pct = lambda c: F.bround(F.col(c) / F.col("_bars") * 100, 2)
    return counts.select(
        *by,
        "long_bar_count",
        "short_bar_count",
        pct("long_bar_count").alias("long_exposure_pct"),
        pct("short_bar_count").alias("short_exposure_pct"),
    )


def turnover(curve: DataFrame, trades: DataFrame | None = None, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """Share of bars with a position change, and the win rate.

    The win rate counts trades; without trades it counts bars with non-zero PnL.
    """
    by = list(by)
    pnl = F.col("bar_pnl")
    changed = (F.col("position") != F.col("prev_position")).cast("int")
    bars = curve.groupBy(*by).agg(
        F.bround(F.avg(changed), 6).alias("turnover"),
        F.coalesce(F.avg(F.when(pnl != 0, (pnl > 0).cast("int"))), F.lit(0.0)).alias("_bar_rate"),
    )
    if trades is None:
        return bars.select(*by, F.bround("_bar_rate", 6).alias("win_rate"), "turnover")
    rates = trades.groupBy(*by).agg(_win_rate().alias("_trade_rate"))
    rate = F.bround(F.coalesce("_trade_rate", "_bar_rate"), 6)
    return bars.join(rates, by, "left").select(*by, rate.alias("win_rate"), "turnover")


def buy_hold_curve(curve: DataFrame) -> DataFrame:
    """What the first bar's equity would be worth if held in the asset."""
    first = curve.where(F.col(IDX) == 0).select(
        SYMBOL, F.col("close").alias("_close_0"), F.col("equity").alias("_equity_0")
    )
    held = F.col("_equity_0") * F.col("close") / F.nullif(F.col("_close_0"), F.lit(0.0))
    return curve.join(first, SYMBOL).select(SYMBOL, BAR_START, "equity", held.alias("buy_hold"))


def predictions_table(curve: DataFrame, labeled_predictions: DataFrame, signal: str = "raw_signal") -> DataFrame:
    """Every backtest bar with label and prediction where the bar is labelled."""
    return curve.join(labeled_predictions, [SYMBOL, BAR_START], "left").select(
        SYMBOL,
        BAR_START,
        "close",
        "spread",
        "label",
        "prediction",
        signal,
        F.col("position").alias("executed_position"),
        F.col("bar_pnl").alias("bar_pnl_usd"),
        F.col("equity").alias("equity_usd"),
    )


def run_signal_backtest(
    bars: DataFrame,
    signal: str = "signal",
    hold_bars: int = 1,
    initial_balance: float = 10_000.0,
    block_rows: int = BLOCK_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Equity curve of a signal column; the bar returns are stored on the way.

    ``bars`` should be a stored table unless it is indexed already.
    """
    indexed = bars if IDX in bars.columns else index_series(bars)
    checked = validate_positions(indexed, signal)
    returns = materialize(bar_returns(checked, signal, hold_bars, block_rows, keep), "returns")
    return equity_curve(returns, initial_balance)
