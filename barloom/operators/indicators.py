"""Technical indicators over bars.

An indicator group is a list of stages. Stage k may read columns of earlier
stages; equal stages of all requested groups are computed together, so any
choice of groups needs one exchange, one sort and a handful of window nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import config as C
from barloom.functions import clip_lower, clip_upper, ieee_div, iso_weekday, log1p_ieee
from barloom.operators.series import (
    BLOCK_ROWS,
    BlockWindows,
    block_windows,
    ema_history,
    ema_stages,
    index_series,
    own_rows,
    with_halo,
    with_sub_block,
)
from barloom.schema import BAR_START, IDX, SYMBOL

@dataclass(frozen=True)
class Roll:
    """Aggregate over the last ``rows`` rows, NULL until ``rows`` values are there."""

    fn: str
    x: str
    rows: int

    def windowed(self, w: BlockWindows) -> dict[str, Column]:
        frame = w.rows.rowsBetween(-(self.rows - 1), 0)
        aggregate = getattr(F, self.fn)
        return {
            self.count: F.count(self.x).over(frame),
            self.value: aggregate(self.x).over(frame),
        }

    def gated(self) -> Column:
        return F.when(F.col(self.count) == self.rows, F.col(self.value))

    @property
    def count(self) -> str:
        return f"_count_{self.x}_{self.rows}"

    @property
    def value(self) -> str:
        return f"_{self.fn}_{self.x}_{self.rows}"


# A stage holds window expressions and Rolls on their own, or row expressions
# over earlier columns. Mixing them would make Spark compute a window once per
# mention; named columns are computed once and shared by all groups.
Stages = list[dict[str, Column | Roll]]


@dataclass(frozen=True)
class Group:
    """Named indicators, how far they look, and the stages that compute them."""

    name: str
    outputs: tuple[str, ...]
    stages: Callable[[BlockWindows], Stages]
    look_back: int = 0
    look_ahead: int = 0


def _mean(x: str, rows: int) -> Roll:
    return Roll("avg", x, rows)


def _std(x: str, rows: int) -> Roll:
    return Roll("stddev_samp", x, rows)


def _previous(w: BlockWindows, *columns: str, rows: int = 1) -> dict[str, Column]:
    return {f"_{c}_{rows}": F.lag(c, rows).over(w.rows) for c in columns}


def _z_score(x: str, rows: int, out: str) -> Stages:
    mean, std = f"_mean_{x}", f"_std_{x}"
    return [
        {mean: _mean(x, rows), std: _std(x, rows)},
        {out: ieee_div(F.col(x) - F.col(mean), std)},
    ]


def _true_range() -> Column:
    """``greatest`` skips NULLs, so the first bar counts as high - low."""
    high, low, prev = F.col("high"), F.col("low"), F.col("_close_1")
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def _returns(w: BlockWindows) -> Stages:
    lags: dict[str, Column | Roll] = {}
    for k in C.RETURN_WINDOWS:
        lags |= _previous(w, "close", rows=k)
    return [
        lags,
        {f"return_{k}": ieee_div("close", f"_close_{k}") - 1 for k in C.RETURN_WINDOWS},
    ]


def _hourly_return(w: BlockWindows) -> Stages:
    return [_previous(w, "close"), {"return_1h": ieee_div("close", "_close_1") - 1}]


def _trend(w: BlockWindows) -> Stages:
    sub = ema_history(C.EMA_SPANS)
    close = F.col("close")
    fast, slow = (F.col(f"_ema_{s}") for s in C.EMA_SPANS)
    stages: Stages = [{}, {}, {}, {}]
    for span in C.EMA_SPANS:
        for stage, step in zip(stages, ema_stages("close", span, sub, w)):
            stage |= step
    return [
        *stages,
        {
            "ema_12": ieee_div(fast, close) - 1,
            "ema_26": ieee_div(slow, close) - 1,
            "macd_pct": ieee_div(fast - slow, close),
        },
    ]


def _rsi(w: BlockWindows) -> Stages:
    delta = F.col("close") - F.col("_close_1")
    return [
        _previous(w, "close"),
        {"_gain": clip_lower(delta, 0.0), "_loss": -clip_upper(delta, 0.0)},
        {"_avg_gain": _mean("_gain", C.RSI_WINDOW), "_avg_loss": _mean("_loss", C.RSI_WINDOW)},
        {"rsi_14": 100 - ieee_div(F.lit(100.0), 1 + ieee_div("_avg_gain", "_avg_loss"))},
    ]


def _adx(w: BlockWindows) -> Stages:
    up = F.col("high") - F.col("_high_1")
    down = F.col("_low_1") - F.col("low")
    plus_di = ieee_div(100 * F.col("_plus_mean"), "_atr")
    minus_di = ieee_div(100 * F.col("_minus_mean"), "_atr")
    return [
        _previous(w, "close", "high", "low"),
        {
            "_tr": _true_range(),
            "_plus_dm": F.when(up > down, clip_lower(up, 0.0)).otherwise(0.0),
            "_minus_dm": F.when(down > up, clip_lower(down, 0.0)).otherwise(0.0),
        },
        {
            "_atr": _mean("_tr", C.ATR_WINDOW),
            "_plus_mean": _mean("_plus_dm", C.ADX_WINDOW),
            "_minus_mean": _mean("_minus_dm", C.ADX_WINDOW),
        },
        {"_dx": F.abs(plus_di - minus_di) / clip_lower(plus_di + minus_di, 1e-8) * 100},
        {"adx_14": _mean("_dx", C.ADX_WINDOW)},
    ]


def _atr(w: BlockWindows) -> Stages:
    return [
        _previous(w, "close"),
        {"_tr": _true_range()},
        {"_atr": _mean("_tr", C.ATR_WINDOW)},
        {"atr_14": ieee_div("_atr", "close")},
    ]


def _bollinger(w: BlockWindows) -> Stages:
    mid, std = F.col("_bb_mid"), F.col("_bb_std")
    return [
        {"_bb_mid": _mean("close", C.BOLLINGER_WINDOW), "_bb_std": _std("close", C.BOLLINGER_WINDOW)},
        {
            "bb_width": ieee_div(4 * std, mid),
            "bb_position": ieee_div(F.col("close") - mid, 2 * std),
        },
    ]


def _volatility(w: BlockWindows) -> Stages:
    short, long = C.VOLATILITY_WINDOWS
    return [
        _previous(w, "close"),
        {"_ret": ieee_div("close", "_close_1") - 1},
        {"volatility_24": _std("_ret", long), "_vol_short": _std("_ret", short)},
        {"vol_ratio_6_24": ieee_div("_vol_short", "volatility_24")},
    ]


def _spread_z(w: BlockWindows) -> Stages:
    return _z_score("spread", C.SPREAD_Z_WINDOW, "spread_z_24")


def _range_position(w: BlockWindows) -> Stages:
    low, high = F.col("_range_low"), F.col("_range_high")
    return [
        {
            "_range_low": Roll("min", "low", C.RANGE_WINDOW),
            "_range_high": Roll("max", "high", C.RANGE_WINDOW),
        },
        {"close_in_range_24": ieee_div(F.col("close") - low, high - low)},
    ]


def _obv(w: BlockWindows) -> Stages:
    """The level is counted from the block start: both outputs ignore a constant."""
    close, prev = F.col("close"), F.col("_close_1")
    direction = F.when(close > prev, 1).otherwise(F.when(close < prev, -1).otherwise(0))
    running = w.rows.rowsBetween(Window.unboundedPreceding, 0)
    z_windows, z_score = _z_score("_obv", C.OBV_Z_WINDOW, "obv_z_48")
    return [
        _previous(w, "close"),
        {"_signed_volume": direction * F.col("volume")},
        {"_obv": F.sum("_signed_volume").over(running)},
        z_windows | _previous(w, "_obv", rows=C.OBV_DELTA_WINDOW),
        z_score | {"obv_delta_12": F.col("_obv") - F.col(f"__obv_{C.OBV_DELTA_WINDOW}")},
    ]


def _candle(w: BlockWindows) -> Stages:
    open_, high, low, close = (F.col(c) for c in ("open", "high", "low", "close"))
    return [
        {
            "body_pct": ieee_div(close - open_, close),
            "upper_wick_pct": ieee_div(high - F.greatest(open_, close), close),
            "lower_wick_pct": ieee_div(F.least(open_, close) - low, close),
            "range_pct": ieee_div(high - low, close),
        }
    ]


def _microstructure(w: BlockWindows) -> Stages:
    windows, z_score = _z_score("tick_count", C.TICK_COUNT_Z_WINDOW, "tick_count_z_24")
    return [
        windows
        | {
            "spread_pct": ieee_div("spread", "close"),
            "log_tick_count": log1p_ieee("tick_count"),
        },
        z_score,
    ]


def _calendar(w: BlockWindows) -> Stages:
    hour = 2 * math.pi * F.hour(BAR_START) / 24
    day = 2 * math.pi * iso_weekday(BAR_START) / 7
    return [
        {
            "hour_sin": F.sin(hour),
            "hour_cos": F.cos(hour),
            "dow_sin": F.sin(day),
            "dow_cos": F.cos(day),
        }
    ]


RETURNS = Group("returns", ("return_4", "return_12"), _returns, look_back=12)
TREND = Group("trend", ("ema_12", "ema_26", "macd_pct"), _trend, look_back=ema_history(C.EMA_SPANS))
RSI = Group("rsi", ("rsi_14",), _rsi, look_back=15)
ADX = Group("adx", ("adx_14",), _adx, look_back=28)
ATR = Group("atr", ("atr_14",), _atr, look_back=15)
BOLLINGER = Group("bollinger", ("bb_width", "bb_position"), _bollinger, look_back=19)
VOLATILITY = Group("volatility", ("volatility_24", "vol_ratio_6_24"), _volatility, look_back=25)
SPREAD_Z = Group("spread_z", ("spread_z_24",), _spread_z, look_back=23)
RANGE_POSITION = Group("range_position", ("close_in_range_24",), _range_position, look_back=23)
OBV = Group("obv", ("obv_z_48", "obv_delta_12"), _obv, look_back=48)
CANDLE = Group(
    "candle", ("body_pct", "upper_wick_pct", "lower_wick_pct", "range_pct"), _candle
)
MICROSTRUCTURE = Group(
    "microstructure", ("spread_pct", "log_tick_count", "tick_count_z_24"), _microstructure, look_back=23
)
CALENDAR = Group("calendar", ("hour_sin", "hour_cos", "dow_sin", "dow_cos"), _calendar)
HOURLY_RETURN = Group("hourly_return", ("return_1h",), _hourly_return, look_back=1)

MARKET_GROUPS = (
    RETURNS, TREND, RSI, ADX, ATR, BOLLINGER, VOLATILITY, SPREAD_Z, RANGE_POSITION,
    OBV, CANDLE, MICROSTRUCTURE, CALENDAR,
)


def add_groups(
    indexed: DataFrame,
    groups: Sequence[Group],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the outputs of ``groups`` to indexed bars in one blocked pass."""
    carried = indexed.columns
    outputs = [c for g in groups for c in g.outputs]
    rowwise = all(g.look_back == 0 and g.look_ahead == 0 for g in groups)
    w = block_windows()
    stages = [g.stages(w) for g in groups]
    if rowwise:
        df = indexed
    else:
        before = max(g.look_back for g in groups)
        sub_rows = ema_history(C.EMA_SPANS) if TREND in groups else block_rows
        if block_rows % sub_rows:
            raise ValueError(f"block_rows must be a multiple of {sub_rows}")
        df = with_halo(indexed, before, max(g.look_ahead for g in groups), block_rows)
        df = with_sub_block(df, sub_rows)
    known: set[str] = set()
    for depth in range(max(len(s) for s in stages)):
        windows: dict[str, Column] = {}
        step: dict[str, Column] = {}
        for stage in (s[depth] for s in stages if depth < len(s)):
            for name, expr in stage.items():
                if isinstance(expr, Roll):
                    windows |= expr.windowed(w)
                    expr = expr.gated()
                step.setdefault(name, expr)
        for columns in (windows, step):
            new = {k: v for k, v in columns.items() if k not in known}
            if new:
                df = df.withColumns(new)
                known |= set(new)
    if not rowwise:
        df = own_rows(df)
    return df.select(*carried, *outputs)


def _on_bars(bars: DataFrame, groups: Sequence[Group], block_rows: int) -> DataFrame:
    indexed = bars if IDX in bars.columns else index_series(bars)
    return add_groups(indexed, groups, block_rows)


def add_return_features(bars: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return _on_bars(bars, (RETURNS,), block_rows)


def combine_market_features(bars: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All feature columns, in one pass over the bars."""
    return _on_bars(bars, MARKET_GROUPS, block_rows)


def select_features(bars: DataFrame, keys: Sequence[str] = (SYMBOL, BAR_START)) -> DataFrame:
    """The keys and those of the model's features that ``bars`` has, in the model's order."""
    return bars.select(*keys, *[c for c in C.FEATURES if c in bars.columns])
