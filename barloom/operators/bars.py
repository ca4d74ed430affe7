"""Ticks to OHLCV bars."""

from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import drop_null_rows, utc_literal
from barloom.schema import BAR_START, SYMBOL, TIMESTAMP
from barloom.session import materialize, prepare_session

# --- fixed values: microseconds per timeframe unit ---------------------------
UNIT_MICROS = {
    "s": 1_000_000,
    "m": 60_000_000,
    "h": 3_600_000_000,
    "d": 86_400_000_000,
    "w": 604_800_000_000,
}
CALENDAR_UNITS = {"mo": "month", "q": "quarter", "y": "year"}
MONDAY_OFFSET_MICROS = 4 * UNIT_MICROS["d"]  # 1970-01-05 was a Monday


def _parse(timeframe: str) -> tuple[int, str]:
    m = re.fullmatch(r"(\d+)(s|m|h|d|w|mo|q|y)", timeframe)
    if not m or int(m[1]) < 1:
        raise ValueError(f"unsupported timeframe {timeframe!r}")
    count, unit = int(m[1]), m[2]
    if unit in CALENDAR_UNITS and count != 1:
        raise ValueError("calendar timeframes support a single unit only")
    return count, unit


def bar_start(ts: Column, timeframe: str) -> Column:
    """Left edge of the bar: fixed steps count from the epoch, weeks from Monday."""
    count, unit = _parse(timeframe)
    if unit in CALENDAR_UNITS:
        return F.date_trunc(CALENDAR_UNITS[unit], ts)
    step = count * UNIT_MICROS[unit]
    offset = MONDAY_OFFSET_MICROS if unit == "w" else 0
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros - F.lit(offset), F.lit(step)))


def _tick_order(has_seq: bool) -> Column:
    """One number that sorts ticks inside a bar: time first, then the whole ``seq``.

    A struct key would do the same but cannot live in a hash-aggregation buffer,
    and Spark would sort all ticks before the partial aggregation. A wide decimal
    can: the offset in the bar stands above the 65 bits of ``seq``. A tick without ``seq`` comes after those
    of its instant that have one; several such ticks have no order among them.
    """
    offset = F.unix_micros(TIMESTAMP) - F.unix_micros(BAR_START)
    if not has_seq:
        return offset
    above = offset.cast("decimal(17,0)") * F.lit(Decimal(1 << 65)).cast("decimal(20,0)")
    last = F.lit(Decimal(1 << 63)).cast("decimal(20,0)")
    return above + F.coalesce(F.col("seq").cast("decimal(20,0)"), last)


def project_ticks(ticks: DataFrame) -> DataFrame:
    """Mid price, spread and total volume per quote."""
    carried = [c for c in (SYMBOL, TIMESTAMP, "seq") if c in ticks.columns]
    return ticks.select(
        *carried,
        ((F.col("ask") + F.col("bid")) / 2).alias("mid"),
        (F.col("ask") - F.col("bid")).alias("spread"),
        (F.col("ask_volume") + F.col("bid_volume")).alias("tick_volume"),
    )


def between(ticks: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Restrict ticks by raw timestamp, which reaches the parquet scan as a filter.

    A filter on the computed bar start would not. Align the bounds to bar edges
    to get whole bars.
    """
    if start is not None:
        ticks = ticks.where(F.col(TIMESTAMP) >= utc_literal(start))
    if end is not None:
        ticks = ticks.where(F.col(TIMESTAMP) < utc_literal(end))
    return ticks


def build_bars(
    ticks: DataFrame,
    timeframe: str = "1h",
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """One bar per symbol and non-empty time span; bars with a NULL are dropped.

    All buffers are fixed-width, so this is a hash aggregation with map-side
    combine: what is shuffled is bars, not ticks.
    """
    prepare_session(ticks.sparkSession)
    quotes = project_ticks(between(ticks, start, end)).withColumn(
        BAR_START, bar_start(F.col(TIMESTAMP), timeframe)
    )
    quotes = quotes.withColumn("_order", _tick_order("seq" in ticks.columns))
    mid = F.col("mid")
    numeric_mid = F.when(~F.isnan(mid), mid)
    bars = quotes.groupBy(SYMBOL, BAR_START).agg(
        F.min_by("mid", "_order").alias("open"),
        F.coalesce(F.max(numeric_mid), F.max(mid)).alias("high"),
        F.min(mid).alias("low"),
        F.max_by("mid", "_order").alias("close"),
        F.coalesce(F.sum("tick_volume"), F.lit(0.0)).alias("volume"),
        F.avg("spread").alias("spread"),
        F.count(F.lit(1)).alias("tick_count"),
    )
    return drop_null_rows(bars)


def store_bars(ticks: DataFrame, timeframe: str = "1h") -> DataFrame:
    """Bars as a stored table, the input of every order-dependent operator."""
    return materialize(build_bars(ticks, timeframe), f"bars_{timeframe}")
