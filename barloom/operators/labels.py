"""Fixed-horizon labels, chronological split and label summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import BUY, SELL
from barloom.functions import ieee_div, is_finite
from barloom.operators.indicators import Group, add_groups
from barloom.operators.series import BLOCK_ROWS, BlockWindows, index_series
from barloom.schema import BAR_START, IDX, SERIES_LEN, SYMBOL

SLICE_START = "slice_start"
SLICE_END = "slice_end"
LABEL_COLUMNS = ("future_return", "future_gap_hours", "label", "event_start", "event_end")
TRAIN, PURGE, TEST = "train", "purge", "test"


@dataclass(frozen=True)
class LabelOptions:
    """How far ahead a label looks, the least move, and the longest pause. The defaults."""

    horizon: int = 4
    threshold: float = 0.0005
    max_gap_hours: float | None = 5.0


@dataclass(frozen=True)
class SplitOptions:
    """Share of test bars and the bars left out before them. The defaults."""

    test_size: float = 0.20
    purge_bars: int = 4


def label_group(
    horizon: int = 4, threshold: float = 0.0005, max_gap_hours: float | None = None
) -> Group:
    """Label columns plus ``label_is_valid``.

    Rows look ahead only inside their slice ``[slice_start, slice_end)``: the
    last ``horizon`` bars of a slice have no label, and event coordinates count
    from the slice start.
    """
    if horizon < 1:
        raise ValueError("horizon must be >= 1")

    def stages(w: BlockWindows) -> list[dict[str, Column]]:
        inside = F.col(IDX) + horizon < F.col(SLICE_END)
        future, ahead = F.col("_future_close"), F.col("_future_ts")
        close, ret = F.col("close"), F.col("future_return")
        seconds = F.floor((F.unix_micros(ahead) - F.unix_micros(BAR_START)) / 1_000_000)
        checked = max_gap_hours is not None
        valid = is_finite(ret) & (F.abs(ret) > threshold)
        if checked:
            valid = valid & (F.col("future_gap_hours") <= max_gap_hours)
        return [
            {
                "_future_close": F.when(inside, F.lead("close", horizon).over(w.rows)),
                "_future_ts": F.when(inside, F.lead(BAR_START, horizon).over(w.rows)),
            },
            {
                "future_return": F.when(close != 0, ieee_div(future, close) - 1),
                "future_gap_hours": seconds / 3600 if checked else F.lit(float("nan")),
                "event_start": F.col(IDX) - F.col(SLICE_START),
                "event_end": F.least(F.col(IDX) + horizon, F.col(SLICE_END) - 1)
                - F.col(SLICE_START),
            },
            {
                "label": F.when(ret > threshold, BUY).otherwise(SELL),
                "label_is_valid": F.coalesce(valid, F.lit(False)),
            },
        ]

    return Group("label", (*LABEL_COLUMNS, "label_is_valid"), stages, look_ahead=horizon)


def whole_series_slice(indexed: DataFrame) -> DataFrame:
    return indexed.withColumn(SLICE_START, F.lit(0).cast("bigint")).withColumn(
        SLICE_END, F.col(SERIES_LEN)
    )


def keep_labeled(df: DataFrame) -> DataFrame:
    return df.where("label_is_valid").drop("label_is_valid", SLICE_START, SLICE_END)


def assign_future_return_labels(
    bars: DataFrame,
    horizon: int = 4,
    threshold: float = 0.0005,
    max_gap_hours: float | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Label +1 / -1 by the return ``horizon`` bars ahead; small moves are dropped."""
    group = label_group(horizon, threshold, max_gap_hours)
    indexed = bars if IDX in bars.columns else index_series(bars)
    return keep_labeled(add_groups(whole_series_slice(indexed), (group,), block_rows))


def chronological_split(
    indexed: DataFrame, test_size: float = 0.20, purge_bars: int = 4
) -> DataFrame:
    """Mark each bar as train, purge or test by its position in the series.

    Adds ``part`` and the slice bounds. The position and the length are already
    on the row, so this is a projection.
    """
    split = F.floor(F.col(SERIES_LEN) * F.lit(1 - test_size)).cast("bigint")
    test_start = split + purge_bars
    idx = F.col(IDX)
    part = F.when(idx < split, TRAIN).when(idx >= test_start, TEST).otherwise(PURGE)
    bounds = lambda train, purge, test: (
        F.when(idx < split, train).when(idx >= test_start, test).otherwise(purge)
    )
    return (
        indexed.withColumn("part", part)
        .withColumn(SLICE_START, bounds(F.lit(0).cast("bigint"), split, test_start))
        .withColumn(SLICE_END, bounds(split, test_start, F.col(SERIES_LEN)))
    )


def split_info(parts: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """Where each series is cut: first purged and first test bar, and bars and dates of every part."""
    bounds = [F.max(F.when(F.col("part") == TRAIN, F.col(SLICE_END))).alias("split")]
    bounds.append(F.max(F.when(F.col("part") == TEST, F.col(SLICE_START))).alias("test_start"))
    for part in (TRAIN, PURGE, TEST):
        own = F.col("part") == part
        bounds += [
            F.count_if(own).alias(f"{part}_bars"),
            F.min(F.when(own, F.col(BAR_START))).alias(f"{part}_from"),
            F.max(F.when(own, F.col(BAR_START))).alias(f"{part}_to"),
        ]
    return parts.groupBy(*by).agg(*bounds)


def label_distribution(labeled: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """Buy and sell counts, total and the ratio of the smaller to the larger class."""
    buy = F.count_if(F.col("label") == BUY)
    sell = F.count_if(F.col("label") == SELL)
    counts = labeled.groupBy(*by).agg(buy.alias("buy"), sell.alias("sell"))
    both = (F.col("buy") > 0) & (F.col("sell") > 0)
    ratio = F.least("buy", "sell") / F.greatest("buy", "sell")
    return counts.select(
        *by,
        "buy",
        "sell",
        (F.col("buy") + F.col("sell")).alias("total"),
        F.when(both, F.bround(ratio, 4)).otherwise(0.0).alias("balance_ratio"),
    )


def label_counts(labeled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per label and their share in percent, in label order."""
    from pyspark.sql import Window

    counts = labeled.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return counts.select(*by, "label", "rows", (100 * F.col("rows") / total).alias("pct")).orderBy(
        *by, "label"
    )
