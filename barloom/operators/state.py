"""Features of new bars from a stored state instead of the whole history.

The state of a series is its last bars, as many as any window looks back, and the value of each exponential
average at the first of them. An average that is started afresh at that bar differs from the true
one by a term that shrinks by the same factor with every bar, so adding that term makes it exact.
Running sums enter the features through differences and deviations only, which do not depend on where a sum starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import config as C
from barloom.operators.indicators import MARKET_GROUPS, TREND, combine_market_features
from barloom.operators.series import IDX, SERIES_LEN, index_series
from barloom.schema import BAR_START, SYMBOL
from barloom.session import materialize

#: Bars that a state keeps: what windows look back. The averages of ``TREND`` go on from their own values.
HISTORY = max(g.look_back for g in MARKET_GROUPS if g is not TREND)
BAR_COLUMNS = (BAR_START, "open", "high", "low", "close", "volume", "spread", "tick_count")
IS_NEW = "is_new"


def series_state(featured: DataFrame) -> DataFrame:
    """(symbol, bars, value_<span> ...) from ``combine_market_features`` or ``continue_series``.

    At most ``HISTORY`` bars of a series are gathered.
    """
    kept = featured.where(F.col(IDX) >= F.col(SERIES_LEN) - HISTORY)
    averages = [
        F.min_by((F.col(f"ema_{span}") + 1) * F.col("close"), BAR_START).alias(f"value_{span}") for span in C.EMA_SPANS
    ]
    return kept.groupBy(SYMBOL).agg(F.sort_array(F.collect_list(F.struct(*BAR_COLUMNS))).alias("bars"), *averages)


def continue_series(state: DataFrame, bars: DataFrame) -> DataFrame:
    """The state's bars and ``bars`` with all features; those of rows with ``is_new`` equal the features from the full history.

    ``bars`` must lie after the state's bars of their symbol; a symbol without state starts anew, one without new
    bars keeps its state. Give the result to ``series_state`` for the next step.
    """
    tail = state.select(SYMBOL, F.inline("bars")).withColumn(IS_NEW, F.lit(False))
    rows = tail.unionByName(bars.select(SYMBOL, *BAR_COLUMNS).withColumn(IS_NEW, F.lit(True)))
    featured = combine_market_features(index_series(materialize(rows, "continued")))
    first = F.col("bars")[0]["close"]
    off = state.select(SYMBOL, *[(F.col(f"value_{span}") - first).alias(f"_off_{span}") for span in C.EMA_SPANS])
    both = featured.join(off, SYMBOL, "left")
    missed = {
        span: F.coalesce(F.col(f"_off_{span}"), F.lit(0.0)) * F.pow(F.lit(1 - 2 / (span + 1)), F.col(IDX)) for span in C.EMA_SPANS
    }
    share = {span: F.when(F.col("close") != 0, m / F.nullif("close", F.lit(0.0))).otherwise(0.0) for span, m in missed.items()}
    fast, slow = C.EMA_SPANS
    mended = {f"ema_{span}": F.col(f"ema_{span}") + share[span] for span in C.EMA_SPANS}
    mended["macd_pct"] = F.col("macd_pct") + share[fast] - share[slow]
    return both.withColumns(mended).select(*featured.columns)
