"""Data-quality profiles of ticks and bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import is_finite, iso_weekday
from barloom.operators.indicators import HOURLY_RETURN, add_groups
from barloom.operators.quantiles import LINEAR, NEAREST, exact_quantiles
from barloom.operators.series import BAR_CHUNK, HOUR_CHUNK, index_series, shift_across, time_chunk
from barloom.schema import BAR_START, IDX, SYMBOL, TIMESTAMP
from barloom.session import materialize

HOUR_MICROS = 3_600_000_000
QUOTE_COLUMNS = ("ask", "bid", "ask_volume", "bid_volume")


def _spread() -> Column:
    return F.col("ask") - F.col("bid")


def tick_overview(
    ticks: DataFrame, by: Sequence[str] = (SYMBOL,), approximate: bool = False
) -> DataFrame:
    """Rows, time range, distinct timestamps (a NULL counts as one) and NULL counts.

    The exact distinct count shuffles the distinct timestamps; ``approximate``
    replaces it by a sketch that needs no more than map-side state.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    ts = F.col(TIMESTAMP)
    return ticks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(ts).alias("start"),
        F.max(ts).alias("end"),
        (distinct(ts) + F.max(ts.isNull().cast("int"))).alias("unique_timestamps"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in QUOTE_COLUMNS],
    )


def tick_quality(ticks: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """Counts of implausible quotes, in one pass with map-side combine."""
    checks = {
        "ask_non_positive": F.col("ask") <= 0,
        "bid_non_positive": F.col("bid") <= 0,
        "ask_below_bid": F.col("ask") < F.col("bid"),
        "negative_spread": _spread() < 0,
        "zero_spread": _spread() == 0,
        "negative_ask_volume": F.col("ask_volume") < 0,
        "negative_bid_volume": F.col("bid_volume") < 0,
    }
    return ticks.groupBy(*by).agg(*[F.count_if(v).alias(k) for k, v in checks.items()])


def spread_quantiles(ticks: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    spread = ticks.select(*by, _spread().alias("spread"))
    return exact_quantiles(
        spread,
        "spread",
        {
            "min": (0.0, NEAREST),
            "p01": (0.01, NEAREST),
            "p05": (0.05, NEAREST),
            "median": (0.5, LINEAR),
            "p95": (0.95, NEAREST),
            "p99": (0.99, NEAREST),
            "max": (1.0, NEAREST),
        },
        by,
    )


def duplicate_timestamps(ticks: DataFrame, top: int = 20) -> DataFrame:
    """The most repeated timestamps."""
    counts = ticks.groupBy(SYMBOL, TIMESTAMP).agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n > 1").orderBy(F.desc("n"), SYMBOL, TIMESTAMP).limit(top)


def first_rows(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def last_rows(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def _gaps(df: DataFrame, ts: str, chunk_seconds: int) -> DataFrame:
    times = df.select(SYMBOL, ts)
    shifted = shift_across(times, time_chunk(ts, chunk_seconds), [ts], {ts: "_previous"})
    gap = F.unix_micros(ts) - F.unix_micros("_previous")
    return shifted.select(SYMBOL, ts, gap.alias("gap_us")).where("gap_us is not null")


def tick_gaps(ticks: DataFrame) -> DataFrame:
    """Microseconds since the previous tick of the symbol; its first tick is dropped."""
    return _gaps(ticks, TIMESTAMP, HOUR_CHUNK)


def bar_gaps(bars: DataFrame) -> DataFrame:
    return _gaps(bars, BAR_START, BAR_CHUNK)


def gap_summary(gaps: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    return exact_quantiles(
        materialize(gaps.select(*by, "gap_us"), "gaps"),
        "gap_us",
        {
            "min_gap": (0.0, NEAREST),
            "p50_gap": (0.5, NEAREST),
            "p95_gap": (0.95, NEAREST),
            "p99_gap": (0.99, NEAREST),
            "max_gap": (1.0, NEAREST),
        },
        by,
    )


def large_gaps(gaps: DataFrame, ts: str, top: int = 20, longer_than: int = HOUR_MICROS) -> DataFrame:
    """The longest gaps above ``longer_than`` microseconds."""
    return gaps.where(F.col("gap_us") > longer_than).orderBy(F.desc("gap_us"), SYMBOL, ts).limit(top)


def with_hourly_return(bars: DataFrame) -> DataFrame:
    indexed = bars if IDX in bars.columns else index_series(bars)
    return add_groups(indexed, (HOURLY_RETURN,))


def bar_summary(bars: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """Range, close extremes, one-bar return statistics and medians per symbol."""
    if "return_1h" not in bars.columns:
        bars = materialize(with_hourly_return(bars), "bar_returns")
    ret = F.col("return_1h")
    plain = bars.groupBy(*by).agg(
        F.min(BAR_START).alias("start"),
        F.max(BAR_START).alias("end"),
        F.count(F.lit(1)).alias("bars"),
        F.min("close").alias("min_close"),
        F.max("close").alias("max_close"),
        F.avg(ret).alias("mean_return_1h"),
        F.stddev_samp(ret).alias("std_return_1h"),
    )
    metrics = {"return_1h": ret, "spread": F.col("spread"), "tick_count": F.col("tick_count")}
    long = bars.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("x")) for k, v in metrics.items()])
        ).alias("_m"),
    ).select(*by, "_m.metric", "_m.x")
    spots = {"p01": (0.01, NEAREST), "median": (0.5, LINEAR), "p99": (0.99, NEAREST)}
    found = exact_quantiles(long, "x", spots, [*by, "metric"])
    pick = lambda metric, q: F.max(F.when(F.col("metric") == metric, F.col(q)))
    wide = found.groupBy(*by).agg(
        pick("return_1h", "p01").alias("p01_return_1h"),
        pick("return_1h", "p99").alias("p99_return_1h"),
        pick("spread", "median").alias("median_spread"),
        pick("tick_count", "median").alias("median_tick_count"),
    )
    return plain.join(wide, list(by), "left")


def seasonality(bars: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    """Mean tick count and spread and return volatility per weekday and hour."""
    bars = bars if "return_1h" in bars.columns else with_hourly_return(bars)
    return (
        bars.groupBy(*by, iso_weekday(BAR_START).alias("weekday"), F.hour(BAR_START).alias("hour"))
        .agg(
            F.avg("tick_count").alias("avg_tick_count"),
            F.avg("spread").alias("avg_spread"),
            F.stddev_samp("return_1h").alias("return_vol"),
        )
        .orderBy(*by, "weekday", "hour")
    )


def seasonality_pivot(
    season: DataFrame, value: str = "avg_tick_count", by: Sequence[str] = (SYMBOL,)
) -> DataFrame:
    """Weekday by hour matrix; the 24 columns are known, so no extra pass finds them."""
    wide = season.groupBy(*by, "weekday").pivot("hour", list(range(24))).agg(F.first(value))
    return wide.select(*by, "weekday", *[F.col(str(h)).alias(f"h{h:02d}") for h in range(24)])


def histogram(
    df: DataFrame, value: str, bins: int = 100, by: Sequence[str] = (SYMBOL,)
) -> DataFrame:
    """Equal-width bins between the group's finite extremes; the top edge is inclusive.

    NULL, NaN and infinite values are in no bin.
    """
    by = list(by)
    x = F.col(value).cast("double")
    values = df.where(F.coalesce(is_finite(x), F.lit(False))).select(*by, x.alias("_x"))
    edges = values.groupBy(*by).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    scaled = F.floor((F.col("_x") - F.col("_lo")) / width * bins)
    bin_no = F.coalesce(F.least(scaled, F.lit(bins - 1)), F.lit(0))
    counted = values.join(edges, by).groupBy(*by, bin_no.alias("bin"), "_lo", "_hi")
    step = (F.col("_hi") - F.col("_lo")) / bins
    return counted.agg(F.count(F.lit(1)).alias("rows")).select(
        *by,
        "bin",
        (F.col("_lo") + step * F.col("bin")).alias("bin_start"),
        (F.col("_lo") + step * (F.col("bin") + 1)).alias("bin_end"),
        "rows",
    )


def date_range(df: DataFrame, ts: str = BAR_START, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    return df.groupBy(*by).agg(F.min(ts).alias("start"), F.max(ts).alias("end"))
