"""Mergeable sketches per symbol and month, kept as a table.

A new month reads only its own ticks; figures over many months merge their sketches. Quantiles come
with a rank error and distinct counts with a relative error, both stated here; the exact operators are in
``quantiles`` and ``profile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import is_finite, month_key
from barloom.operators.bars import project_ticks
from barloom.schema import SYMBOL, TIMESTAMP

MONTH = "month"

#: Size of the quantile sketches. Their rank error is below 0.35 % in 99 of 100 cases; three times that is never met in practice.
KLL_K = 800
RANK_ERROR = 0.01
#: Log size of the distinct-count sketches, with a standard error of 0.65 %; the bound is more than four of them.
HLL_LOG_K = 14
COUNT_ERROR = 0.03


def tick_sketches(ticks: DataFrame) -> DataFrame:
    """(symbol, month, ticks, spreads, timestamps): rows, a quantile sketch of the finite spreads and one of distinct times.

    Sketches are built next to the scan and merged in the shuffle, so a month of any size sends one row per task.
    """
    quotes = project_ticks(ticks)
    finite = F.when(is_finite(F.col("spread")), F.col("spread"))
    return quotes.groupBy(SYMBOL, month_key(TIMESTAMP).alias(MONTH)).agg(
        F.count(F.lit(1)).alias("ticks"),
        F.kll_sketch_agg_double(finite, F.lit(KLL_K)).alias("spreads"),
        F.hll_sketch_agg(F.unix_micros(TIMESTAMP), F.lit(HLL_LOG_K)).alias("timestamps"),
    )


def replace_sketches(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows take the place of rows of the same symbol and month."""
    return stored.join(new.select(SYMBOL, MONTH), [SYMBOL, MONTH], "left_anti").unionByName(new)


def write_sketches(sketches: DataFrame, folder: str) -> None:
    """Month folders; only months that ``sketches`` has are replaced."""
    writer = sketches.repartition(MONTH).write.partitionBy(MONTH).mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(folder)


def merge_months(sketches: DataFrame) -> DataFrame:
    """One row per symbol over all its months."""
    return sketches.groupBy(SYMBOL).agg(
        F.sum("ticks").alias("ticks"),
        F.kll_merge_agg_double("spreads").alias("spreads"),
        F.hll_union_agg("timestamps").alias("timestamps"),
    )


def sketch_quantiles(merged: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """(symbol, quantile, n, value): a value whose rank is off by ``RANK_ERROR`` of n at most; NULL without finite spreads."""
    n = F.kll_sketch_get_n_double("spreads")
    rows = merged.select(SYMBOL, n.alias("n"), "spreads")
    value = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("spreads", F.lit(q)))
    each = [F.struct(F.lit(q).alias("quantile"), value(q).alias("value")) for q in map(float, quantiles)]
    return rows.select(SYMBOL, "n", F.inline(F.array(*each))).select(SYMBOL, "quantile", "n", "value")


def sketch_distinct(merged: DataFrame) -> DataFrame:
    """(symbol, ticks, distinct): the number of distinct times, off by ``COUNT_ERROR`` of it at most."""
    return merged.select(SYMBOL, "ticks", F.hll_sketch_estimate("timestamps").alias("distinct"))


def exact_ranks(ticks: DataFrame, estimates: DataFrame) -> DataFrame:
    """Adds to ``sketch_quantiles`` the exact shares of spreads below and up to ``value``.

    Symbols have a handful of values, so a symbol's ticks are compared with an array and only counts are shuffled.
    """
    arrays = estimates.groupBy(SYMBOL).agg(F.sort_array(F.collect_list(F.struct("quantile", "value"))).alias("_values"))
    spread = project_ticks(ticks).where(is_finite(F.col("spread"))).select(SYMBOL, "spread")
    each = spread.join(arrays, SYMBOL).select(SYMBOL, "spread", F.explode("_values").alias("v"))
    value = F.col("v.value")
    counted = each.groupBy(SYMBOL, F.col("v.quantile").alias("quantile")).agg(
        F.avg((F.col("spread") < value).cast("int")).alias("below"), F.avg((F.col("spread") <= value).cast("int")).alias("up_to")
    )
    return estimates.join(counted, [SYMBOL, "quantile"])
