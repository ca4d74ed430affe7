"""Joins of intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions that share a bin.
BIN_WIDTH = 256


def _bin(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width))


def overlap_join(
    left: DataFrame, right: DataFrame, by: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = BIN_WIDTH
) -> DataFrame:
    """Pairs of rows of equal ``by`` whose spans, ends included, share a position; each pair once.

    Spans are cut into bins of ``width`` positions and meet by an equi-join on ``by`` and the bin, so a key with
    many rows is spread over its bins and no row meets the spans of other places. A pair that shares several bins is taken in
    the first of them. Rows with a NULL key or end, and spans that end before they begin, pair with nothing. Apart from
    ``by`` the two sides' columns have different names. A span makes a row per bin: ``width`` should not be far below the longer side's usual span.
    """
    clash = (set(left.columns) & set(right.columns)) - set(by)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    (a, b), (c, d) = ((F.col(x), F.col(y)) for x, y in (left_span, right_span))

    def binned(df: DataFrame, first: Column, last: Column) -> DataFrame:
        places = F.sequence(_bin(first, width), _bin(last, width))
        return df.where(first <= last).withColumn("_bin", F.explode(places))

    pairs = binned(left, a, b).join(binned(right, c, d), [*by, "_bin"])
    shared = (a <= d) & (c <= b) & (F.col("_bin") == _bin(F.greatest(a, c), width))
    return pairs.where(shared).drop("_bin")
