"""Column contracts of the frames that operators exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOL = "symbol"
TIMESTAMP = "timestamp"
BAR_START = "bar_start"
IDX = "idx"
SERIES_LEN = "series_len"

TICK_SCHEMA = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ask", T.DoubleType()),
        T.StructField("bid", T.DoubleType()),
        T.StructField("ask_volume", T.DoubleType()),
        T.StructField("bid_volume", T.DoubleType()),
    ]
)

REQUIRED_TICK_COLUMNS = ("timestamp", "ask", "bid", "ask_volume", "bid_volume")


def require_columns(df: DataFrame, columns: tuple[str, ...] = REQUIRED_TICK_COLUMNS) -> DataFrame:
    """Return ``df`` unchanged, or raise when a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, whether ticks need it, rows and NULLs.

    The counts come from one aggregate; its single row is turned into one row
    per column.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_nulls_{i}") for i, c in enumerate(df.columns)],
    )
    lines = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.lit(f.name in REQUIRED_TICK_COLUMNS).alias("required"),
            F.col("_rows").alias("rows"),
            F.col(f"_nulls_{i}").alias("nulls"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*lines)))
