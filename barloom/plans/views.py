"""Tick views over the analytics tables.

The tables hold no quotes. ``events`` becomes a quote stream with one symbol per
event type; ``orders`` and ``lineitem`` give long daily series with many equal
timestamps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import prepare_session


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str, single_series: bool = False) -> DataFrame:
    events = table(spark, sf_dir, "events")
    bid = F.lit(100.0) + F.col("value") / 1000
    step = 1 + F.get_json_object("props", "$.k").cast("int") % 5
    symbol = F.lit("ALL") if single_series else F.col("event_type")
    return events.select(
        symbol.alias("symbol"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("event_id").alias("seq"),
        (bid + F.lit(0.01) * step).alias("ask"),
        bid.alias("bid"),
        (1 + F.col("user_id") % 10).cast("double").alias("ask_volume"),
        (1 + F.col("event_id") % 7).cast("double").alias("bid_volume"),
    )


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as prices: daily dates, so most ticks share their timestamp."""
    price = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("symbol"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_orderkey").alias("seq"),
        (price + 0.5).alias("ask"),
        (price - 0.5).alias("bid"),
        F.lit(1.0).alias("ask_volume"),
        (1 + F.col("o_custkey") % 5).cast("double").alias("bid_volume"),
    )


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        (price * (1 + F.col("l_tax"))).alias("ask"),
        (price * (1 - F.col("l_discount"))).alias("bid"),
        F.col("l_quantity").alias("ask_volume"),
        F.col("l_quantity").alias("bid_volume"),
    )


def vendor_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event quotes under the vendor's column names, with wall-clock times."""
    ticks = event_ticks(spark, sf_dir)
    names = {"ask": "askPrice", "bid": "bidPrice", "ask_volume": "askVolume", "bid_volume": "bidVolume"}
    return ticks.withColumnsRenamed(names).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp_ntz")
    )
