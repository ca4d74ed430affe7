"""Writing ticks, tables and run documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import month_key
from barloom.schema import SYMBOL, TIMESTAMP
from barloom.session import materialize
from barloom.sources.text_files import CSV_FORMAT


def write_ticks(ticks: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """Write ``month=YYYY-MM`` partitions, sorted by symbol and time.

    Range partitioning splits a large symbol-month over several tasks by time,
    where hashing on the month would put it into one, and gives each file a
    narrow time range for later file skipping. Only the months present in
    ``ticks`` are replaced.
    """
    keyed = ticks.withColumn("month", month_key(TIMESTAMP))
    order = [c for c in ("month", SYMBOL, TIMESTAMP, "seq") if c in keyed.columns]
    (
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("month")
        .parquet(folder)
    )


def replace_months(ticks: DataFrame, folder: str) -> None:
    """Overwrite just the months in ``ticks``, which may be read from the same folder."""
    write_ticks(materialize(ticks, "replaced-months"), folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header, one part per partition; ``read_csv`` gives the same values back.

    Quotes are doubled, NULL is an empty field and an empty text two quotes, times have microseconds and their zone.
    """
    df.write.mode("overwrite").options(**CSV_FORMAT).csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    """JSON lines; struct, map and array columns become nested documents."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def as_json(df: DataFrame, column: str = "document") -> DataFrame:
    """Each row as one JSON text column."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))
