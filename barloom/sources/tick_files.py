"""Reading tick archives.

An archive is a folder with ``month=YYYY-MM`` partitions as ``write_ticks``
lays them out, or a folder of flat ``YYYY-MM.parquet`` files of one symbol.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.schema import SYMBOL, TICK_SCHEMA, TIMESTAMP, require_columns
from barloom.session import file_names, prepare_session
from barloom.sources.text_files import parse_json

# --- fixed values: vendor column names and the archive's column order --------
VENDOR_COLUMNS = {
    "askPrice": "ask",
    "bidPrice": "bid",
    "askVolume": "ask_volume",
    "bidVolume": "bid_volume",
}
TICK_COLUMNS = ("timestamp", "ask", "bid", "ask_volume", "bid_volume")

LEDGER_SCHEMA = "symbol string, month string, rows bigint, missing_hours bigint, confirmed_absent bigint"


def list_months(spark: SparkSession, folder: str) -> list[str]:
    """Month folders, or else flat parquet files, in name order."""
    return file_names(spark, f"{folder}/month=*") or file_names(spark, f"{folder}/*.parquet")


def month_range_label(names: list[str]) -> str:
    """``first -> last`` of the month names in use."""
    first, last = (n.removeprefix("month=").removesuffix(".parquet") for n in (names[0], names[-1]))
    return f"{first} -> {last}"


def clean_symbol(name: str) -> str:
    """A symbol as archives spell it: upper case, without the slash of a pair."""
    return name.replace("/", "").upper()


def read_ticks(
    spark: SparkSession,
    folder: str,
    months: int | None = None,
    skip_corrupt: bool = False,
    symbol: str | None = None,
) -> DataFrame:
    """Ticks of the latest ``months`` months (all if None), as a lazy scan.

    Flat files hold one instrument and need its ``symbol``; their ticks are
    numbered by their row in the file, which orders ticks of equal time. A partitioned archive names its
    symbols itself; a ``symbol`` given keeps that one. With ``skip_corrupt``, files that cannot
    be read count as missing.
    """
    prepare_session(spark)
    names = list_months(spark, folder)
    if not names:
        raise FileNotFoundError(f"the archive {folder} holds no month")
    if months is not None:
        names = names[-months:]
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower())
    partitioned = names[0].startswith("month=")
    columns = [f for f in TICK_SCHEMA.fields if partitioned or f.name in TICK_COLUMNS]
    schema = T.StructType(columns)
    if not partitioned:
        if symbol is None:
            raise ValueError("flat month files do not name their instrument: pass symbol=")
        ticks = reader.schema(schema).parquet(*[f"{folder}/{n}" for n in names])
        return ticks.select(
            F.lit(clean_symbol(symbol)).alias(SYMBOL), F.col("_metadata.row_index").alias("seq"), *TICK_COLUMNS
        )
    ticks = reader.schema(schema.add("month", "string")).option("basePath", folder)
    first, last = (n.removeprefix("month=") for n in (names[0], names[-1]))
    ticks = ticks.parquet(folder).where(F.col("month").between(first, last))
    return ticks if symbol is None else ticks.where(F.col(SYMBOL) == clean_symbol(symbol))


def month_files(spark: SparkSession, folder: str) -> DataFrame:
    """(month, file) of every file in the ``month=YYYY-MM`` folders; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/month=*")
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, r"/month=([^/]+)/", 1).alias("month"), path.alias("file"))


def unreadable_files(spark: SparkSession, folder: str) -> DataFrame:
    """(month, file) of the files of a partitioned archive of which a tolerant scan gives no row.

    These are files that cannot be read as parquet, and files without a row. The scan reads footers and the time column.
    """
    ticks = read_ticks(spark, folder, skip_corrupt=True)
    read = ticks.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.max(TIMESTAMP).alias("latest"))
    return month_files(spark, folder).join(read, "file", "left_anti").select("month", "file")


def unreadable_months(spark: SparkSession, folder: str) -> DataFrame:
    """The months with a file that cannot be read, to be loaded again."""
    return unreadable_files(spark, folder).select("month").distinct()


def latest_months(df: DataFrame, months: int | None, month: str = "month") -> DataFrame:
    """Rows of the latest ``months`` distinct months of a table without month folders."""
    if months is None:
        return df
    latest = df.select(month).distinct().orderBy(F.desc(month)).limit(months)
    return df.join(latest, month, "left_semi")


def ensure_utc_timestamp(df: DataFrame, column: str = TIMESTAMP) -> DataFrame:
    """Cast to a timestamp; the session zone is UTC, so wall-clock times are UTC."""
    if df.schema[column].dataType == T.TimestampType():
        return df
    return df.withColumn(column, F.col(column).cast("timestamp"))


def normalize_ticks(df: DataFrame) -> DataFrame:
    """Vendor names to archive names, archive column order, UTC timestamps."""
    renamed = df.withColumnsRenamed(VENDOR_COLUMNS)
    carried = [c for c in (SYMBOL, "seq") if c in renamed.columns]
    return ensure_utc_timestamp(require_columns(renamed).select(*carried, *TICK_COLUMNS))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The month ledger; absent or broken entries read as no entry."""
    if not file_names(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return parse_json(spark.read.text(path), LEDGER_SCHEMA).where("_corrupt is null and month is not null").drop("_corrupt")


def broken_entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry): what ``read_ledger`` leaves out: broken lines as they stand, entries without a month as parsed."""
    rows = parse_json(spark.read.text(path), LEDGER_SCHEMA).where("_corrupt is not null or month is null")
    entry = F.to_json(F.struct(*[c for c in rows.columns if c != "_corrupt"]))
    return rows.select(F.coalesce("_corrupt", entry).alias("entry"))
