"""CSV and JSON that give back what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"
#: What an empty text is read as, to tell it from an absent one; texts do not hold this character alone.
_EMPTY = "\u0000"
#: How tables are written. Quotes are doubled and blanks kept; times have microseconds and their zone.
CSV_FORMAT = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_csv(spark: SparkSession, folder: str, schema: str | T.StructType, multi_line: bool = False) -> DataFrame:
    """A table that ``write_csv`` wrote, with NULL, empty texts, NaN, infinities and times as they were.

    Rows that do not fit the schema are an error. Texts with line breaks need ``multi_line``, by which a file is read in one task.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    reader = spark.read.schema(schema).options(**CSV_FORMAT, emptyValue=_EMPTY, mode="FAILFAST", multiLine=str(multi_line).lower())
    columns = [_text(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields]
    return reader.csv(folder).select(*columns)


def _text(name: str) -> Column:
    return F.when(F.col(name) == _EMPTY, "").otherwise(F.col(name)).alias(name)


def parse_json(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The fields of a column of JSON documents and ``_corrupt``, the text of a document that does not parse or fit.

    Absent fields are NULL and blank lines are left out.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(column, f"{schema}, {CORRUPT} string", options)
    return lines.where(F.trim(column) != "").select(parsed.alias("_document")).select("_document.*")


def read_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Nested documents that ``write_json`` wrote, one per line, and ``_corrupt``."""
    return parse_json(spark.read.text(folder), schema)
