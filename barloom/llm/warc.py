"""A content-addressed web archive.

An archive is two tables. ``payloads`` holds each payload's bytes once, under their
SHA-256. ``heads`` holds, for every record, the exact bytes that stand before the
payload (WARC and HTTP header blocks) and the digest. Records come back by joining
the two; every payload that is read is hashed again, and a record whose payload does
not match the digest, length and second checksum it was stored with is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: the archive format ------------------------------------------
VERSION = "WARC/1.1"
CRLF = "\r\n"
RECORD_END = CRLF + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_STATUS = "HTTP/1.1 200 OK"
HTTP_TYPE = "text/html; charset=utf-8"

REVISIT_FROM_BYTES = 100
DEFAULT_DATE = "1970-01-01T00:00:00Z"
_URN = "urn:page:"


def _field(name: str, value: Column) -> Column:
    """A header line; nothing for a null value. Line breaks in values are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(page_id.cast("string"), F.lit("unknown")), F.lit(">"))


def _head(date: str) -> Column:
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(HTTP_STATUS + CRLF),
        _field("Content-Type", F.lit(HTTP_TYPE)),
        _field("Content-Length", F.col("payload_bytes")),
        F.lit(CRLF),
    )
    block_bytes = F.octet_length(http) + F.when(is_revisit, 0).otherwise(F.col("payload_bytes"))
    warc = F.concat(
        F.lit(VERSION + CRLF),
        _field("WARC-Type", F.col("record_type")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _field("WARC-Refers-To", F.when(is_revisit, _urn(F.col("first_id")))),
        _field("WARC-Profile", F.when(is_revisit, F.lit(REVISIT_PROFILE))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block_bytes),
        F.lit(CRLF),
    )
    return F.encode(F.concat(warc, http), "UTF-8")


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = DEFAULT_DATE,
) -> None:
    """Write one record per row under ``path``.

    The payload is the column's UTF-8 (or its bytes, if it is binary); a null one is
    empty. Of rows with equal payloads of at least ``REVISIT_FROM_BYTES`` bytes the
    one with the smallest id is a response and the others revisit it; rows that tie on
    the smallest id, and rows without an id, are responses too. Smaller payloads are always
    responses, but their bytes are stored once all the same. An empty table gives an
    empty archive. Other columns are ignored.
    """
    content = F.col(payload_col)
    if dict(pages.dtypes)[payload_col] != "binary":
        content = F.encode(content, "UTF-8")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(content, F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    (
        rows.groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.first("payload").alias("payload"))
        .withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
        .write.parquet(f"{path}/payloads")
    )
    stored = pages.sparkSession.read.parquet(f"{path}/payloads").select("digest", "first_id")
    checks = rows.select(
        "page_id",
        "url",
        "digest",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.xxhash64("payload").alias("checksum"),
    )
    large = F.col("payload_bytes") >= REVISIT_FROM_BYTES
    revisit = F.coalesce(large & (F.col("page_id") > F.col("first_id")), F.lit(False))
    (
        checks.join(stored, "digest")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .select("digest", "payload_bytes", "checksum", _head(date).alias("head"))
        .write.parquet(f"{path}/heads")
    )


def _header(block: Column, name: str) -> Column:
    found = F.regexp_extract(block, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _page_of(urn: Column) -> Column:
    return F.regexp_extract(urn, rf"<{_URN}(-?\d+)>", 1).try_cast("bigint")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt from the archive, as (record, payload) and what their headers say.

    ``record`` is the exact record: header blocks, payload unless it is a revisit, and the
    closing line ends. ``payload`` is the payload it has or refers to.
    """
    heads = spark.read.parquet(f"{path}/heads")
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    joined = heads.join(payloads, "digest", "left")
    sound = (
        (F.sha2("payload", 256) == F.col("digest"))
        & (F.octet_length("payload") == F.col("payload_bytes"))
        & (F.xxhash64("payload") == F.col("checksum"))
    )
    checked = joined.withColumn(
        "payload",
        F.when(F.coalesce(sound, F.lit(False)), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("archive payload is damaged: "), F.col("digest"))).cast("binary")
        ),
    )
    is_revisit = F.contains(F.col("head").cast("string"), F.lit(f"{CRLF}WARC-Type: revisit{CRLF}"))
    body = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    records = checked.select(
        F.concat("head", body, F.lit(RECORD_END.encode())).alias("record"), "payload"
    )
    return parse_records(records)


def parse_records(records: DataFrame) -> DataFrame:
    """Adds the named header values and the block of each ``record``."""
    block = F.substring_index(F.col("record").cast("string"), RECORD_END, 1)
    digest = _header(block, "WARC-Payload-Digest")
    return records.select(
        _page_of(_header(block, "WARC-Record-ID")).alias("page_id"),
        _header(block, "WARC-Type").alias("record_type"),
        _header(block, "WARC-Target-URI").alias("target_uri"),
        F.regexp_extract(digest, "^sha256:([0-9a-f]{64})$", 1).alias("payload_digest"),
        _page_of(_header(block, "WARC-Refers-To")).alias("refers_to"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        "payload",
        "record",
    )


def export_files(archive: DataFrame, path: str, records_per_file: int = 10_000) -> None:
    """Write rebuilt records as plain WARC files, whatever store ``path`` is in."""
    text = F.col("record").substr(F.lit(1), F.octet_length("record") - len(RECORD_END)).cast("string")
    (
        archive.select(text.alias("value"))
        .write.option("lineSep", RECORD_END)
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )
