import hashlib
from pathlib import Path

import pytest

from barloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string"


def parse_files(data: bytes):
    """A plain reader: header block, then as many bytes as it says."""
    records = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        size = int(fields[b"Content-Length"])
        records.append((fields, rest[:size]))
        assert rest[size : size + 4] == b"\r\n\r\n"
        data = rest[size + 4 :]
    return records


def test_round_trip_with_repeats_and_edge_cases(spark, tmp_path):
    long = "é" * 50
    rows = [
        (3, "http://c", long, "x"), (1, "http://a", long, "x"), (2, None, long, None), (4, "u\r\nX: y", None, "x"),
        (5, "http://e", "", "x"), (6, "http://f", "short", "x"), (7, "http://g", "short", "x"),
        (None, "http://h", long, "x"), (1, "http://a", long, "x"), (8, "http://i", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 2000, "x"),
    ]
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a")
    archive = warc.read_archive(spark, f"{tmp_path}/a")
    found = archive.collect()
    assert len(found) == len(rows)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 4
    texts = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in found:
        payload = texts[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())
        revisit = r.page_id in (2, 3)
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
        (fields, block), = parse_files(bytes(r.record))
        assert block.partition(b"\r\n\r\n")[2] == (b"" if revisit else payload)
        assert fields[b"WARC-Payload-Digest"].decode() == f"sha256:{r.payload_digest}"
    warc.export_files(archive, f"{tmp_path}/files", records_per_file=3)
    files = [p.read_bytes() for p in Path(f"{tmp_path}/files").glob("part-*")]
    assert sum(len(parse_files(f)) for f in files) == len(rows)


def test_damage_is_found(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([(1, "u", "x" * 200, "")], SCHEMA), f"{tmp_path}/a")
    from pyspark.sql import functions as F

    spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.lit(b"y" * 200)).write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/heads").write.parquet(f"{tmp_path}/b/heads")
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(spark, f"{tmp_path}/b").collect()


def test_empty_table(spark, tmp_path):
    warc.write_archive(spark.createDataFrame([], SCHEMA), f"{tmp_path}/a")
    assert warc.read_archive(spark, f"{tmp_path}/a").collect() == []
