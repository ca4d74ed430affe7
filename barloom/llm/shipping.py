"""Sends this package to the Python workers and keeps their batches small."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows of one Arrow batch: whole texts and sets are long.
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000
BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20

_shipped: set[str] = set()


def _bytes(value: str | None) -> int:
    """A plain number of bytes; 0 for anything else."""
    return int(value) if value and value.isdigit() else 0


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the application's Python files, once. Workers import it from there."""
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    if not 0 < _bytes(spark.conf.get(BYTES_CONF, None)) <= BATCH_BYTES:
        spark.conf.set(BYTES_CONF, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="spark-")), f"{package.name}.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark
