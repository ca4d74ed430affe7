"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def prepare_session(spark: SparkSession) -> SparkSession:
    """Quotes are kept in UTC, so calendar functions must see a UTC session.

    Everything that reads ticks or builds bars calls this.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_PRIVATE: dict[str, str] = {}
_SCOPES: dict[str, list[str]] = {}


def _is_local(master: str) -> bool:
    """Driver and executors are one process; ``local-cluster`` is not local."""
    return master == "local" or master.startswith("local[")


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not _is_local(context.master):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
    app = context.applicationId
    return _PRIVATE.get(app) or _PRIVATE.setdefault(app, tempfile.mkdtemp(prefix="spark-"))


def workspace(spark: SparkSession) -> str:
    """Folder for intermediate tables, shared by all executors.

    The cluster names it in ``spark.checkpoint.dir`` or by ``setCheckpointDir``. Only a local
    session may do without: it gets a private folder. Anything else is an error.
    """
    app = spark.sparkContext.applicationId
    scopes = _SCOPES.setdefault(app, [uuid.uuid4().hex])
    return "/".join([_root(spark), f"barloom-{app}", *scopes])


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside are removed at the end, so use up results inside.

    Scopes may be nested; they belong to the application, not to a thread.
    """
    path = workspace(spark)
    scopes = _SCOPES[spark.sparkContext.applicationId]
    name = uuid.uuid4().hex
    scopes.append(name)
    try:
        yield f"{path}/{name}"
    finally:
        scopes.remove(name)
        _delete(spark, f"{path}/{name}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table and read it back.

    Used where a frame feeds several passes. The table cuts the lineage, is
    pruned by column on each later read, outlives lost executors, and gives
    the optimizer true sizes when it picks join strategies: a small stored table
    is broadcast because its measured size is below Spark's threshold, a large
    one is not.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_names(spark: SparkSession, pattern: str) -> list[str]:
    """Names matching a glob, in order. Lists one folder level and opens no file."""
    path, fs = _file_system(spark, pattern)
    return sorted(status.getPath().getName() for status in fs.globStatus(path) or [])


def drop_workspace(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; later ones go to a new folder."""
    app = spark.sparkContext.applicationId
    _delete(spark, f"{_root(spark)}/barloom-{app}")
    _SCOPES[app] = [uuid.uuid4().hex]


def _file_system(spark: SparkSession, name: str):
    """PySpark has no call of its own that lists or deletes files in any store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, name: str) -> None:
    path, fs = _file_system(spark, name)
    fs.delete(path, True)
