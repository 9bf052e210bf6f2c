"""Written intermediate tables.

Lineage is cut by writing a table to the folder that the cluster names in
``spark.checkpoint.dir``: executors can be lost at any time afterwards and
nothing has to be computed again.  Where the setting is absent the session's
warehouse is used, which all executors share too; only a session whose master
is one local process gets a temporary folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Tables after whose writing the driver is tidied, and how many were written since.
TIDY_EVERY = 6
#: Bytes of a batch that goes to Python, where the session does not say.
BATCH_BYTES, _BATCH = "8m", "spark.sql.execution.arrow.maxBytesPerBatch"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and (master == "local" or master.startswith("local[")):
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        named = _OWN[app]
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of the shared one that nothing else has."""
    return f"{shared_dir(spark)}/citeloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    if len(_written) % TIDY_EVERY == 0:
        tidy(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bounded_batches(spark: SparkSession) -> None:
    """Let batches for Python end at BATCH_BYTES, unless the session has a limit of its own: by records alone, and by the 64 MB that
    Spark allows, a batch of long texts and what is made of it take a worker's memory several times over."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def tidy(spark: SparkSession) -> None:
    """Collect garbage in the driver.

    Spark drops shuffle files, broadcasts and their buffers when the driver's
    handles of them are collected; left to itself a driver with room in its heap
    waits up to half an hour, and jobs of many small steps pile them up.
    """
    spark._jvm.System.gc()


def release(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing will read any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def only(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` written as one table; whatever else was written for it is deleted then."""
    before = len(_written)
    out = written(make(), name)
    for path in _written[before:]:
        if path != out._written_at:
            _delete(out.sparkSession, path)
    return out
