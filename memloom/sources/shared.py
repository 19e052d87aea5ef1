"""Lineage cuts on storage that every executor can read.

``materialize`` writes a frame as Parquet below the folder the cluster names in
``spark.checkpoint.dir`` and reads it back.  Losing an executor then costs a
re-read, never a recomputation of the whole loop.  Only where no folder is
configured (unit tests, a laptop session) one is made under the temp directory.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, object] = {}  # path of each table written, with the file system it is on


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="memloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` below the shared folder and return a frame that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memloom/{label}-{uuid.uuid4().hex}"
    _remember(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remember(spark: SparkSession, path: str) -> None:
    if not _WRITTEN:
        atexit.register(_forget)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _WRITTEN[path] = where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _forget() -> None:
    """Deletes, when the driver ends, what no step has deleted before: nothing can read it any more."""
    for where, fs in _WRITTEN.values():
        try:
            fs.delete(where, True)
        except Exception:  # the JVM is gone or the folder is: there is nothing left to do
            break
    _WRITTEN.clear()


def drop_materialized(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame made by ``materialize`` once nothing reads it."""
    jvm = spark.sparkContext._jvm
    for name in df.inputFiles()[:1]:
        parent = jvm.org.apache.hadoop.fs.Path(name).getParent()
        if "/memloom/" in parent.toString():
            fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(parent, True)
            for path in [p for p in _WRITTEN if p.endswith("/" + parent.getName())]:
                del _WRITTEN[path]
