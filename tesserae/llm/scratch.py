"""Intermediate tables in the folder that the driver and all executors share.

A stage that is written here and read again starts a new lineage: a lost executor costs at most the work of one
stage. The folder is spark.checkpoint.dir of the session; where that is unset, a temporary one is made for a local master, and
on a cluster, whose executors would each write to their own disk, it is an error.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tesserae-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """The session may be gone by now: a folder of this machine is then deleted without it, and another is the cluster's to clean."""
    try:
        _delete(spark, path)
    except Exception:
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


_lock, _users = threading.Lock(), [0, None]


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """The shuffle files of what runs inside are deleted as soon as it has run. The setting is put back when the last thread leaves."""
    with _lock:
        if not _users[0]:
            _users[1] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _users[0] += 1
    try:
        yield
    finally:
        with _lock:
            _users[0] -= 1
            if not _users[0]:
                if _users[1] is None:
                    spark.conf.unset(CLEANUP)
                else:
                    spark.conf.set(CLEANUP, _users[1])


class Scratch:
    """A folder for one run of one operator; removed when the driver ends."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete_at_exit, spark, self.path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as a table of this folder and reads it again."""
        at = f"{self.path}/{name}"
        with _shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").mode("overwrite").parquet(at)
        gc.collect()
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")
