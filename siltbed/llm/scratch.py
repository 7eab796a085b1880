"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. Where it is unset and the session is local, as in tests, a
temporary folder is set; on a cluster an unset folder is an error, since a machine's own folder would be lost with it.
Tables live under a name of their own for each call and are dropped when a later step has replaced them, or at exit.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a slash at the end."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if (current := spark.sparkContext.getCheckpointDir()) is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def collect_garbage(spark: SparkSession) -> None:
    """Have Spark drop shuffle files that no plan refers to; it does so only as the driver collects its garbage.

    The scheduler holds on to the job that ran last, so a job of no rows takes its place first.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Materialise ``df``: what follows reads the table, however often and whatever executors are lost."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def bytes(self, name: str) -> int:
        path, fs = self._fs(f"{self.root}/{name}")
        return fs.getContentSummary(path).getLength()

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone at exit
            pass

    def _fs(self, where: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, where: str) -> None:
        path, fs = self._fs(where)
        fs.delete(path, True)
