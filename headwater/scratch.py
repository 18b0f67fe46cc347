"""Tables written to the folder all executors share, to cut lineage.

A table written here survives the loss of any executor; a cached or locally checkpointed one does not.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. Only a local session without the setting gets one of its own; on a cluster it must be set,
    for each executor would else write to its own disk."""
    found = spark.conf.get(SHARED_DIR, None) or spark.sparkContext.getConf().get(SHARED_DIR)
    if not found:
        if not is_local(spark.sparkContext.master):
            raise RuntimeError(f"{SHARED_DIR} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="headwater-")
        spark.conf.set(SHARED_DIR, found)
    return found.rstrip("/")


def is_local(master: str) -> bool:
    """Whether a master is one process on this machine."""
    return master == "local" or master.startswith("local[")


class Scratch:
    """Intermediate tables of one operator call.

    ``save`` writes a DataFrame and returns it as read back, so the planner knows its size. ``replace`` does the same and
    removes the table it supersedes, which keeps an iteration at two tables on disk. Tables that the returned plan still
    reads stay until the application ends, and are removed with it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        own = f"{shared_dir(spark)}/headwater-{spark.sparkContext.applicationId}"
        self.root = f"{own}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        path, files = self._hadoop(own)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._count}"
        self._count += 1
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Adds rows to a table of this call; the whole table as read back."""
        path = f"{self.root}/{name}"
        df.write.mode("append").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, old: DataFrame, new: DataFrame) -> DataFrame:
        saved = self.save(new)
        self.drop(old)
        return saved

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path is None:
            return
        p, files = self._hadoop(path)
        files.delete(p, True)
        df._scratch_path = None
