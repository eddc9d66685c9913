"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which driver and executors share.

    Where the session names none, a fresh local folder is set on one machine (tests); on a cluster that is an error, as
    executors would write to disks of their own.
    """
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-"))
    return jsc.getCheckpointDir().get().rstrip("/")


class Scratch:
    """Intermediate tables as Parquet below the shared folder.

    A table that is written and read again has no lineage left, so a lost executor costs only its own tasks.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/vellum-{tag}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _files(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self, name: str) -> None:
        path, files = self._files(name)
        files.delete(path, True)

    def keep(self, *names: str) -> None:
        """Removes all tables but the named ones."""
        path, files = self._files()
        for found in files.listStatus(path):
            if found.getPath().getName() not in names:
                files.delete(found.getPath(), True)

    def close(self) -> None:
        """Removes all tables: nothing that reads them may run afterwards."""
        path, files = self._files()
        files.delete(path, True)
