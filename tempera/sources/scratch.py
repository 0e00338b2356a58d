"""Tables that loops write and read again, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session in local mode that has none gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tempera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Written:
    """A table on its path; a lost executor costs the reading of its part. ``bytes`` is its size there."""

    def __init__(self, df: DataFrame):
        self._spark = df.sparkSession
        path = f"{shared_dir(self._spark)}/tempera/{self._spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self._path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._files = self._path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration())
        self._files.deleteOnExit(self._path)
        df.write.option("compression", "zstd").parquet(path)
        self.df = self._spark.read.schema(df.schema).parquet(path)
        self.bytes = int(self._files.getContentSummary(self._path).getLength())

    def drop(self) -> None:
        self._files.delete(self._path, True)
