"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it is at most this many bytes, by its counted rows.
BROADCAST_BYTES = 16 << 20
#: Of an Arrow batch on its way to a Python worker. It is in memory several times there and in the executor, whose
#: buffers double as they grow, so batches of long texts at Spark's default of 64 MB take gigabytes.
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a session in local mode (one process) may leave it unset; it then gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tempera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/tempera/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage with a
    copy that outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    root = shared_dir(spark)
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if name.split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are at most ``BATCH_BYTES`` from here on, unless the session sets another bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, spark.conf.get(key, str(BATCH_BYTES)))


#: How to empty what operators keep in a worker from task to task; a worker that turns to another operator does so.
CACHES: list[Callable[[], None]] = []
_working_for: list[str] = [""]


def released(operator: str | None = None) -> None:
    """Give memory that a worker no longer uses back to the system. Workers live on, and what one operator left in
    them would stand beside the next one's; of another operator also the caches go."""
    if operator and operator != _working_for[0]:
        _working_for[0] = operator
        for empty in CACHES:
            empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def mapped(df: DataFrame, function: Callable, schema) -> DataFrame:
    """``mapInArrow`` over bounded batches; a task begins and ends with ``released``."""
    bounded_batches(df.sparkSession)
    operator = f"{function.__module__}.{function.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released(operator)
        yield from function(batches)
        released()

    return df.mapInArrow(run, schema)


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a written table of rows of about ``row_bytes`` may be broadcast."""
    return df.count() * row_bytes <= limit


def joined(big: DataFrame, side: DataFrame, on: str | list[str], how: str, row_bytes: int) -> DataFrame:
    """Join with ``side`` (a written table): broadcast if its counted size permits, else shuffled."""
    return big.join(F.broadcast(side) if small_enough(side, row_bytes) else side, on, how)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
