"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import arrays
from gleanery.sources import package

#: Bytes of an Arrow batch: 10,000 whole documents would be much for a worker.
BATCH_BYTES = 4 << 20
#: Whether Spark deletes a query's shuffle files when it has ended.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, and bound the bytes of Arrow batches where nothing does."""
    package.ship_package(spark)
    if int(spark.conf.get(_BATCH, str(2**31 - 1))) >= 2**31 - 1:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under `spark.checkpoint.dir`. Where that is unset on a local master (tests), a
    temporary folder is set for it once; a cluster's executors would not share one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = Path(tempfile.mkdtemp(prefix="spark-")).as_uri()
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/gleanery-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there, and a lost
    executor costs nothing that was finished."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # what the job shuffled is not needed again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what `materialise` wrote for a table that nothing will read again."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, and so on: what is added beside them can't clash with their names."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def release_memory() -> None:
    """Give what a task freed back to the system: its worker waits for tasks of other stages, which
    would have the room it held beside them."""
    arrays.forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def finish(df: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The rows written to the shared folder, after which the tables they were made of go."""
    out = materialise(df)
    for table in tables:
        discard(table)
    return out
