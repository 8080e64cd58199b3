"""Tables and folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "gleanery") -> str:
    """A new folder under `spark.checkpoint.dir`. Where that is unset on a local master (tests) it is a
    temporary one; a cluster's executors would not share that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = Path(tempfile.mkdtemp(prefix="spark-")).as_uri()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: they are made once, whatever is lost."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
