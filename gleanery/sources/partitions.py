"""Tables whose partitions are replaced as a whole.

A partition's rows are in a folder of their own version. A small file names the version that counts;
writing a partition makes a new folder and then replaces that file by one rename, which a file system
does at once or not at all. So a job that dies at any point leaves the old rows or the new ones, and
other partitions keep their files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.sources.shared import written


class PartitionTable:
    """A table at `path` with the columns of `schema`, partitioned by `column` (text that can be a file
    name). One writer at a time; readers need no care. The driver lists one name a partition."""

    def __init__(self, spark: SparkSession, path: str, schema: str, column: str):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column
        self.schema = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField(column, T.StringType())])
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path, self._rename = hadoop.Path, hadoop.Options.Rename
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.FileContext.getFileContext(self._path(self.path).toUri(), spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/current"))

    def versions(self) -> dict[str, str]:
        """The version of each partition that counts."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/current"))]
        out = {}
        for name in names:
            if not name.startswith("."):
                stream = self._fs.open(self._path(f"{self.path}/current/{name}"))
                out[name] = stream.readUTF()
                stream.close()
        return out

    def stage(self, rows: DataFrame, partition: str) -> str:
        """Write the rows of a partition's next version, which nobody reads yet; its name."""
        version = uuid.uuid4().hex
        rows.select(self.schema.names[:-1]).write.parquet(f"{self.path}/data/{self.column}={partition}/version={version}")
        return version

    def publish(self, partition: str, version: str) -> None:
        """Let a version count from now on."""
        note = self._path(f"{self.path}/current/.{version}")
        stream = self._fs.create(note)
        stream.writeUTF(version)
        stream.close()
        how = self.spark.sparkContext._gateway.new_array(self._rename, 1)
        how[0] = self._rename.OVERWRITE
        self._context.rename(note, self._path(f"{self.path}/current/{partition}"), how)

    def load(self, rows: DataFrame) -> None:
        """Write all partitions of the rows in one job, then let them count."""
        version = uuid.uuid4().hex
        named = rows.select(self.schema.names).withColumn("version", F.lit(version))
        named.repartition(self.column).write.mode("append").partitionBy(self.column, "version").parquet(f"{self.path}/data")
        for status in self._fs.listStatus(self._path(f"{self.path}/data")):
            folder = status.getPath().getName()
            if "=" in folder and self._fs.exists(self._path(f"{self.path}/data/{folder}/version={version}")):
                self.publish(folder.split("=", 1)[1], version)

    def replace(self, rows: DataFrame, partition: str) -> None:
        self.publish(partition, self.stage(rows, partition))

    def replace_keys(self, rows: DataFrame, partition: str, *keys: str) -> None:
        """Replace a partition's rows of the keys that `rows` has; other keys keep theirs."""
        new = written(rows.select(self.schema.names[:-1]))
        old = self.read([partition]).select(new.columns).join(new.select(*keys).distinct(), list(keys), "left_anti").select(new.columns)
        self.replace(old.unionByName(new), partition)

    def drop(self, partition: str) -> None:
        self._fs.delete(self._path(f"{self.path}/current/{partition}"), False)

    def read(self, partitions: list[str] | None = None) -> DataFrame:
        """The rows that count, of all partitions or of some."""
        known = self.versions()
        folders = [f"{self.path}/data/{self.column}={p}/version={v}" for p, v in sorted(known.items()) if partitions is None or p in partitions]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.option("basePath", f"{self.path}/data").schema(self.schema).parquet(*folders)

    def sweep(self) -> None:
        """Delete versions that do not count. Not while others read or write."""
        known = self.versions()
        for status in self._fs.listStatus(self._path(f"{self.path}/data")):
            partition = status.getPath().getName().split("=", 1)[-1]
            for version in self._fs.listStatus(status.getPath()):
                if version.getPath().getName() != f"version={known.get(partition)}":
                    self._fs.delete(version.getPath(), True)
