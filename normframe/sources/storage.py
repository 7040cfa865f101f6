"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; Hadoop removes it when the driver's JVM ends.

    Where the setting is absent a temporary folder serves, but only in local
    mode, where driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="normframe-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/normframe/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop.getParent())
    fs.deleteOnExit(hadoop)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of its store, as Spark resolves it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, from the driver, on any store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """A small file of any store on the driver, None if it is not there. Spark's own readers leave out names that begin with a dot."""
    jvm = spark.sparkContext._jvm
    name = jvm.org.apache.hadoop.fs.Path(path)
    fs = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(name):
        return None
    stream = fs.open(name)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that is no longer read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


class Buckets:
    """A table on the shared folder in buckets of a key: joins of two such tables by that key shuffle neither.

    ``dealt``: the rows come from such a join, and are in their buckets already.
    """

    def __init__(self, df: DataFrame, key: str, buckets: int, dealt: bool = False):
        self.spark, self.name = df.sparkSession, f"normframe_{uuid.uuid4().hex}"
        self.path = shared_path(self.spark, "buckets")
        rows = df if dealt else df.repartition(buckets, key)
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", self.path).format("parquet").saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def with_columns(self, **columns: Column) -> Buckets:
        """The same stored table, seen with other columns."""
        out = object.__new__(Buckets)
        out.__dict__ |= self.__dict__ | {"df": self.df.withColumns(columns)}
        return out

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)
