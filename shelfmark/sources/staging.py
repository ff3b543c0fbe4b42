"""Intermediate tables, and small files that change in one step, in folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or a temporary one where that is unset and all is on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shelfmark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: used more than once, computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Folder:
    """A folder of any Hadoop file system, seen from the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._hadoop = self._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self.path("")
        self._fs = at.getFileSystem(conf)
        self._context = self._hadoop.FileContext.getFileContext(self._fs.makeQualified(at).toUri(), conf)

    def path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def files(self, name: str = "") -> dict[str, int]:
        """Names and lengths of what lies directly in a folder; none if it isn't there."""
        at = self.path(name)
        return {x.getPath().getName(): x.getLen() for x in self._fs.listStatus(at)} if self._fs.exists(at) else {}

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Put a new file in place in one step; False if there is one of that name."""
        new = f".{name}-{uuid.uuid4().hex}"
        out = self._fs.create(self.path(new), True)
        out.write(bytearray(data))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            self._context.rename(self.path(new), self.path(name), none)
            return True
        except Exception as e:
            self._fs.delete(self.path(new), False)
            if self.exists(name):
                return False
            raise e

    def move(self, name: str, to: str) -> None:
        if self.exists(to):
            self._fs.delete(self.path(to), True)
        self._fs.rename(self.path(name), self.path(to))

    def remove(self, name: str) -> None:
        self._fs.delete(self.path(name), True)
