"""Partition folders of a table."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folders:
    """Partition folders of a table, by whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.child = jvm.org.apache.hadoop.fs.Path

    def names(self) -> list[str]:
        if not self.files.exists(self.path):
            return []
        return [s.getPath().getName() for s in self.files.listStatus(self.path) if s.isDirectory()]

    def delete(self, name: str = "") -> None:
        """Deletes one of them, or the table itself."""
        self.files.delete(self.child(self.path, name) if name else self.path, True)
