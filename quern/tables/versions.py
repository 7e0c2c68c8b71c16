"""Tables as immutable versions with a current-version pointer.

A commit writes a new version beside the old ones and then creates the next pointer file, which fails
if another writer was first. Readers keep the version they opened.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another writer committed first."""


class VersionedTable:
    """A directory of versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the current version, 0 for none."""
        if not self._fs.exists(self._root):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return max((int(n.split(".")[0]) for n in names if n.split(".")[0].isdigit()), default=0)

    def exists(self) -> bool:
        return self.version() > 0

    def _data(self, version: int) -> str:
        stream = self._fs.open(self._jvm.org.apache.hadoop.fs.Path(f"{self._root}/{version:012d}.ref"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, the current one by default."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError(f"there is no table at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{self._data(version)}")

    def commit(self, frame: DataFrame, expected: int | None = None, partition_by: tuple[str, ...] = ()) -> int:
        """Write the next version; fails if the current one is no longer ``expected``."""
        base = self.version() if expected is None else expected
        name = f"data-{uuid.uuid4().hex}"
        writer = frame.write.partitionBy(*partition_by) if partition_by else frame.write
        writer.parquet(f"{self.path}/{name}")
        path = self._jvm.org.apache.hadoop.fs.Path
        pointer, made = path(f"{self._root}/{base + 1:012d}.ref"), path(f"{self._root}/{name}.new")
        out = self._fs.create(made, False)
        out.write(bytearray(name.encode()))
        out.close()
        # a whole pointer takes its place at once, and not over an existing one: the first committer wins
        if self._fs.exists(pointer) or not self._fs.rename(made, pointer):
            self._fs.delete(made, False)
            self._fs.delete(path(f"{self.path}/{name}"), True)
            raise Conflict(f"version {base + 1} of {self.path} exists")
        return base + 1

    def drop(self) -> None:
        """Remove all versions."""
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(self.path), True)
