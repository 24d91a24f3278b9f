"""Versioned snapshots of a table: each state is a folder, a pointer names the current one.

Parquet has no MERGE or DELETE.  A state is read lazily, so its folder is never overwritten: the next one
is written beside it and then the pointer is renamed into place.  One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str, partition_by: str | None = "user_id"):
        self.spark, self.root, self.partition_by = spark, root.rstrip("/"), partition_by
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        """Numbers of the states that the pointer has named, in order."""
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n[len("current-") :]) for n in names if n.startswith("current-"))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The current state, or an earlier one; None if there is none."""
        have = self.versions()
        if not have or (version is not None and version not in have):
            return None
        return self.spark.read.parquet(f"{self.root}/v{version or have[-1]}")

    def write(self, state: DataFrame) -> int:
        """The new current version."""
        version = (self.versions() or [0])[-1] + 1
        writer = state.write.mode("overwrite")
        if self.partition_by and self.partition_by in state.columns:
            writer = writer.partitionBy(self.partition_by)
        writer.parquet(f"{self.root}/v{version}")
        self._fs.create(self._path(f".pointer-{version}"), True).close()
        self._fs.rename(self._path(f".pointer-{version}"), self._path(f"current-{version}"))
        return version
