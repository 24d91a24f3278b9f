"""Written tables in the folder that driver and executors share.

Iterative operators cut their lineage by writing a table and reading it again.
The folder is the one the session names in ``spark.checkpoint.dir``; only where
that is unset in local mode (tests, notebooks) a temporary one is made and set; on a cluster it must be.  Parquet files
there survive the loss of any executor.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Workspace:
    """A folder of intermediate tables.  Operators remove those that their result doesn't read; the rest goes when the
    Python process ends, as results are lazy."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
            spark.sparkContext.setCheckpointDir(base)
        self.spark, self.root, self.made = spark, f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}", 0
        self.paths: set[str] = set()
        atexit.register(self._clear)

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        """``df`` written and read again; the name only helps in the event log."""
        self.made += 1
        path = f"{self.root}/{self.made:03d}-{name}"
        df.write.option("compression", codec).parquet(path)
        self.paths.add(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._workspace_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        path = getattr(table, "_workspace_path", None)
        if path in self.paths:
            self._delete(path)
            self.paths.discard(path)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables but these, once everything that reads the others is written."""
        kept = {getattr(t, "_workspace_path", None) for t in tables}
        for path in self.paths - kept:
            self._delete(path)
        self.paths &= kept

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        target = sc._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)

    def _clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone by now
            self._delete(self.root)
