"""Tables in the folder that driver and executors share (``spark.checkpoint.dir``).

Operators that read an intermediate result more than once write it here as Parquet: that cuts lineage, survives the
loss of executors and needs no cache. Everything but the tables asked to stay is deleted on leaving the block.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder of our own only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="twinsight-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """``with Scratch(spark) as s: t = s.table(df)``. Tables made with ``keep=True`` outlive the block."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def table(self, df: DataFrame, keep: bool = False, tidy: bool = False, into: str | None = None) -> DataFrame:
        """Writes ``df`` once and reads it back with its own schema (no inference job).

        ``into`` names a table that several calls fill; what comes back is all that it has by then.
        ``tidy`` first lets Spark's cleaner see that earlier steps are over, so their shuffle files go before this
        step makes its own.
        """
        if tidy:
            self.tidy()
        path = f"{self.root}/{into or uuid.uuid4().hex}"
        if not keep:
            self.paths.append(path)
        df.write.mode("append" if into else "error").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Lets Spark's cleaner find what no DataFrame refers to any more.

        Twice, with a pause: the event of a query's end refers to its plan until all listeners have seen it, and files
        are deleted in the background.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.4)

    def done(self, *tables: DataFrame) -> None:
        """Deletes tables of this block that no later step reads."""
        for t in tables:
            for p in [p for p in self.paths if any(p.rsplit("/", 1)[1] in f for f in t.inputFiles()[:1])]:
                self.paths.remove(p)
                self.drop(p)

    def drop(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def __exit__(self, *_) -> None:
        for p in self.paths:
            self.drop(p)
