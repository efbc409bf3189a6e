"""Folders of results in the place that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Terms and their hashes come again within a file, but more than Parquet's usual 1 MB of them.
DICTIONARY = ("parquet.dictionary.page.size", 8 << 20)
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares (a temporary one only where none is set, as in tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="twinsight-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, at: str, mode: str = "error") -> None:
    """Writes what is read from there from now on. The shuffle files of the write go as it ends: else they lie on disk until
    the driver happens to collect its garbage, which one that only plans hardly does."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).option(*DICTIONARY).parquet(at)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def held(df: DataFrame, name: str) -> DataFrame:
    """Written once where all executors can read it, for results that several steps need."""
    at = own_folder(df.sparkSession, name)
    written(df, at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dropped(spark: SparkSession, at: str) -> None:
    """Removes a folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
