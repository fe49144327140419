"""Tables written once to the shared folder, and taken away again when nothing reads them any more."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plantscope.session import scratch_path


def write_once(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; every later use sees the same rows, whichever executors are lost."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what :func:`write_once` has written for ``frames``; nothing may read them afterwards."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
