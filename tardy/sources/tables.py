"""Materialised intermediate tables.

A stage output that several later stages read (the submission table, the
cleaned submissions) is written once as Parquet into the shared folder named
by ``spark.checkpoint.dir`` and read back. That keeps later plans small
(each self-join would otherwise copy the whole upstream plan), lets Parquet
prune columns and push filters for every reader, and cuts the lineage, so a
lost executor only costs the tasks after the last written table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

#: Written tables are read a few times at most: fewer bytes count more than speed.
CODEC = "zstd"
#: Folders this process has named and not yet removed.
_WRITTEN: set[str] = set()


def scratch_path(df: DataFrame, name: str) -> str:
    """A new folder under the checkpoint folder to write to; it is tracked."""
    base = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    return path


def write_scratch(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet under the checkpoint folder; returns the folder."""
    path = scratch_path(df, name)
    df.write.mode("overwrite").option("compression", CODEC).parquet(path)
    return path


def read_scratch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and return a reader."""
    return read_scratch(df.sparkSession, write_scratch(df, name))


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a tracked folder that nothing reads any more."""
    if path in _WRITTEN:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _WRITTEN.discard(path)


def remove_all_scratch(spark: SparkSession) -> int:
    """Delete every scratch table of this process, for the end of a session or
    once no DataFrame made before is read again. Returns how many there were."""
    paths = list(_WRITTEN)
    for path in paths:
        remove_scratch(spark, path)
    return len(paths)
