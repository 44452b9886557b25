"""Named tables that are replaced as a whole and stored in an order.

``replace_table`` writes the rows clustered by an order (each file holds one range of
it, sorted), with a manifest of every file's range, into a new version folder,
and then swaps the name to it by renaming one small pointer file. Readers see the
old version or the new one, never a mixture; a table can be replaced by a query
over itself. The last replaced version stays for readers that still run.

Tables live under ``spark.checkpoint.dir`` in ``store/<name>``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .tables import CODEC

POINTER = "CURRENT"
#: Rows of a file of a stored table.
FILE_ROWS = 1_000_000


def _folder(spark: SparkSession, name: str) -> str:
    if not name.replace("_", "").isalnum():
        raise ValueError(f"not a table name: {name!r}")
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/store/{name}"


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, name: str) -> str | None:
    """The folder that the name stands for, None if there is no such table."""
    path, fs = _path(spark, f"{_folder(spark, name)}/{POINTER}")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return f"{_folder(spark, name)}/{text.strip()}"


def _swap(spark: SparkSession, name: str, version: str) -> None:
    folder = _folder(spark, name)
    new, fs = _path(spark, f"{folder}/{POINTER}-{version}")
    out = fs.create(new, True)
    out.write(bytearray(version, "utf-8"))
    out.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(new, _path(spark, f"{folder}/{POINTER}")[0], over)


def replace_table(df: DataFrame, name: str, order: Sequence[str], file_rows: int = FILE_ROWS) -> DataFrame:
    """Store ``df`` as the table ``name`` in ascending ``order`` (nulls last) in
    place of what the name stood for; returns a reader of the new version."""
    spark = df.sparkSession
    before = current_version(spark, name)
    version = f"v{uuid.uuid4().hex}"
    at = f"{_folder(spark, name)}/{version}"
    # The rows are written once as they come: they are counted to size the files,
    # and sampled for their ranges without computing them again.
    df.write.option("compression", CODEC).parquet(f"{at}/_rows")
    rows = spark.read.parquet(f"{at}/_rows")
    by = [F.col(c).asc_nulls_last() for c in order]
    files = max(1, math.ceil(rows.count() / file_rows))
    rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.option("compression", CODEC).parquet(f"{at}/data")
    stored = spark.read.parquet(f"{at}/data")
    lead = order[0]
    ranges = stored.groupBy(F.input_file_name().alias("file")).agg(
        F.min(lead).alias("low"), F.max(lead).alias("high"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(lead).isNull()).alias("nulls")
    )
    ranges.coalesce(1).write.parquet(f"{at}/manifest")
    path, fs = _path(spark, f"{at}/_rows")
    fs.delete(path, True)
    _swap(spark, name, version)
    _remove_others(spark, name, {version, *([before.rsplit("/", 1)[1]] if before else [])})
    return stored


def _remove_others(spark: SparkSession, name: str, keep: set[str]) -> None:
    path, fs = _path(spark, _folder(spark, name))
    for f in fs.listStatus(path):
        if f.isDirectory() and f.getPath().getName() not in keep:
            fs.delete(f.getPath(), True)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """The table's current version."""
    at = current_version(spark, name)
    if at is None:
        raise ValueError(f"no table {name!r}")
    return spark.read.parquet(f"{at}/data")


def read_range(spark: SparkSession, name: str, column: str, low=None, high=None) -> DataFrame:
    """The rows with ``low <= column <= high`` (None: no bound), ``column`` being the
    first of the table's order: only files whose range meets it are opened."""
    at = current_version(spark, name)
    if at is None:
        raise ValueError(f"no table {name!r}")
    manifest, rows = spark.read.parquet(f"{at}/manifest"), F.col(column)
    kind = spark.read.parquet(f"{at}/data").schema[column].dataType

    def between(least: Column, most: Column) -> Column:
        inside = F.lit(True) if low is None else most >= F.lit(low).cast(kind)
        return inside if high is None else inside & (least <= F.lit(high).cast(kind))

    # A row a file, as many as the driver lists to read the table.
    files = [r["file"] for r in manifest.where(between(F.col("low"), F.col("high")) & F.col("low").isNotNull()).select("file").collect()]
    data = spark.read.parquet(*files) if files else spark.read.parquet(f"{at}/data").limit(0)
    return data.where(between(rows, rows) & rows.isNotNull())


def drop_table(spark: SparkSession, name: str) -> None:
    path, fs = _path(spark, _folder(spark, name))
    fs.delete(path, True)
