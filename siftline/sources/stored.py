"""Folders that driver and executors share, and tables written there."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local folder if executors are threads of the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system of a path, the path) as Spark's own readers see them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, where = filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def size_of(spark: SparkSession, path: str) -> int:
    fs, where = filesystem(spark, path)
    return fs.getContentSummary(where).getLength() if fs.exists(where) else 0


def new_folder(spark: SparkSession) -> str:
    """A place of its own in the shared folder, removed when the driver exits."""
    path = f"{shared_folder(spark)}/siftline-{uuid.uuid4().hex}"
    _own.append((spark, path))
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: what follows reads it, however often."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    for spark, path in _own:
        try:
            fs, where = filesystem(spark, path)
            fs.delete(where, True)
        except Exception:  # the session may already be gone
            continue
