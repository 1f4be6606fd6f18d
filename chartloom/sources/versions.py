"""Folders that driver and executors share: versions of a stored table behind a signpost, and scratch tables.

A signpost is a table of one row that is replaced last, so that readers see the
old version until the whole of the new one is there.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

SIGNPOST = "current"

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset, a local session gets a temporary one and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="chartloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh(name: str) -> str:
    """A folder name that nobody else has."""
    return f"{name}-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, until ``release``."""
    path = f"{shared_folder(spark)}/{fresh(name)}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete what ``scratch`` has named so far; call it when all results that read it have been taken."""
    for path in _made:
        delete(spark, path)
    _made.clear()


def stored(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to a new folder and read it back."""
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    """Make ``row`` the signpost's."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{SIGNPOST}.next")
    delete(spark, f"{path}/{SIGNPOST}")
    move(spark, f"{path}/{SIGNPOST}.next", f"{path}/{SIGNPOST}")


def move(spark: SparkSession, source: str, target: str) -> None:
    a, fs = _files(spark, source)
    b, _ = _files(spark, target)
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")


def current(spark: SparkSession, path: str) -> Row:
    return spark.read.parquet(f"{path}/{SIGNPOST}").first()  # one row


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _files(spark, path)
    fs.delete(p, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    p, fs = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory()) if fs.exists(p) else []
