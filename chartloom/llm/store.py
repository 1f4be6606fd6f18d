"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: An Arrow batch holds at most this many rows and about this many bytes, so that a batch of
#: very long texts stays small in the JVM and in the Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.  Where it is unset, a local session gets a temporary one and a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "chartloom-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage ends at files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the order of scratch tables, for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the scratch tables made after ``since``, but for the last ``keep``; call it once their results are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    end = len(_made) - keep
    for path in _made[since:end]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _made[since:end]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _bytes(setting: str) -> int:
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    text = setting.strip().lower().removesuffix("b") or "0"
    return int(float(text[:-1]) * units[text[-1]]) if text[-1] in units else int(text)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES; smaller ones stay, as does any other setting."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < _bytes(spark.conf.get(size, "64m")) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns or ("*",))


def others(df: DataFrame, *outputs: str) -> list[str]:
    """The columns of ``df`` that no output column replaces."""
    taken = {c.lower() for c in outputs}
    return [c for c in df.columns if c.lower() not in taken]


def text_of(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
