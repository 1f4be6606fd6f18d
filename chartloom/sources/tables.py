"""Parquet tables: full fetch, point lookup, resolution, counts, versioned saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.schemas import schema

SPREAD_BYTES = 256 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for heavy work row by row, dealt over the cores if it is of few bytes.

    One task reads a row group, and a small file may have one only; the shuffle
    is of SPREAD_BYTES at most, and larger tables are read as they lie.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    df = table(spark, sf_dir, name)
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def fetch(spark: SparkSession, path: str, entity: str, *order) -> DataFrame:
    """Every row of a stored entity, in an order if one is given (SRC-01)."""
    df = spark.read.schema(schema(entity)).parquet(path)
    return df.orderBy(*order) if order else df


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """At most one row with an id; the predicate reaches the scan (SRC-02)."""
    return df.where(F.col(column) == F.lit(value)).limit(1)


def resolve(df: DataFrame, id_column: str, ids: list | None = None, text: str | None = None, *name_columns: str) -> DataFrame:
    """By ids, by a case-insensitive substring of the names, or all (SRC-04)."""
    if ids is not None:
        return df.where(F.col(id_column).isin(ids))
    if text:
        names = F.concat_ws(" ", *name_columns)
        return df.where(F.lower(names).contains(text.lower()))
    return df


def observe(df: DataFrame, name: str) -> DataFrame:
    """A view that is evaluated at each use (SRC-03)."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def save(df: DataFrame, path: str) -> None:
    """One atomic commit of a new version (SNK-01, SRC-07)."""
    df.write.mode("overwrite").parquet(path)


def delete_where_in(df: DataFrame, deleted: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not deleted: cascades and deletes by patient (FTS-09, VEC-05)."""
    return df.join(deleted.select(on).distinct(), on, "left_anti")


def delete_containing(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows without the substring; null keeps (FLT-15)."""
    return df.where(~F.coalesce(F.col(column).contains(text), F.lit(False)))
