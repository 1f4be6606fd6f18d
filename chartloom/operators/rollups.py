"""Grouping sets over the panel, and stored sketches that merge (AGG-14).

A sketch table has a row a day and group: exact count and sum, and sketches of
the distinct keys and of a value's distribution.  Days are partitions, so a day
is added or computed again by itself, and any longer period is a merge of rows
of fixed size: the events are not read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2^LG_K registers a distinct sketch: a standard error of 1.04 / 2^(LG_K / 2), 1.6 %.
LG_K = 12
#: Size of a quantile sketch: ranks are off by about 1.3 % for one sketch or any merge of sketches.
KLL_K = 200
DISTINCT_ERROR, RANK_ERROR = 1.04 / 2 ** (LG_K / 2), 0.0133


def rolled_up(df: DataFrame, dimensions: list[str], *totals: Column, every: bool = False) -> DataFrame:
    """Totals of all prefixes of the dimensions, or of every subset; ``level`` has a bit for each dimension that is summed over, the last the lowest.

    So a null that is a value differs from one that stands for all.
    """
    grouped = df.cube(*dimensions) if every else df.rollup(*dimensions)
    return grouped.agg(F.grouping_id().alias("level"), *totals)


def sketched(events: DataFrame, time: str, by: list[str], key: str, value: str) -> DataFrame:
    """(day, *by, events, value_sum, keys, value_sketch): a row a day and group; rows without a time are left out, null keys and values are not sketched."""
    known = events.where(F.col(time).isNotNull()).withColumn("day", F.to_date(time))
    return known.groupBy("day", *by).agg(
        F.count(F.lit(1)).alias("events"), F.sum(value).alias("value_sum"), F.hll_sketch_agg(key, LG_K).alias("keys"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("value_sketch")
    )


def store_days(sketches: DataFrame, path: str) -> None:
    """Write sketches by day; days that are there already are replaced, others stay."""
    sketches.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """The sketches of a period; other days' folders are not read."""
    df = spark.read.parquet(path)
    df = df if first is None else df.where(F.col("day") >= F.lit(first).cast("date"))
    return df if last is None else df.where(F.col("day") <= F.lit(last).cast("date"))


def merged(sketches: DataFrame, *by: Column | str) -> DataFrame:
    """(*by, events, value_sum, keys, value_sketch) of larger groups, from sketches alone."""
    return sketches.groupBy(*by).agg(
        F.sum("events").alias("events"), F.sum("value_sum").alias("value_sum"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("value_sketch", KLL_K).alias("value_sketch")
    )


def distinct_keys(sketch: Column | str = "keys") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: Column | str = "value_sketch") -> Column:
    """The value at a share of the ranks; null where no value was sketched."""
    n = F.kll_sketch_get_n_double(sketch)
    return F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))
