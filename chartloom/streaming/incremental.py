"""Streams: keyed merges of changed entities, and windowed activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartloom.operators import ingest
from chartloom.sources import versions


def merge_changes(changes: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Merge a stream of changed rows into versioned Parquet, the last change of a key winning.

    Each micro-batch writes version N + 1 from version N, so a repeated batch
    gives the same version again.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
        if number:
            stored = spark.read.parquet(f"{path}/v{number - 1}")
            last = ingest.merge(stored, last, key, tuple(stored.columns))
        last.write.mode("overwrite").parquet(f"{path}/v{number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_MANIFEST = "batch bigint, versions map<int, bigint>"


def keep_table(changes: DataFrame, path: str, key: str, order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merge a stream of changed rows into a table of key buckets; read it with ``kept_table``.

    The change of a key with the greatest ``order`` wins, whenever it comes; of
    equal ones the later batch's.

    A micro-batch writes the buckets that it touches and no other, as a version of
    its own, and then replaces the signpost that names each bucket's version.  A
    batch that is given again after a crash is left alone when the signpost has
    it, and else written again.
    """
    spark = changes.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        began = versions.SIGNPOST in versions.folders(spark, path)
        state = versions.current(spark, path) if began else None
        if began and state["batch"] >= number:
            return
        known = dict(state["versions"]) if began else {}
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        last = versions.stored(last, versions.scratch(spark, "changes"))
        touched = [r["bucket"] for r in last.select("bucket").distinct().collect()]  # ``buckets`` at most
        old = [f"{path}/v{known[b]}/bucket={b}" for b in touched if b in known]
        merged = last.drop("bucket")
        if old:
            both = merged.withColumn("__new", F.lit(1)).unionByName(spark.read.schema(merged.schema).parquet(*old).withColumn("__new", F.lit(0)))
            merged = both.groupBy(key).agg(F.max_by(F.struct(*merged.columns), F.struct(order, "__new")).alias("r")).select("r.*")
        merged = merged.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{number}")
        versions.publish(spark, path, _MANIFEST, (number, known | dict.fromkeys(touched, number)))

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows that the signpost names; fails where no batch has been written yet."""
    named = versions.current(spark, path)["versions"]
    return spark.read.parquet(*[f"{path}/v{v}/bucket={b}" for b, v in sorted(named.items())])


def drop_replaced(spark: SparkSession, path: str) -> int:
    """Delete the buckets that newer versions have replaced; returns how many."""
    named = {(v, b) for b, v in versions.current(spark, path)["versions"].items()}
    old = [(v, b) for v in versions.folders(spark, path) if v.startswith("v") for b in versions.folders(spark, f"{path}/{v}") if b.startswith("bucket=") and (int(v[1:]), int(b[7:])) not in named]
    for v, b in old:
        versions.delete(spark, f"{path}/{v}/{b}")
    return len(old)


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and values by type and tumbling window, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
