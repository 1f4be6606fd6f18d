"""A live view of a day's figures: a stream of changed visits keeps the counts of AGG-04 (SRC-03).

The state holds what every visit was last, so a change takes the old visit away
and adds the new one.  Visits lie in a fixed number of buckets by the hash of
their id, each a state of its own, so no day and no patient is a hot key.  Each
micro-batch writes its signed counts as one folder; written again after a crash
it is the same folder.  The view sums the folders, and ``compact`` joins old ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chartloom.sources import versions

#: States; the number is part of a stream's checkpoint and must not change.
BUCKETS = 64
CHANGE = "appointment_id string, patient_id string, scheduled_time timestamp, status string, version bigint, deleted boolean"
_KEPT = ("appointment_id", "patient_id", "day", "status", "version")
_STATE = "appointment_id array<string>, patient_id array<string>, day array<string>, status array<string>, version array<bigint>"
_SIGNED = "day string, patient_id string, status string, n bigint"


def _follow(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Take the changes of a bucket's visits into its state; the signed rows that follow.  Only a greater version changes a visit."""
    held = pd.DataFrame(dict(zip(_KEPT, map(list, state.get)))) if state.exists else pd.DataFrame({c: [] for c in _KEPT})
    new = pd.concat(list(batches), ignore_index=True)
    new = new.sort_values(["version", "deleted", "day", "patient_id", "status"], na_position="first").drop_duplicates("appointment_id", keep="last")
    known = dict(zip(held["appointment_id"], held["version"]))
    new = new[[v > known.get(i, float("-inf")) for i, v in zip(new["appointment_id"], new["version"])]]
    old = held[held["appointment_id"].isin(new["appointment_id"])]
    # A deleted visit stays in the state without a day, so that a late older change cannot bring it back.
    added = new[list(_KEPT)].copy()
    added.loc[new["deleted"].to_numpy(bool), ["patient_id", "day", "status"]] = None
    after = pd.concat([held[~held["appointment_id"].isin(new["appointment_id"])], added], ignore_index=True).astype(object)
    after = after.where(after.notna(), None)
    state.update(tuple([int(v) for v in after[c]] if c == "version" else after[c].tolist() for c in _KEPT))
    signed = pd.concat([old.assign(n=-1), added.assign(n=1)], ignore_index=True)
    yield signed[signed["day"].notna()][["day", "patient_id", "status", "n"]]


def follow(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start keeping the view under ``path``: changes are rows of CHANGE with a visit's version, the greatest counting.

    Rows without an id or version are left out; of rows with one id and version
    the last by content counts.  A visit without a time counts on no day.
    """
    rows = changes.where("appointment_id is not null and version is not null").select(
        F.pmod(F.xxhash64("appointment_id"), F.lit(BUCKETS)).alias("bucket"), "appointment_id", "patient_id", F.to_date("scheduled_time").cast("string").alias("day"), "status", "version", F.coalesce("deleted", F.lit(False)).alias("deleted")
    )
    signed = rows.groupBy("bucket").applyInPandasWithState(_follow, _SIGNED, _STATE, "update", "NoTimeout")

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("day", "patient_id", "status").agg(F.sum("n").alias("n")).where("n != 0")
        counts.write.mode("overwrite").parquet(f"{path}/batch-{number:012d}")

    return signed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, patient_id, status, n) of the visits there are."""
    names = versions.folders(spark, path)
    joined = max((n for n in names if n.startswith("until-")), default=None)
    later = [n for n in names if n.startswith("batch-") and (joined is None or n[6:] > joined[6:])]
    folders = [f"{path}/{n}" for n in ([joined] if joined else []) + later]
    stored = spark.read.schema(_SIGNED).parquet(*folders) if folders else spark.createDataFrame([], _SIGNED)
    return stored.groupBy("day", "patient_id", "status").agg(F.sum("n").alias("n")).where("n != 0")


def figures(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The figures of each day, or of one, as ``chart.agenda`` counts them; a day without a visit has no row."""
    counts = _counts(spark, path)
    counts = counts if day is None else counts.where(F.col("day") == day)
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("n"))), F.lit(0)).alias
    return counts.groupBy(F.col("day").cast("date").alias("day")).agg(
        F.sum("n").alias("total"), of("Completed")("completed"), of("In Exam")("in_exam"), of("Waiting triage", "Checked In")("waiting"), F.count_distinct("patient_id").alias("patients"),
        F.coalesce(F.sum(F.when(F.col("status") != "Completed", F.col("n"))), F.lit(0)).alias("remaining"),
    )


def compact(spark: SparkSession, path: str) -> None:
    """Join all finished batches into one folder; a reader sees the batches or the joined folder, which hides them."""
    names = [n for n in versions.folders(spark, path) if n.startswith("batch-")]
    if not names:
        return
    last = max(names)[6:]
    counts = _counts(spark, path)
    counts.write.mode("overwrite").parquet(f"{path}/.until-{last}")
    versions.move(spark, f"{path}/.until-{last}", f"{path}/until-{last}")
    for n in versions.folders(spark, path):
        if n.startswith(("batch-", "until-")) and n[6:] <= last and n != f"until-{last}":
            versions.delete(spark, f"{path}/{n}")
