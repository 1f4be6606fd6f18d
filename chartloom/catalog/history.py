"""Rollups and stored sketches, version differences and pages, and the live view of a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.catalog.registry import query
from chartloom.operators import rollups
from chartloom.sources import history, versions
from chartloom.sources.clinic import load
from chartloom.sources.tables import table
from chartloom.streaming import live_view

_GROUPS = "reason_for_visit, status, CAST(GROUPING(reason_for_visit) * 2 + GROUPING(status) AS BIGINT) AS level, count(*) AS visits, count(DISTINCT patient_id) AS patients, round(sum(value), 4) AS value"


def _visits(spark, d, every):
    out = rollups.rolled_up(load(spark, d, "appointment"), ["reason_for_visit", "status"], F.count(F.lit(1)).alias("visits"), F.count_distinct("patient_id").alias("patients"), F.round(F.sum("value"), 4).alias("value"), every=every)
    return out.withColumn("level", F.col("level").cast("bigint"))


@query("visits_rollup", f"SELECT {_GROUPS} FROM appointment GROUP BY ROLLUP (reason_for_visit, status)")
def visits_rollup(spark, d):
    return _visits(spark, d, False)


@query("visits_cube", f"SELECT {_GROUPS} FROM appointment GROUP BY CUBE (reason_for_visit, status)")
def visits_cube(spark, d):
    return _visits(spark, d, True)


@query("record_rollup", "SELECT condition_name, status, severity, CAST(GROUPING(condition_name) * 4 + GROUPING(status) * 2 + GROUPING(severity) AS BIGINT) AS level, count(*) AS records FROM record GROUP BY ROLLUP (condition_name, status, severity)")
def record_rollup(spark, d):
    out = rollups.rolled_up(load(spark, d, "record"), ["condition_name", "status", "severity"], F.count(F.lit(1)).alias("records"))
    return out.withColumn("level", F.col("level").cast("bigint"))


def daily_sketches(spark, d) -> str:
    """The visits' sketches by day, stored."""
    path = versions.scratch(spark, "sketches")
    rollups.store_days(rollups.sketched(load(spark, d, "appointment"), "scheduled_time", ["status"], "patient_id", "value"), path)
    return path


@query("sketched_weeks", "SELECT CAST(date_trunc('week', scheduled_time) AS DATE) AS week, status, count(*) AS events, round(sum(value), 4) AS value_sum FROM appointment GROUP BY 1, 2")
def sketched_weeks(spark, d):
    """What the stored days say of weeks, exactly; the sketches' estimates are in ``sketch_estimates``."""
    weeks = rollups.merged(rollups.stored_days(spark, daily_sketches(spark, d)), F.date_trunc("week", "day").cast("date").alias("week"), "status")
    return weeks.select("week", "status", "events", F.round("value_sum", 4).alias("value_sum"))


@query("sketch_estimates")
def sketch_estimates(spark, d):
    """Distinct patients and three quantiles of a value, of each status, from the merged sketches of all days."""
    whole = rollups.merged(rollups.stored_days(spark, daily_sketches(spark, d)), "status")
    return whole.select("status", "events", rollups.distinct_keys().alias("patients"), *[rollups.quantile(q).alias(f"p{round(100 * q)}") for q in (0.5, 0.9, 0.99)])


_NEW = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 9 <> 0 UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 17 = 0)"
_OLD = "(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders)"


def _versions(spark, d):
    """The orders, and the orders after deletions, changes and inserts."""
    old = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = old.where("o_orderkey % 9 != 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 13 == 0, "X").otherwise(F.col("o_orderstatus")))
    return old, changed.unionByName(old.where("o_orderkey % 17 = 0").withColumn("o_orderkey", -F.col("o_orderkey")))


@query(
    "version_diff",
    f"""SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change, o.o_orderstatus AS old_status, n.o_orderstatus AS new_status
    FROM {_OLD} o FULL JOIN {_NEW} n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR o.o_orderstatus <> n.o_orderstatus""",
)
def version_diff(spark, d):
    return history.diff(*_versions(spark, d), "o_orderkey").select("o_orderkey", "change", F.col("before.o_orderstatus").alias("old_status"), F.col("after.o_orderstatus").alias("new_status"))


@query("version_except", f"SELECT * FROM {_NEW} EXCEPT SELECT * FROM {_OLD}")
def version_except(spark, d):
    old, new = _versions(spark, d)
    return history.except_rows(new, old)


@query("version_patched", f"SELECT * FROM {_NEW}")
def version_patched(spark, d):
    """The older version with the difference applied."""
    old, new = _versions(spark, d)
    return history.apply_diff(old, history.diff(old, new, "o_orderkey"), "o_orderkey")


@query("page_of_orders", "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 700")
def page_of_orders(spark, d):
    """Rows 700 to 749 of the orders by price."""
    return history.Pages.of(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey")).page(700, 50)


@query(
    "live_agenda",
    """SELECT CAST(scheduled_time AS DATE) AS day, count(*) AS total, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'In Exam') AS in_exam, count(*) FILTER (status IN ('Waiting triage', 'Checked In')) AS waiting,
    count(DISTINCT patient_id) AS patients, count(*) FILTER (status <> 'Completed') AS remaining
    FROM (SELECT patient_id, scheduled_time, CASE WHEN CAST(appointment_id AS BIGINT) % 3 = 0 THEN 'Completed' ELSE status END AS status FROM appointment WHERE CAST(appointment_id AS BIGINT) % 10 <> 7) GROUP BY 1""",
)
def live_agenda(spark, d):
    """The days' figures after two batches of a stream: all visits, then a third completed and a tenth deleted."""
    folder = versions.scratch(spark, "live-agenda")
    visits = load(spark, d, "appointment").select("appointment_id", "patient_id", F.col("scheduled_time").cast("timestamp").alias("scheduled_time"), "status", F.lit(1).cast("bigint").alias("version"), F.lit(False).alias("deleted"))
    number = F.col("appointment_id").cast("bigint")
    second = visits.where((number % 3 == 0) | (number % 10 == 7)).withColumn("status", F.lit("Completed")).withColumn("version", F.lit(2).cast("bigint")).withColumn("deleted", number % 10 == 7)
    for batch, rows in enumerate((visits, second)):
        rows.write.parquet(f"{folder}/changes/{batch}")
        changes = spark.readStream.schema(live_view.CHANGE).option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
        live_view.follow(changes, f"{folder}/view", f"{folder}/checkpoint").awaitTermination()
    return live_view.figures(spark, f"{folder}/view")
