"""As-of and interval joins, episodes, trailing frames, and long panels in batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.catalog.registry import query
from chartloom.operators import intent, order_statistic, timelines
from chartloom.sources.clinic import load
from chartloom.sources.tables import table


@query(
    "record_before_visit",
    """SELECT a.appointment_id, r.record_id FROM appointment a ASOF LEFT JOIN (SELECT patient_id, date_recorded, max(record_id) AS record_id FROM record GROUP BY 1, 2) r
    ON a.patient_id = r.patient_id AND a.scheduled_time >= r.date_recorded""",
)
def record_before_visit(spark, d):
    """The latest record of the patient before each visit."""
    found = timelines.as_of_join(load(spark, d, "appointment"), load(spark, d, "record"), "patient_id", "scheduled_time", "date_recorded", "record_id", take=["record_id"])
    return found.select("appointment_id", "right.record_id")


@query(
    "medication_at_record",
    """SELECT r.record_id, m.rx_id FROM record r ASOF LEFT JOIN (SELECT patient_id, written_date, max(rx_id) AS rx_id FROM medication GROUP BY 1, 2) m ON r.patient_id = m.patient_id AND r.date_recorded >= m.written_date""",
)
def medication_at_record(spark, d):
    """The medication that was written last when a record was made."""
    found = timelines.as_of_join(load(spark, d, "record"), load(spark, d, "medication"), "patient_id", "date_recorded", "written_date", "rx_id", take=["rx_id"])
    return found.select("record_id", "right.rx_id")


@query(
    "overlapping_medications",
    """SELECT a.rx_id AS rx_id, b.rx_id AS other_rx_id FROM (SELECT patient_id, rx_id, written_date FROM medication) a JOIN (SELECT patient_id, rx_id, written_date FROM medication) b
    ON a.patient_id = b.patient_id AND a.rx_id < b.rx_id AND a.written_date <= b.written_date + INTERVAL 30 DAY AND b.written_date <= a.written_date + INTERVAL 30 DAY""",
)
def overlapping_medications(spark, d):
    """Pairs of a patient's medications whose 30 days from writing overlap."""
    m = load(spark, d, "medication").select("patient_id", "rx_id", F.col("written_date").cast("timestamp").alias("period_start")).withColumn("period_end", F.expr("period_start + INTERVAL 30 DAY"))
    return timelines.overlaps(m, m, "patient_id", "period_start", "period_end").where("left.rx_id < right.rx_id").select("left.rx_id", F.col("right.rx_id").alias("other_rx_id"))


@query(
    "episodes_of_care",
    """SELECT patient_id, min(t) AS first_event, max(t) AS last_event, count(*) AS events FROM (SELECT patient_id, t, sum(CASE WHEN gap IS NULL OR gap > 90 * 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY t) AS episode
    FROM (SELECT patient_id, date_recorded AS t, epoch(date_recorded) - epoch(lag(date_recorded) OVER (PARTITION BY patient_id ORDER BY date_recorded)) AS gap FROM record)) GROUP BY patient_id, episode""",
)
def episodes_of_care(spark, d):
    """Stretches of records without a gap of over 90 days."""
    return timelines.episodes(load(spark, d, "record"), "patient_id", "date_recorded", 90)


@query(
    "visit_sessions",
    """SELECT patient_id, min(t) AS first_event, max(t) AS last_event, count(*) AS events FROM (SELECT patient_id, t, sum(CASE WHEN gap IS NULL OR gap > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY patient_id ORDER BY t) AS episode
    FROM (SELECT patient_id, scheduled_time AS t, epoch_us(scheduled_time) / 1e6 - epoch_us(lag(scheduled_time) OVER (PARTITION BY patient_id ORDER BY scheduled_time)) / 1e6 AS gap FROM appointment)) GROUP BY patient_id, episode""",
)
def visit_sessions(spark, d):
    """Visits that follow within a day."""
    return timelines.episodes(load(spark, d, "appointment"), "patient_id", "scheduled_time", 1)


@query(
    "trailing_records",
    "SELECT record_id, count(*) OVER (PARTITION BY patient_id ORDER BY date_recorded RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS trailing_n FROM record",
)
def trailing_records(spark, d):
    """The patient's records of the last 90 days at each record."""
    return timelines.trailing(load(spark, d, "record").withColumn("one", F.lit(1)), "patient_id", "date_recorded", "one", 90).select("record_id", "trailing_n")


@query(
    "trailing_visits",
    "SELECT appointment_id, count(*) OVER w AS trailing_n, round(sum(value) OVER w, 6) AS trailing_sum FROM appointment WINDOW w AS (PARTITION BY patient_id ORDER BY scheduled_time RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)",
)
def trailing_visits(spark, d):
    return timelines.trailing(load(spark, d, "appointment"), "patient_id", "scheduled_time", "value", 7).select("appointment_id", "trailing_n", F.round("trailing_sum", 6).alias("trailing_sum"))


@query("median_order_price", "SELECT o_totalprice AS price FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET (SELECT count(*) // 2 FROM orders)")
def median_order_price(spark, d):
    """An exact order statistic."""
    prices = table(spark, d, "orders").select("o_totalprice")
    return spark.createDataFrame([(order_statistic.nth(prices, "o_totalprice", prices.count() // 2),)], "price double")


@query("batched_records")
def batched_records(spark, d):
    """All lines of a patient's records in batches of 400 characters, a patient a group."""
    lines = load(spark, d, "record").select("patient_id", "record_id", F.concat_ws(" — ", "condition_name", "status", "severity").alias("line"))
    return intent.batch_lines(lines, 400, "patient_id", "record_id").select("patient_id", "record_id", "batch")
