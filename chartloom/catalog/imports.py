"""Ingest and merge: bundles are built from orders, lines and events, then read back as raw JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.catalog.registry import AS_OF, query
from chartloom.operators import ingest
from chartloom.sources import bundles
from chartloom.sources.clinic import load
from chartloom.sources.tables import table
from chartloom.streaming import incremental

BASE = "https://records.example.org"


def _bundle(rows, per: str, resource):
    entries = F.array_sort(F.collect_list(F.struct(F.col("k"), F.struct(resource.alias("resource")).alias("e"))))
    return rows.groupBy(per).agg(F.to_json(F.struct(F.transform(entries, lambda x: x["e"]).alias("entry"))).alias("value"))


def _coded(text):
    return F.struct(F.array(F.struct(F.lit("").alias("display"), F.lit("c").alias("code")), F.struct(text.alias("display"), F.lit("d").alias("code"))).alias("coding"))


def conditions(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    r = F.struct(F.col("o_orderkey").cast("string").alias("id"), _coded(F.col("o_orderpriority")).alias("code"), F.struct(F.when(F.col("o_orderstatus") == "F", "Active").when(F.col("o_orderstatus") == "P", "provisional").otherwise("on hold").alias("text")).alias("clinicalStatus"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("recordedDate"))
    return bundles.unwrap(_bundle(o, "o_custkey", r).select("value"), "Condition")[0]


_ADAPTED = f"""SELECT '{BASE}/' || o_orderkey AS record_id, o_orderpriority AS condition_name, CASE o_orderstatus WHEN 'F' THEN 'Final' WHEN 'P' THEN 'Preliminary' ELSE 'On Hold' END AS status, date_trunc('second', o_orderdate) AS date_recorded,
CASE o_orderstatus WHEN 'F' THEN 'signed' ELSE 'reviewed' END AS documentation_status FROM orders"""


@query("adapt_conditions", _ADAPTED)
def adapt_conditions(spark, d):
    return ingest.records(conditions(spark, d), BASE, AS_OF, "p").select("record_id", "condition_name", "status", "date_recorded", "documentation_status")


@query("adapt_medications", f"SELECT '{BASE}/' || l_orderkey || '-' || l_linenumber AS rx_id, 'part ' || l_partkey AS medication_name, CAST(l_linenumber AS INTEGER) AS refills, CASE l_returnflag WHEN 'A' THEN 'Active' WHEN 'N' THEN NULL ELSE 'Stopped' END AS status, 'See SIG' AS quantity_info FROM lineitem")
def adapt_medications(spark, d):
    x = table(spark, d, "lineitem").withColumn("k", F.col("l_linenumber"))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    status = F.when(F.col("l_returnflag") == "A", "active").when(F.col("l_returnflag") == "R", "stopped")
    r = F.struct(key.alias("id"), F.struct(F.concat(F.lit("part "), "l_partkey").alias("text")).alias("medicationCodeableConcept"), status.alias("status"), F.struct(F.col("l_linenumber").alias("numberOfRepeatsAllowed")).alias("dispenseRequest"))
    raw = bundles.unwrap(_bundle(x, "l_orderkey", r).select("value"), "MedicationRequest")[0]
    return ingest.medications(raw, BASE, AS_OF, "p").select("rx_id", "medication_name", "refills", "status", "quantity_info")


_APPT = """CASE event_type WHEN 'view' THEN 'Scheduled' WHEN 'click' THEN 'Pending' WHEN 'purchase' THEN 'Completed' WHEN 'signup' THEN 'Checked In' ELSE 'No Show' END"""


def _appointments(spark, d, shift):
    e = table(spark, d, "events").withColumn("k", F.col("event_id"))
    status = F.create_map(*[F.lit(x) for p in {"view": "booked", "click": "proposed", "purchase": "fulfilled", "signup": "Arrived", "error": "noshow"}.items() for x in p])[F.col("event_type")]
    r = F.struct(F.col("event_id").cast("string").alias("id"), status.alias("status"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start"))
    raw = bundles.unwrap(_bundle(e, "user_id", r).select("value"), "Appointment")[0]
    return ingest.appointments(raw, BASE, AS_OF, "p", shift).select("appointment_id", "scheduled_time", "status", "reason_for_visit")


@query("adapt_appointments", f"SELECT '{BASE}/' || event_id AS appointment_id, date_trunc('second', ts) AS scheduled_time, {_APPT} AS status, 'Appointment' AS reason_for_visit FROM events")
def adapt_appointments(spark, d):
    return _appointments(spark, d, False)


@query("adapt_appointments_shifted", f"SELECT '{BASE}/' || event_id AS appointment_id, DATE '{AS_OF[:10]}' + (date_trunc('second', ts) - date_trunc('day', ts)) AS scheduled_time, {_APPT} AS status, 'Appointment' AS reason_for_visit FROM events")
def adapt_appointments_shifted(spark, d):
    return _appointments(spark, d, True)


@query("adapt_patients", f"SELECT 'M' || c_custkey AS medical_record_number, 'Unknown' AS first_name, c_name AS last_name, CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Unknown' END AS gender, 'tel ' || c_custkey AS emergency_contact_phone FROM customer")
def adapt_patients(spark, d):
    c = table(spark, d, "customer").withColumn("k", F.col("c_custkey"))
    ids = F.array(F.struct(F.lit("").alias("value"), F.lit("empty").alias("system")), F.struct(F.concat(F.lit("M"), "c_custkey").alias("value"), F.lit("mrn").alias("system")))
    phone = F.struct(F.array(F.struct(F.lit("Phone").alias("system"), F.concat(F.lit("tel "), "c_custkey").alias("value"))).alias("telecom"))
    r = F.struct(F.col("c_custkey").cast("string").alias("id"), ids.alias("identifier"), F.array(F.struct(F.col("c_name").alias("family"))).alias("name"), F.when(F.col("c_custkey") % 2 == 0, "female").alias("gender"), F.array(phone).alias("contact"))
    raw = bundles.unwrap(_bundle(c, "c_nationkey", r).select("value"), "Patient")[0]
    return ingest.patients(raw, BASE, AS_OF).select("medical_record_number", "first_name", "last_name", "gender", "emergency_contact_phone")


@query("infeed_dedup", "SELECT patient_id, count(*) - 1 AS extra FROM record GROUP BY patient_id HAVING count(*) > 1")
def infeed_dedup(spark, d):
    return ingest.duplicates(load(spark, d, "record"), "patient_id")


@query(
    "upsert_merge",
    """SELECT record_id, CASE WHEN CAST(record_id AS BIGINT) % 3 = 0 THEN 'Updated' ELSE condition_name END AS condition_name, severity FROM record WHERE CAST(record_id AS BIGINT) % 2 = 0
    UNION ALL SELECT record_id, 'Updated', 'new' FROM record WHERE CAST(record_id AS BIGINT) % 3 = 0 AND CAST(record_id AS BIGINT) % 2 = 1""",
)
def upsert_merge(spark, d):
    r = load(spark, d, "record")
    n = F.col("record_id").cast("bigint")
    feed = r.where(n % 3 == 0).withColumns({"condition_name": F.lit("Updated"), "severity": F.lit("new")})
    return ingest.merge(r.where(n % 2 == 0), feed, "record_id", ingest.CONDITION_UPDATES).select("record_id", "condition_name", "severity")


@query("sync_counts", "SELECT count(*) FILTER (CAST(record_id AS BIGINT) % 2 = 1) AS inserted, count(*) FILTER (CAST(record_id AS BIGINT) % 2 = 0) AS updated, CAST(count(*) AS BIGINT) AS duplicates FROM record WHERE CAST(record_id AS BIGINT) % 3 = 0")
def sync_counts(spark, d):
    r = load(spark, d, "record")
    n = F.col("record_id").cast("bigint")
    feed = r.where(n % 3 == 0).withColumn("position", n)
    twice = feed.unionAll(feed.withColumn("position", F.col("position") + 10**9))
    return ingest.sync(r.where(n % 2 == 0), twice, "record_id", ingest.CONDITION_UPDATES)[1].select("inserted", "updated", F.col("duplicates").cast("bigint").alias("duplicates"))


def _identified(spark, d, shift: int):
    return load(spark, d, "patient").select(
        (F.col("patient_id").cast("bigint") + shift).cast("string").alias("patient_id"), F.when(F.col("patient_id").cast("bigint") % 4 == 0, F.lit("")).otherwise(F.col("medical_record_number")).alias("medical_record_number"), F.lit("mrn").alias("medical_record_number_system"),
        F.when(F.col("patient_id").cast("bigint") % 2 == 0, F.col("patient_id")).otherwise(F.concat(F.lit(str(shift) + "-"), "patient_id")).alias("source_record_identifier"), F.lit(BASE).alias("source_system_name"),
    )


@query("or_key_match", "SELECT CAST(CAST(patient_id AS BIGINT) + 1000000 AS VARCHAR) AS incoming_id, patient_id AS stored_id FROM patient")
def or_key_match(spark, d):
    """Even ids match by source, those not divisible by four by record number; every patient matches once."""
    return ingest.match_patients(_identified(spark, d, 0), _identified(spark, d, 1_000_000))


@query("merged_allergies", "SELECT patient_id, CASE allergies WHEN 'Latex|Pollen' THEN 'Latex,Pollen,Dust' WHEN 'Dust' THEN 'Dust,Latex' WHEN '' THEN 'Latex,Dust' ELSE allergies || ',Latex,Dust' END AS allergies FROM patient")
def merged_allergies(spark, d):
    new = F.array(F.lit("Latex"), F.lit("Dust"), F.lit(None).cast("string"), F.lit("Dust"))
    return load(spark, d, "patient").select("patient_id", F.array_join(ingest.merge_allergies(F.col("allergies"), new), ",").alias("allergies"))


@query("lifecycle_update", "SELECT record_id, 'Final' AS status, 'signed' AS documentation_status, coalesce(nullif(severity, ''), 'Unknown clinician') AS provider_signature FROM record")
def lifecycle_update(spark, d):
    return ingest.set_lifecycle(load(spark, d, "record"), "signed", AS_OF, "severity").select("record_id", "status", "documentation_status", "provider_signature")


@query(
    "note_sync",
    f"""SELECT record_id, coalesce(l, documentation_status) AS documentation_status FROM (SELECT record_id, patient_id, documentation_status, CAST(date_recorded AS DATE) = DATE '{AS_OF[:10]}' AS today FROM (SELECT * REPLACE (DATE '{AS_OF[:10]}' + INTERVAL 1 HOUR AS date_recorded) FROM record)) r
    LEFT JOIN (SELECT patient_id, arg_max(l, (scheduled_time, appointment_id)) AS l FROM (SELECT patient_id, scheduled_time, appointment_id, CASE status WHEN 'Completed' THEN 'signed' WHEN 'In Exam' THEN 'draft' END AS l FROM appointment WHERE CAST(scheduled_time AS DATE) = DATE '{AS_OF[:10]}') WHERE l IS NOT NULL GROUP BY 1) a ON r.patient_id = a.patient_id AND today""",
)
def note_sync(spark, d):
    a = load(spark, d, "appointment").withColumn("reason_for_visit", F.lit("visit"))
    r = load(spark, d, "record").withColumns({"condition_name": F.lit("Visit"), "date_recorded": F.date_trunc("day", F.lit(AS_OF).cast("timestamp")) + F.expr("interval 1 hour")})
    return ingest.sync_notes(a, r, AS_OF).select("record_id", "documentation_status")


@query("json_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("hourly_activity", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def hourly_activity(spark, d):
    """The streaming aggregation, applied to a bounded table."""
    out = incremental.activity(table(spark, d, "events"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))
