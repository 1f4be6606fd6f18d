"""Resources to entities, and keyed merges into the stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.text import capitalized

#: Raw status and what it means.
CONDITION_STATUS = {"active": "Final", "recurrence": "Final", "relapse": "Final", "provisional": "Preliminary", "unconfirmed": "Preliminary"}
APPOINTMENT_STATUS = {
    "proposed": "Pending", "pending": "Pending", "booked": "Scheduled", "arrived": "Checked In", "checked-in": "Checked In", "checked in": "Checked In",
    "fulfilled": "Completed", "noshow": "No Show", "no-show": "No Show", "cancelled": "Cancelled", "canceled": "Cancelled",
}
CONDITION_UPDATES = ("date_recorded", "condition_name", "status", "documentation_status", "documentation_signed_at", "source_kind", "source_system_name", "source_record_identifier", "source_last_synced_at", "source_of_truth", "patient_id")
PATIENT_UPDATES = ("first_name", "last_name", "date_of_birth", "gender", "emergency_contact_name", "emergency_contact_phone", "source_kind", "source_system_name", "source_record_identifier", "source_last_synced_at", "source_of_truth", "medical_record_number_system")


def preferred_text(coded: Column) -> Column:
    """Text, even empty; else the first non-empty display; else the first code (ING-01)."""
    shown = F.get(F.filter(coded["coding"], lambda c: F.coalesce(c["display"], F.lit("")) != ""), F.lit(0))["display"]
    return F.coalesce(coded["text"], shown, F.get(coded["coding"], F.lit(0))["code"])


def parse_day(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def parse_time(text: Column) -> Column:
    """ISO-8601 without fractional seconds, else a day, else null (ING-06)."""
    full = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))
    return F.coalesce(full, parse_day(text).cast("timestamp"))


def _status(raw: Column, table: dict[str, str]) -> Column:
    known = F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.lower(raw))
    return F.coalesce(known, capitalized(raw))


def condition_status(raw: Column) -> Column:
    return _status(raw, CONDITION_STATUS)


def appointment_status(raw: Column) -> Column:
    return _status(raw, APPOINTMENT_STATUS)


def _provenance(base: str, as_of: str) -> list[Column]:
    return [F.lit("smart_fhir").alias("source_kind"), F.lit(base).alias("source_system_name"), F.col("id").alias("source_record_identifier"), F.lit(as_of).cast("timestamp").alias("source_last_synced_at"), F.lit(True).alias("source_of_truth")]


def patients(resources: DataFrame, base: str, as_of: str) -> DataFrame:
    """ING-02."""
    name, contact = F.get("name", F.lit(0)), F.get("contact", F.lit(0))
    identifier = F.get(F.filter("identifier", lambda i: F.coalesce(i["value"], F.lit("")) != ""), F.lit(0))
    given = F.coalesce(F.get(contact["name"]["given"], F.lit(0)), F.lit(""))
    family = F.coalesce(contact["name"]["family"], F.lit(""))
    phone = F.get(F.filter(contact["telecom"], lambda t: F.lower(t["system"]) == "phone"), F.lit(0))["value"]
    return resources.select(
        F.sha2(F.concat_ws("\x1f", F.lit(base), "id"), 256).alias("patient_id"), F.coalesce(identifier["value"], F.col("id")).alias("medical_record_number"), identifier["system"].alias("medical_record_number_system"),
        F.coalesce(F.get(name["given"], F.lit(0)), F.lit("Unknown")).alias("first_name"), F.coalesce(name["family"], F.lit("Patient")).alias("last_name"),
        F.coalesce(parse_day(F.col("birthDate")), F.lit("1970-01-01").cast("date")).alias("date_of_birth"), F.coalesce(capitalized(F.col("gender")), F.lit("Unknown")).alias("gender"),
        F.when((given != "") | (family != ""), F.trim(F.concat(given, F.lit(" "), family))).alias("emergency_contact_name"), phone.alias("emergency_contact_phone"), *_provenance(base, as_of),
    )


def records(resources: DataFrame, base: str, as_of: str, patient_id: str) -> DataFrame:
    """ING-03."""
    when = F.coalesce(parse_time(F.col("recordedDate")), parse_time(F.col("onsetDateTime")), F.lit(as_of).cast("timestamp"))
    status = F.coalesce(condition_status(preferred_text(F.col("clinicalStatus"))), F.lit("Final"))
    return resources.select(
        "position", F.concat(F.lit(base + "/"), F.col("id")).alias("record_id"), F.lit(patient_id).alias("patient_id"), when.alias("date_recorded"), F.coalesce(preferred_text(F.col("code")), F.lit("Condition")).alias("condition_name"),
        status.alias("status"), F.lit(False).alias("is_hidden_from_portal"), F.when(status == "Final", "signed").otherwise("reviewed").alias("documentation_status"), F.when(status == "Final", when).alias("documentation_signed_at"), *_provenance(base, as_of),
    )


def medications(resources: DataFrame, base: str, as_of: str, patient_id: str) -> DataFrame:
    """ING-04."""
    dosage = F.get("dosageInstruction", F.lit(0))
    return resources.select(
        "position", F.concat(F.lit(base + "/"), F.col("id")).alias("rx_id"), F.lit(patient_id).alias("patient_id"), F.coalesce(preferred_text(F.col("medicationCodeableConcept")), F.lit("Medication")).alias("medication_name"),
        F.coalesce(F.col("requester.display"), F.lit("Unknown clinician")).alias("written_by"), F.coalesce(parse_time(F.col("authoredOn")), F.lit(as_of).cast("timestamp")).alias("written_date"), F.coalesce(dosage["text"], F.lit("See SIG")).alias("quantity_info"),
        F.coalesce(F.col("dispenseRequest.numberOfRepeatsAllowed"), F.lit(0)).alias("refills"), preferred_text(dosage["route"]).alias("route"), capitalized(F.col("status")).alias("status"), *_provenance(base, as_of),
    )


def appointments(resources: DataFrame, base: str, as_of: str, patient_id: str, shift_to_as_of: bool = False) -> DataFrame:
    """ING-05; ``shift_to_as_of`` moves the day to that of ``as_of`` and keeps the time."""
    when = F.coalesce(parse_time(F.col("start")), F.lit(as_of).cast("timestamp"))
    if shift_to_as_of:
        when = F.timestamp_micros(F.unix_micros(F.date_trunc("day", F.lit(as_of).cast("timestamp"))) + F.unix_micros(when) - F.unix_micros(F.date_trunc("day", when)))
    display = F.get(F.array_compact(F.transform("participant", lambda p: p["actor"]["display"])), F.lit(0))
    return resources.select(
        "position", F.concat(F.lit(base + "/"), F.col("id")).alias("appointment_id"), F.lit(patient_id).alias("patient_id"), when.alias("scheduled_time"), F.coalesce("description", F.lit("Appointment")).alias("reason_for_visit"),
        F.coalesce(appointment_status(F.col("status")), F.lit("Scheduled")).alias("status"), display.alias("clinician_name"), *_provenance(base, as_of),
    )


def match_patients(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(incoming_id, stored_id) by source id and system, or by record number and its system (JON-06).

    Two equi-joins and a distinct instead of one join on an OR.  Rows without
    any source match one another; as no key tells them apart, the first two
    stored ones stand for all: one is a match, two make it ambiguous.
    """
    pick = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ("patient_id", "source_record_identifier", "source_system_name", "medical_record_number", "medical_record_number_system")])
    a, b = pick(stored, "s_"), pick(incoming, "i_")
    sourceless = lambda p: F.col(p + "source_record_identifier").isNull() & F.col(p + "source_system_name").isNull()
    first = a.where(sourceless("s_")).agg(F.min("s_patient_id").alias("one"), F.max("s_patient_id").alias("two"))
    first = first.select(F.explode(F.array_distinct(F.array_compact(F.array("one", "two")))).alias("s_patient_id"))  # two rows at most
    without = b.where(sourceless("i_")).join(F.broadcast(first))
    by_source = a.where(~sourceless("s_")).join(b.where(~sourceless("i_")), F.col("s_source_record_identifier").eqNullSafe(F.col("i_source_record_identifier")) & F.col("s_source_system_name").eqNullSafe(F.col("i_source_system_name")))
    number = (F.col("s_medical_record_number") == F.col("i_medical_record_number")) & (F.col("s_medical_record_number_system") == F.col("i_medical_record_number_system"))
    by_number = a.where("s_medical_record_number != '' and s_medical_record_number_system != ''").join(b, number)
    ids = [F.col("i_patient_id").alias("incoming_id"), F.col("s_patient_id").alias("stored_id")]
    return by_source.select(*ids).union(by_number.select(*ids)).union(without.select(*ids)).distinct()


def upsert_patients(stored: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged patients, ambiguous incoming ids): listed columns of a match are overwritten, others kept (ING-08)."""
    matches = match_patients(stored, incoming)
    ambiguous = matches.groupBy("incoming_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("incoming_id")
    usable = incoming.join(ambiguous, F.col("patient_id") == F.col("incoming_id"), "left_anti")
    single = matches.join(ambiguous, "incoming_id", "left_anti")
    matched = usable.join(single, F.col("patient_id") == F.col("incoming_id")).drop("patient_id", "incoming_id").withColumnRenamed("stored_id", "patient_id")
    merged = merge(stored, first_rows(matched, "patient_id", "source_record_identifier"), "patient_id", PATIENT_UPDATES, inserts=False)
    new = usable.join(single, F.col("patient_id") == F.col("incoming_id"), "left_anti")
    return merged.unionByName(new, allowMissingColumns=True).select(*stored.columns), ambiguous


def first_rows(feed: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in feed order (ING-09, JON-03)."""
    return feed.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def duplicates(feed: DataFrame, key: str) -> DataFrame:
    """Keys that a feed repeats: one warning for each further row."""
    return feed.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra")).where("extra > 0")


def merge(stored: DataFrame, incoming: DataFrame, key: str, updated: tuple, inserts: bool = True) -> DataFrame:
    """Keyed upsert: matched rows take the updated columns from the feed, unmatched ones are inserted."""
    names = [c for c in stored.columns if c != key]
    feed = incoming.select(F.col(key), *[F.col(c).alias("__in_" + c) for c in names if c in incoming.columns], F.lit(True).alias("__in"))
    joined = stored.withColumn("__old", F.lit(True)).join(feed, key, "full" if inserts else "left")

    def value(c):
        if "__in_" + c not in joined.columns:
            return F.col(c)
        take = F.col("__old").isNull() if c not in updated else F.col("__in").isNotNull()
        return F.when(take, F.col("__in_" + c)).otherwise(F.col(c)).alias(c)

    return joined.select(key, *[value(c) for c in names])


def sync(stored: DataFrame, feed: DataFrame, key: str, updated: tuple, order: str = "position") -> tuple[DataFrame, DataFrame]:
    """(merged, counts): one row of inserted, updated and duplicate counts; only inserts count as imported (ING-09)."""
    first = first_rows(feed, key, order)
    known = stored.select(key).distinct().withColumn("__known", F.lit(True))
    counts = first.join(known, key, "left").agg(F.count_if(F.col("__known").isNull()).alias("inserted"), F.count_if(F.col("__known").isNotNull()).alias("updated"))
    extra = duplicates(feed, key).agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicates"))
    return merge(stored, first, key, updated), counts.join(extra)


def merge_allergies(existing: Column, incoming: Column) -> Column:
    """Those that are missing are appended (SET-04)."""
    return F.concat(existing, F.array_except(F.array_distinct(F.array_compact(incoming)), existing))


def set_lifecycle(df: DataFrame, lifecycle: str, as_of: str, *signers: str) -> DataFrame:
    """Signed notes become final, stamped and signed by the first name that is set; others preliminary and cleared (ING-11)."""
    if lifecycle == "signed":
        name = F.coalesce(*[F.when(F.col(s) != "", F.col(s)) for s in signers], F.lit("Unknown clinician"))
        return df.withColumns({"documentation_status": F.lit("signed"), "status": F.lit("Final"), "documentation_signed_at": F.lit(as_of).cast("timestamp"), "provider_signature": name})
    return df.withColumns({"documentation_status": F.lit(lifecycle), "status": F.lit("Preliminary"), "documentation_signed_at": F.lit(None).cast("timestamp"), "provider_signature": F.lit(None).cast("string")})


def sync_notes(appointments: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """Records with the documentation status that today's appointment for the same condition implies (ING-12)."""
    start = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    end = start + F.expr("interval 1 day")
    level = F.when(F.col("status") == "Completed", "signed").when(F.col("status") == "Ready for Checkout", "reviewed").when(F.col("status") == "In Exam", "draft")
    wanted = appointments.where((F.col("scheduled_time") >= start) & (F.col("scheduled_time") < end)).select("patient_id", F.lower("reason_for_visit").alias("__c"), level.alias("__level"), "scheduled_time", "appointment_id").where("__level is not null")
    wanted = wanted.groupBy("patient_id", "__c").agg(F.max_by("__level", F.struct("scheduled_time", "appointment_id")).alias("__level"))
    today = (F.col("date_recorded") >= start) & (F.col("date_recorded") < end)
    joined = records.withColumn("__c", F.lower("condition_name")).join(wanted, ["patient_id", "__c"], "left")
    return joined.withColumn("documentation_status", F.when(today & F.col("__level").isNotNull(), F.col("__level")).otherwise(F.col("documentation_status"))).select(*records.columns)
