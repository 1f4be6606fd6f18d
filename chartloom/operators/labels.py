"""Names, labels and statuses derived from chart columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions.text import capitalized, trim_all

#: Region key and display name.
REGIONS = {
    "scalp": "Scalp",
    "facial_mesh_nose": "Nose",
    "left_cheek": "Left Cheek",
    "right_cheek": "Right Cheek",
    "forehead": "Forehead",
    "chin": "Chin",
    "lips": "Lips",
    "left_ear": "Left Ear",
    "right_ear": "Right Ear",
    "neck": "Neck",
    "torso": "Torso",
    "left_shoulder": "Left Shoulder",
    "right_shoulder": "Right Shoulder",
    "right_upper_extremity": "Right Upper Extremity",
    "left_upper_extremity": "Left Upper Extremity",
    "left_hand": "Left Hand",
    "right_hand": "Right Hand",
    "upper_abdomen": "Upper Abdomen",
    "skull": "Skull",
    "mandible": "Mandible",
    "cervical_spine": "Cervical Spine",
    "ribcage": "Rib Cage",
    "facial_muscles": "Facial Muscles",
    "neck_muscles": "Neck Muscles",
    "chest_muscles": "Pectoral Muscles",
    "left_deltoid": "Left Deltoid",
    "right_deltoid": "Right Deltoid",
    "lower_back": "Lower Back",
    "left_lower_extremity": "Left Lower Extremity",
    "right_lower_extremity": "Right Lower Extremity",
    "left_foot": "Left Foot",
    "right_foot": "Right Foot",
}
#: Statuses that may still be overridden, label by status, pill by status, order of the workflow.
OPEN_STATUSES = ("scheduled", "confirmed", "pending", "booked", "arrived", "checked-in", "checked in")
STATUS_LABELS = (
    (("proposed", "pending"), "Pending"),
    (("booked", "scheduled"), "Scheduled"),
    (("arrived", "checked-in", "checked in"), "Arrived"),
    (("fulfilled", "completed"), "Completed"),
    (("noshow", "no-show"), "No Show"),
    (("cancelled", "canceled"), "Cancelled"),
    (("ready for checkout", "readyforcheckout"), "Checkout"),
    (("in exam", "inexam"), "Exam"),
    (("waiting triage", "waiting-triage", "waitingtriage"), "Triage"),
    (("roomed",), "Roomed"),
)
PILLS = {"Completed": "Done", "Ready for Checkout": "Checkout", "In Exam": "Exam", "Waiting triage": "Triage", "Checked In": "Check-In", "Confirmed": "Confirm"}
PROGRESSION = ("Scheduled", "Confirmed", "Checked In", "Waiting triage", "Roomed", "In Exam", "Ready for Checkout", "Completed")
SOURCE_KINDS = {"manual_entry": "Manual entry", "smart_fhir": "Connected record", "demo_seed": "Demo data", "generated": "Generated"}


def full_name(first: Column = None, last: Column = None) -> Column:
    return F.concat(F.col("first_name") if first is None else first, F.lit(" "), F.col("last_name") if last is None else last)


def age(birth: Column, as_of: Column) -> Column:
    """Whole calendar years (PRJ-02)."""
    return F.floor(F.months_between(as_of, birth) / 12).cast("int")


def region_name(key: Column) -> Column:
    """The region's display name; unknown, blank and other-case keys unchanged (PRJ-03)."""
    names = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, key), key)


def regions(spark: SparkSession) -> DataFrame:
    """The region dimension, by label (PRJ-04)."""
    return spark.createDataFrame(list(REGIONS.items()), "region string, label string").orderBy("label", "region")


def status_label(status: Column) -> Column:
    """Normalised workflow label; unknown ones capitalised, empty ones "Unknown" (PRJ-06)."""
    key = F.lower(trim_all(status))
    out = F.when(status == "", "Unknown").otherwise(capitalized(status))
    for names, label in reversed(STATUS_LABELS):
        out = F.when(key.isin(*names), label).otherwise(out)
    return out


def pill(status: Column) -> Column:
    """Short label (PRJ-07)."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PILLS.items() for x in p]), status), status)


def next_status(status: Column) -> Column:
    steps = F.array(*[F.lit(s) for s in PROGRESSION])
    at = F.array_position(steps, status)
    return F.when(at > 0, F.get(steps, at.cast("int")))


def previous_status(status: Column) -> Column:
    steps = F.array(*[F.lit(s) for s in PROGRESSION])
    at = F.array_position(steps, status)
    return F.when(at > 1, F.get(steps, (at - 2).cast("int")))


def source_kind(kind: Column) -> Column:
    """Unknown and missing kinds are manual entries (PRJ-08)."""
    return F.when(kind.isin(*SOURCE_KINDS), kind).otherwise(F.lit("manual_entry"))


def source_label(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in SOURCE_KINDS.items() for x in p]), source_kind(kind))


def one_source_or_mixed(df: DataFrame, by: str, kind: str = "source_kind") -> DataFrame:
    """The single source kind of each group, or "mixed" (PRJ-09)."""
    return df.groupBy(by).agg(F.when(F.count_distinct(kind) == 1, F.min(kind)).otherwise(F.lit("mixed")).alias("source_kind"))


def resolved_status(appointments: DataFrame, records: DataFrame, as_of: str) -> DataFrame:
    """Adds ``resolved_status`` at a time (PRJ-05).

    A status outside the open ones stays.  Otherwise today's latest note
    decides, then whether today's appointment is past; else the status stays.
    """
    now = F.lit(as_of).cast("timestamp")
    start = F.date_trunc("day", now)
    end = start + F.expr("interval 1 day")
    notes = records.where((F.col("date_recorded") >= start) & (F.col("date_recorded") < end))
    notes = notes.groupBy("patient_id").agg(F.max_by("documentation_status", F.struct("date_recorded", "record_id")).alias("__note"))
    note = F.lower(F.col("__note"))
    from_note = F.when(note == "signed", "Completed").when(note == "reviewed", "Ready for Checkout").when(note == "draft", "In Exam")
    past = (F.col("scheduled_time") >= start) & (F.col("scheduled_time") < F.least(now, end))
    waited = F.when(F.unix_micros(now) - F.unix_micros(F.col("scheduled_time").cast("timestamp")) < 900_000_000, "Checked In").otherwise("Waiting triage")
    status = F.when(~F.lower("status").isin(*OPEN_STATUSES), F.col("status")).otherwise(F.coalesce(from_note, F.when(past, waited), F.col("status")))
    return appointments.join(notes, "patient_id", "left").withColumn("resolved_status", status).drop("__note")
