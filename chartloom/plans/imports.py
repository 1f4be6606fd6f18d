"""Import of one patient's resources into stored entities (ING-10)."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators import ingest
from chartloom.operators.labels import full_name

MEDICATION_UPDATES = ("medication_name", "written_by", "written_date", "quantity_info", "refills", "route", "status", "source_kind", "source_system_name", "source_record_identifier", "source_last_synced_at", "source_of_truth", "patient_id")
APPOINTMENT_UPDATES = ("scheduled_time", "reason_for_visit", "status", "clinician_name", "source_kind", "source_system_name", "source_record_identifier", "source_last_synced_at", "source_of_truth", "patient_id")


def import_patient(stored: dict[str, DataFrame], resources: dict[str, DataFrame], base: str, as_of: str) -> tuple[dict[str, DataFrame], dict]:
    """(entities after the import, summary).

    ``stored`` has patient, record, medication and appointment; ``resources``
    has one frame per resource type.  A missing or ambiguous patient is fatal;
    a missing or unreadable child type imports nothing and is a warning.
    """
    adapted = ingest.patients(resources["Patient"], base, as_of)
    if adapted.isEmpty():
        raise ValueError("the patient resource is missing")
    merged, ambiguous = ingest.upsert_patients(stored["patient"], adapted)
    if not ambiguous.isEmpty():
        raise ValueError("several stored patients match the incoming one")
    matches = ingest.match_patients(stored["patient"], adapted)
    row = adapted.join(matches, F.col("patient_id") == F.col("incoming_id"), "left").select(F.coalesce("stored_id", "patient_id").alias("id"), F.col("stored_id").isNull().alias("created"), full_name().alias("name")).first()
    out, counts, warnings = {"patient": merged}, {}, []
    for entity, kind, key, adapt, updates in (
        ("record", "Condition", "record_id", ingest.records, ingest.CONDITION_UPDATES),
        ("medication", "MedicationRequest", "rx_id", ingest.medications, MEDICATION_UPDATES),
        ("appointment", "Appointment", "appointment_id", ingest.appointments, APPOINTMENT_UPDATES),
    ):
        if kind not in resources:
            out[entity], counts[entity] = stored[entity], 0
            warnings.append(f"{kind}: no resources")
            continue
        try:
            merged_rows, n = ingest.sync(stored[entity], adapt(resources[kind], base, as_of, row["id"]), key, updates)
            n = n.first()
        except PySparkException as e:  # a feed that cannot be read or has another shape
            out[entity], counts[entity] = stored[entity], 0
            warnings.append(f"{kind}: {type(e).__name__}")
            continue
        out[entity] = merged_rows
        counts[entity] = n["inserted"]
        if n["duplicates"]:
            warnings.append(f"{kind}: {n['duplicates']} repeated ids")
    if "AllergyIntolerance" in resources:
        found = resources["AllergyIntolerance"].select(ingest.preferred_text(F.col("code")).alias("a"), "position").where("a is not null")
        listed = found.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "a"))), lambda x: x["a"]).alias("__new"))
        merged = merged.join(listed).withColumn("allergies", F.when(F.col("patient_id") == row["id"], ingest.merge_allergies(F.coalesce("allergies", F.array().cast("array<string>")), F.col("__new"))).otherwise(F.col("allergies"))).drop("__new")
        out["patient"] = merged
    return out, {"patient_name": row["name"], "patient_id": row["id"], "created": row["created"], "counts": counts, "warnings": warnings}
