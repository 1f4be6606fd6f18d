"""Schemas of the entities, chunks, hits and evaluation rows.

Timestamps are UTC.  A null and an empty string are different values.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_PROVENANCE = "source_kind string, source_system_name string, source_record_identifier string, source_last_synced_at timestamp, source_of_truth boolean"

DDL = {
    "patient": "patient_id string, medical_record_number string, medical_record_number_system string, first_name string, last_name string, date_of_birth date, gender string, is_smoker boolean, "
    "primary_clinician string, preferred_pharmacy string, care_plan_summary string, allergies array<string>, risk_flags array<string>, emergency_contact_name string, emergency_contact_phone string, blood_type string, " + _PROVENANCE,
    "record": "record_id string, patient_id string, date_recorded timestamp, condition_name string, status string, is_hidden_from_portal boolean, visit_type string, severity string, cc_hpi string, review_of_systems string, "
    "exam_findings string, impressions_and_plan string, affected_anatomical_zones array<string>, provider_signature string, patient_instructions string, follow_up_plan string, recommended_orders array<string>, "
    "care_plan_summary string, icd10_code string, clinical_photo_paths array<string>, documentation_status string, documentation_signed_at timestamp, " + _PROVENANCE,
    "medication": "rx_id string, patient_id string, medication_name string, written_by string, written_date timestamp, quantity_info string, refills int, generic_name string, dose string, route string, frequency string, "
    "indication string, status string, start_date timestamp, last_filled_date timestamp, next_refill_eligible_date timestamp, pharmacy_name string, safety_notes array<string>, " + _PROVENANCE,
    "appointment": "appointment_id string, patient_id string, scheduled_time timestamp, reason_for_visit string, status string, encounter_type string, clinician_name string, location string, duration_minutes int, "
    "check_in_status string, prep_instructions string, linked_diagnoses array<string>, " + _PROVENANCE,
    "photo": "photo_id string, patient_id string, capture_date timestamp, anatomical_region string, notes string, file_path string, linked_record_id string, " + _PROVENANCE,
    "chunk": "chunk_id string, patient_id string, content string, contextual_prefix string, chunk_index int, source_type string, section_title string, date_recorded timestamp, clinical_category string, patient_name string, word_count int",
    "embedding": "chunk_id string, embedding array<float>",
    "eval_case": "id string, query string, expectedAnswer string, category string, groundTruthChunkIds array<string>, expectedCitations array<string>, shouldAbstain boolean, containerId string, qualityMode string, tags array<string>, notes string",
    "eval_result": "id string, query string, generated_response string, answer_match boolean, retrieval_recall double, citation_precision double, abstention_correct boolean, latency_seconds double, tokens_generated int, "
    "quality_mode_used string, context_overflow boolean, used_visual_evidence boolean, warnings array<string>, timestamp timestamp",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def conform(df, name: str):
    """``df`` with exactly the columns of a schema: missing ones null, others cast, extra ones dropped."""
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(name)])
