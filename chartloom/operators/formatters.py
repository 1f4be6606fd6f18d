"""One-line summaries of chart rows (PRJ-13); optional parts appear only where set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartloom.operators.labels import age, full_name

DATE, TIME = "MMM d, yyyy", "MMM d, yyyy 'at' h:mm a"


def optional(label: str, value: Column, keep_empty: bool = True) -> Column:
    """``label`` and the value, or null."""
    return F.when(value.isNotNull() if keep_empty else F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def joined(values: Column, sep: str) -> Column:
    """A non-empty array as text, else null."""
    return F.when(F.size(values) > 0, F.array_join(values, sep))


def column(df_columns, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df_columns else F.lit(None).cast(kind)


def patient_summary(columns, as_of: Column) -> Column:
    c = lambda n, k="string": column(columns, n, k)
    lists = lambda n: F.coalesce(joined(F.col(n), ", "), F.lit("None documented"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Patient: "), full_name()),
        F.concat(F.lit("MRN: "), F.col("medical_record_number")),
        F.concat(F.lit("Age/Sex: "), age(F.col("date_of_birth"), as_of), F.lit(" / "), F.col("gender")),
        F.concat(F.lit("Smoking: "), F.when(F.col("is_smoker"), "Current smoker").otherwise("Non-smoker")),
        F.concat(F.lit("Primary clinician: "), F.coalesce(c("primary_clinician"), F.lit("Not assigned"))),
        F.concat(F.lit("Preferred pharmacy: "), F.coalesce(c("preferred_pharmacy"), F.lit("Not documented"))),
        F.concat(F.lit("Allergies: "), lists("allergies")),
        F.concat(F.lit("Risk flags: "), lists("risk_flags")),
        F.concat(F.lit("Blood type: "), F.coalesce(c("blood_type"), F.lit("Not documented"))),
        F.concat(F.lit("Care plan summary: "), F.coalesce(c("care_plan_summary"), F.lit("No care plan summary documented"))),
    )


def medication_line(columns) -> Column:
    c = lambda n, k="string": column(columns, n, k)
    day = lambda n: F.date_format(c(n, "timestamp"), DATE)
    return F.concat_ws(
        " | ",
        F.concat_ws(" ", F.col("medication_name"), F.when(F.coalesce(c("dose"), F.lit("")) != "", c("dose"))),
        F.coalesce(c("route"), F.lit("Unspecified")),
        F.coalesce(c("frequency"), F.lit("See instructions")),
        F.concat(F.lit("Status: "), F.coalesce(c("status"), F.lit("Active"))),
        optional("Indication: ", c("indication")),
        optional("Pharmacy: ", c("pharmacy_name")),
        optional("Last filled: ", day("last_filled_date")),
        optional("Refill eligible: ", day("next_refill_eligible_date")),
        optional("Safety: ", joined(c("safety_notes", "array<string>"), "; ")),
    )


def record_line(columns) -> Column:
    c = lambda n, k="string": column(columns, n, k)
    head = F.concat(F.date_format("date_recorded", DATE), F.lit(": "), F.col("condition_name"), F.lit(" ["), F.col("status"), F.lit("]"))
    return F.concat_ws(" | ", head, optional("Visit: ", c("visit_type")), optional("Severity: ", c("severity")), optional("Follow-up: ", c("follow_up_plan")))


def appointment_line(columns) -> Column:
    c = lambda n, k="string": column(columns, n, k)
    head = F.concat(F.date_format("scheduled_time", TIME), F.lit(": "), F.col("reason_for_visit"))
    return F.concat_ws(
        " | ", head, c("encounter_type"), optional("Clinician: ", c("clinician_name")), optional("Location: ", c("location")), optional("Check-in: ", c("check_in_status")),
        optional("Diagnoses: ", joined(c("linked_diagnoses", "array<string>"), ", ")),
    )


def answer(text: Column, facts: Column, actions: Column) -> Column:
    """An answer with its support and next actions, where there are any."""
    return F.concat_ws("\n\n", text, optional("Support:\n- ", joined(facts, "\n- ")), optional("Next actions:\n- ", joined(actions, "\n- ")))
