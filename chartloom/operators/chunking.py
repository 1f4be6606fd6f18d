"""Charts to chunks: profile, note sections, medications, appointments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions.text import space_words, trim_all
from chartloom.operators.batching import pack
from chartloom.operators.complexity import analyze
from chartloom.operators.formatters import DATE, TIME, column, joined, optional
from chartloom.operators.labels import age, full_name

#: Note sections in order (column, title, category).
SECTIONS = (
    ("cc_hpi", "Chief Complaint & HPI", "chiefComplaint"),
    ("review_of_systems", "Review of Systems", "reviewOfSystems"),
    ("exam_findings", "Examination Findings", "examFindings"),
    ("impressions_and_plan", "Assessment & Plan", "assessmentAndPlan"),
    ("patient_instructions", "Patient Instructions", "patientInstructions"),
    ("follow_up_plan", "Follow-Up Plan", "followUp"),
    ("recommended_orders", "Recommended Orders", "orders"),
    ("care_plan_summary", "Care Plan Summary", "carePlan"),
    ("zones", "Anatomical Zones", "examFindings"),
)
COLUMNS = ["chunk_id", "patient_id", "content", "contextual_prefix", "chunk_index", "source_type", "section_title", "date_recorded", "clinical_category", "patient_name", "word_count"]


def _finish(df: DataFrame) -> DataFrame:
    key = F.sha2(F.concat_ws("\x1f", "patient_id", "source_type", "source_id", "section_title", F.col("chunk_index").cast("string")), 256)
    return df.withColumn("chunk_id", key).select(*COLUMNS)


def _bracketed(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit("["), p, F.lit("]")) for p in parts])


def split_words(df: DataFrame, text: str = "content", limit: str = "chunk_words") -> DataFrame:
    """Trimmed texts, whole up to the limit, else in windows of so many words; empty ones go (CHK-03).

    Adds ``part`` (from 0) and ``word_count``; words are cut at single spaces.
    """
    words = space_words(F.col(text))
    n = F.size("__w")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.col(limit))
    pieces = F.transform(starts, lambda s: F.slice("__w", s + 1, F.col(limit)))
    whole = F.array(F.struct(F.col(text).alias("c"), n.alias("n")))
    parts = F.when(n <= F.col(limit), whole).otherwise(F.transform(pieces, lambda p: F.struct(F.array_join(p, " ").alias("c"), F.size(p).alias("n"))))
    kept = df.withColumn(text, trim_all(F.col(text))).where(F.col(text) != "").withColumn("__w", words)
    out = kept.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("part", "__p"))
    return out.select("*", F.col("__p.c").alias(text), F.col("__p.n").alias("word_count")).drop("__p")


def patient_chunks(patients: DataFrame, as_of: str) -> DataFrame:
    """One chunk a patient (CHK-01)."""
    c = lambda n: column(patients.columns, n)
    name, title = full_name(), "Demographics & Risk Profile"
    contact = F.when(c("emergency_contact_name").isNotNull(), F.concat(F.lit("Emergency contact: "), c("emergency_contact_name"), F.lit(" "), F.coalesce(c("emergency_contact_phone"), F.lit(""))))
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("Patient: "), name, F.lit(", "), age(F.col("date_of_birth"), F.lit(as_of).cast("timestamp")), F.lit(" y/o "), F.col("gender")),
        F.concat(F.lit("MRN: "), F.col("medical_record_number")),
        F.when(F.col("is_smoker"), F.lit("Smoking status: Current smoker")),
        optional("Primary clinician: ", c("primary_clinician")),
        optional("Preferred pharmacy: ", c("preferred_pharmacy")),
        optional("Blood type: ", c("blood_type")),
        optional("Allergies: ", joined(F.col("allergies"), ", ")),
        optional("Risk flags: ", joined(F.col("risk_flags"), ", ")),
        contact,
        optional("Care plan: ", c("care_plan_summary"), keep_empty=False),
    )
    out = patients.select(
        "patient_id", F.col("patient_id").alias("source_id"), content.alias("content"), _bracketed(name, F.lit(title)).alias("contextual_prefix"), F.lit(0).alias("chunk_index"), F.lit("patientProfile").alias("source_type"),
        F.lit(title).alias("section_title"), F.lit(None).cast("timestamp").alias("date_recorded"), F.lit("demographics").alias("clinical_category"), name.alias("patient_name"),
    )
    return _finish(out.withColumn("word_count", F.size(space_words(F.col("content")))))


def record_chunks(records: DataFrame, patients: DataFrame) -> DataFrame:
    """A chunk for every section that is set, in order, long ones split (CHK-02, CHK-07)."""
    c = lambda n, k="string": column(records.columns, n, k)
    head = F.concat(F.col("condition_name"), F.lit(" — "), F.col("status"), F.coalesce(F.concat(F.lit(" | Severity: "), c("severity")), F.lit("")), F.coalesce(F.concat(F.lit(" | Visit: "), c("visit_type")), F.lit("")))
    text = {"recommended_orders": joined(c("recommended_orders", "array<string>"), "\n"), "zones": optional("Affected zones: ", joined(c("zones", "array<string>"), ", "))}
    one = lambda value, title, category: F.when(value.isNotNull(), F.struct(value.alias("content"), F.lit(title).alias("section_title"), F.lit(category).alias("clinical_category")))
    sections = F.array_compact(F.array(one(head, "Condition", "fullRecord"), *[one(text.get(n, c(n)), title, category) for n, title, category in SECTIONS]))
    named = records.join(patients.select("patient_id", full_name().alias("patient_name")), "patient_id")
    rows = named.select("patient_id", "patient_name", "date_recorded", F.col("record_id").alias("source_id"), F.posexplode(sections).alias("section", "s")).select("*", "s.*").drop("s")
    sized = analyze(rows.withColumn("content", trim_all(F.col("content"))), "content")
    parts = split_words(sized.select(*rows.columns, "chunk_words"))
    # The running index counts earlier parts of the same record.
    index = F.row_number().over(Window.partitionBy("source_id").orderBy("section", "part")) - 1
    prefix = _bracketed(F.col("patient_name"), F.date_format("date_recorded", DATE), F.col("section_title"))
    return _finish(parts.withColumns({"chunk_index": index, "contextual_prefix": prefix, "source_type": F.lit("clinicalRecord")}))


def medication_line(columns) -> Column:
    c = lambda n, k="string": column(columns, n, k)
    return F.concat_ws(
        " | ", F.concat_ws(" ", F.col("medication_name"), c("dose"), c("route"), c("frequency")), F.concat(F.lit("Status: "), F.coalesce(c("status"), F.lit("Active"))), optional("For: ", c("indication")),
        optional("Safety: ", joined(c("safety_notes", "array<string>"), "; ")), optional("Rx from ", c("pharmacy_name")),
    )


def medication_chunks(medications: DataFrame, patients: DataFrame) -> DataFrame:
    """Lines newest first, in one chunk or greedily packed ones (CHK-04); dated by the latest."""
    grouped = medications.groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct("written_date", "rx_id", medication_line(medications.columns).alias("line"))), asc=False).alias("m"))
    rows = grouped.join(patients.select("patient_id", full_name().alias("patient_name")), "patient_id")
    rows = rows.select("patient_id", "patient_name", F.get("m", F.lit(0))["written_date"].alias("date_recorded"), F.transform("m", lambda x: x["line"]).alias("lines"))
    rows = analyze(rows.withColumn("content", F.array_join("lines", "\n")), "content")
    sizes = F.transform("lines", lambda x: F.size(space_words(x)))
    total = F.size(space_words(F.col("content")))
    rows = rows.withColumn("__sizes", sizes)
    runs = F.when(total <= F.col("chunk_words"), F.array(F.struct(F.lit(0).alias("first"), F.size("lines").alias("n"), total.alias("total")))).otherwise(pack(F.col("__sizes"), F.col("chunk_words")))
    out = rows.select("patient_id", "patient_name", "date_recorded", "lines", F.posexplode(runs).alias("chunk_index", "r"))
    out = out.select(
        "patient_id", "patient_name", "date_recorded", "chunk_index", F.array_join(F.slice("lines", F.col("r.first") + 1, F.col("r.n")), "\n").alias("content"), F.col("r.total").alias("word_count"), F.col("patient_id").alias("source_id"),
        F.lit("medication").alias("source_type"), F.lit("Medications").alias("section_title"), F.lit("medication").alias("clinical_category"), _bracketed(F.col("patient_name"), F.lit("Medications")).alias("contextual_prefix"),
    )
    return _finish(out)


def appointment_chunks(appointments: DataFrame, patients: DataFrame) -> DataFrame:
    """All appointments of a patient, earliest first, in exactly one chunk (CHK-05)."""
    c = lambda n, k="string": column(appointments.columns, n, k)
    head = F.concat(F.date_format("scheduled_time", TIME), F.lit(": "), F.col("reason_for_visit"), F.lit(" ["), F.col("status"), F.lit("]"))
    line = F.concat_ws(" | ", head, c("encounter_type"), optional("Dr. ", c("clinician_name")), c("location"), optional("Prep: ", c("prep_instructions")), optional("Dx: ", joined(c("linked_diagnoses", "array<string>"), ", ")))
    grouped = appointments.groupBy("patient_id").agg(F.array_sort(F.collect_list(F.struct("scheduled_time", "appointment_id", line.alias("line")))).alias("a"))
    rows = grouped.join(patients.select("patient_id", full_name().alias("patient_name")), "patient_id")
    rows = rows.withColumn("content", F.array_join(F.transform("a", lambda x: x["line"]), "\n"))
    out = rows.select(
        "patient_id", "patient_name", "content", F.get("a", F.lit(0))["scheduled_time"].alias("date_recorded"), F.lit(0).alias("chunk_index"), F.size(space_words(F.col("content"))).alias("word_count"), F.col("patient_id").alias("source_id"),
        F.lit("appointment").alias("source_type"), F.lit("Appointments").alias("section_title"), F.lit("appointment").alias("clinical_category"), _bracketed(F.col("patient_name"), F.lit("Appointments")).alias("contextual_prefix"),
    )
    return _finish(out)


def all_chunks(patients: DataFrame, records: DataFrame, medications: DataFrame, appointments: DataFrame, as_of: str) -> DataFrame:
    """Every chunk of every patient (CHK-06)."""
    out = patient_chunks(patients, as_of)
    for more in (record_chunks(records, patients), medication_chunks(medications, patients), appointment_chunks(appointments, patients)):
        out = out.unionByName(more)
    return out
