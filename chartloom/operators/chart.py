"""Chart and panel queries: searches, alerts, groupings, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.functions.text import any_contains, fold_accents, search_tokens, trim_all
from chartloom.operators.labels import REGIONS, full_name

#: Fixed values: (keywords, code prefixes, exact codes, titles); the last title stands alone where no rule fits.
EDUCATION_RULES = (
    (("basal cell", "bcc"), ("C44",), (), ("Basal Cell Carcinoma", "Sun Protection Guide")),
    (("melanoma",), ("D03", "C43"), (), ("Melanoma Awareness", "Post-Excision Care", "Skin Self-Exam Guide")),
    (("dysplastic nevus", "atypical"), ("D22",), (), ("Atypical Moles", "Monthly Self-Exam")),
    (("actinic",), (), ("L57.0",), ("Actinic Keratosis", "Cryotherapy Aftercare")),
    (("acne",), ("L70",), (), ("Acne Treatment Guide", "Tretinoin Counseling")),
    (("rosacea",), ("L71",), (), ("Rosacea Triggers", "Rosacea Treatment")),
    (("eczema", "atopic dermatitis"), ("L20",), (), ("Eczema Management", "Steroid Application", "Dupixent Patient Guide")),
    (("contact dermatitis",), ("L23", "L24"), (), ("Contact Dermatitis", "Nickel Allergy")),
    (("psoriasis",), ("L40",), (), ("Psoriasis Overview", "Methotrexate Guide", "Psoriatic Arthritis")),
    (("verruca", "wart"), ("B07",), (), ("Wart Treatment", "HPV Prevention")),
)
EDUCATION_FALLBACK = "Skin Health Basics"
#: Fixed values: (title, medication name parts); risk allergies; cancer words; note profiles in order (name, dictation words, known-condition words).
MEDICATION_ALERTS = (("Methotrexate Monitoring", ("methotrexate",)), ("Biologic Therapy", ("dupixent", "dupilumab")), ("TNF Inhibitor", ("humira", "adalimumab")))
RISK_ALLERGIES = ("penicillin", "sulfa", "latex", "nsaid")
CANCER_WORDS = ("melanoma", "carcinoma")
NOTE_PROFILES = (
    ("Pigmented Lesion Under Melanoma Evaluation", ("melanoma",), ("melanoma",)),
    ("Plaque Psoriasis", ("psoriasis", "plaque"), ("psoriasis",)),
    ("Eczematous Dermatitis", ("eczema", "dermatitis"), ("dermatitis",)),
    ("Rosacea", ("rosacea", "flushing"), ("rosacea",)),
    ("Verruca Vulgaris", ("wart", "verruca"), ()),
    ("Basal Cell Carcinoma", ("basal cell", "bcc"), ("basal cell",)),
)
DEFAULT_PROFILE = "Dermatologic Evaluation"


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows with the needle in any column, ignoring case; null columns never match, an empty needle matches all (FLT-01..06)."""
    if not needle:
        return df
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return df.where(hit)


def is_active(status: Column) -> Column:
    """A missing status counts as active (FLT-07)."""
    return F.coalesce(status, F.lit("Active")) == "Active"


def on_day(ts: Column, as_of: str) -> Column:
    """A half-open range, so that the predicate reaches the scan (FLT-08)."""
    start = F.date_trunc("day", F.lit(as_of).cast("timestamp"))
    return (ts >= start) & (ts < start + F.expr("interval 1 day"))


def next_appointment(appointments: DataFrame, as_of: str | None, inclusive: bool = True) -> DataFrame:
    """The earliest appointment of each patient at or after, after, or regardless of a time (FLT-09)."""
    if as_of is not None:
        now = F.lit(as_of).cast("timestamp")
        appointments = appointments.where(F.col("scheduled_time") >= now if inclusive else F.col("scheduled_time") > now)
    first = F.min_by(F.struct("appointment_id", "scheduled_time", "reason_for_visit"), F.struct("scheduled_time", "appointment_id"))
    return appointments.groupBy("patient_id").agg(first.alias("x")).select("patient_id", "x.*")


def token_search(records: DataFrame, query: str, columns=("condition_name", "cc_hpi", "impressions_and_plan", "visit_type", "care_plan_summary")) -> DataFrame:
    """Records whose joined fields hold any query token over two characters (FLT-11)."""
    columns = [c for c in columns if c in records.columns]
    haystack = F.lower(F.concat_ws(" ", *columns))
    return records.where(F.exists(search_tokens(F.lit(query)), lambda t: haystack.contains(t)))


def risk_entries(patients: DataFrame) -> DataFrame:
    """Patients with an allergy, a flag or smoking, one line each (FLT-14)."""
    parts = F.array_compact(
        F.array(
            F.when(F.size("allergies") > 0, F.concat(F.lit("Allergies: "), F.array_join("allergies", ", "))),
            F.when(F.size("risk_flags") > 0, F.concat(F.lit("Risk: "), F.array_join("risk_flags", ", "))),
            F.when(F.col("is_smoker"), F.lit("Current smoker")),
        )
    )
    return patients.where(F.size(parts) > 0).select("patient_id", F.concat(F.lit("["), full_name(), F.lit("] "), F.array_join(parts, " | ")).alias("line"))


def education_links(conditions: DataFrame, name: str = "condition_name", code: str = "icd10_code") -> DataFrame:
    """One row per link: every rule whose keyword or code fits, in rule order, or the fallback alone (PRJ-10)."""
    text, icd = F.lower(name), F.col(code)
    links = []
    for words, prefixes, exact, titles in EDUCATION_RULES:
        fits = any_contains(text, words)
        for p in prefixes:
            fits = fits | F.coalesce(icd.startswith(p), F.lit(False))
        for e in exact:
            fits = fits | F.coalesce(icd == e, F.lit(False))
        links.append(F.when(fits, F.array(*[F.lit(t) for t in titles])).otherwise(F.array().cast("array<string>")))
    found = F.concat(*links)
    return conditions.withColumn("__links", found).select(*conditions.columns, F.posexplode(F.when(F.size("__links") > 0, F.col("__links")).otherwise(F.array(F.lit(EDUCATION_FALLBACK)))).alias("position", "title"))


def alerts(patients: DataFrame, medications: DataFrame, records: DataFrame) -> DataFrame:
    """One row per alert, in display order (PRJ-11)."""
    name = F.lower("medication_name")
    flags = [F.coalesce(F.bool_or(any_contains(name, words)), F.lit(False)).alias(f"__m{i}") for i, (_, words) in enumerate(MEDICATION_ALERTS)]
    meds = medications.groupBy("patient_id").agg(*flags)
    cancer = records.groupBy("patient_id").agg(F.bool_or(any_contains(F.lower("condition_name"), CANCER_WORDS)).alias("__cancer"))
    allergies = F.filter("allergies", lambda a: any_contains(F.lower(a), RISK_ALLERGIES))

    def one(when, title, message=F.lit("")):
        return F.when(when, F.struct(F.lit(title).alias("title"), message.alias("message")))

    rows = [one(F.col(f"__m{i}"), title) for i, (title, _) in enumerate(MEDICATION_ALERTS)]
    rows += [
        one(F.col("is_smoker") & F.coalesce("__cancer", F.lit(False)), "High-Risk Patient"),
        one(F.col("is_smoker") & ~F.coalesce("__cancer", F.lit(False)), "Smoking Status"),
        one(F.size(allergies) > 0, "Allergy Alert", F.array_join(allergies, ", ")),
        one(F.size("risk_flags") > 0, "Risk Flags", F.array_join("risk_flags", " • ")),
    ]
    joined = patients.join(meds, "patient_id", "left").join(cancer, "patient_id", "left")
    return joined.select("patient_id", F.posexplode(F.array_compact(F.array(*rows))).alias("position", "a")).select("patient_id", "position", "a.*")


def workflow(patients: DataFrame, records: DataFrame, medications: DataFrame, appointments: DataFrame, as_of: str, reconciled: DataFrame | None = None) -> DataFrame:
    """The four checklist steps of each patient (PRJ-12)."""
    latest = records.groupBy("patient_id").agg(F.max_by(F.struct(*[c for c in ("condition_name", "documentation_status", "patient_instructions") if c in records.columns]), F.struct("date_recorded", "record_id")).alias("__r"))
    active = medications.where(is_active(F.col("status"))).groupBy("patient_id").agg(F.count(F.lit(1)).alias("active"))
    done = reconciled.groupBy("patient_id").agg(F.count_distinct("rx_id").alias("reconciled")) if reconciled is not None else None
    out = patients.select("patient_id").join(latest, "patient_id", "left").join(active, "patient_id", "left").join(next_appointment(appointments, as_of), "patient_id", "left")
    out = out.join(done, "patient_id", "left") if done is not None else out.withColumn("reconciled", F.lit(0))
    n, k = F.coalesce("active", F.lit(0)), F.coalesce("reconciled", F.lit(0))
    has_text = F.coalesce(F.col("__r.patient_instructions") != "", F.lit(False)) if "patient_instructions" in records.columns else F.lit(False)
    return out.select(
        "patient_id", F.col("__r").isNotNull().alias("note_reviewed"), (n.eqNullSafe(0) | (k >= n)).alias("meds_reconciled"), has_text.alias("instructions_ready"),
        F.col("appointment_id").isNotNull().alias("follow_up_booked"), n.cast("bigint").alias("active_meds"),
    )


def infer_zones(df: DataFrame, text: str, selected: str | None = None) -> DataFrame:
    """Adds ``inferred_zones``: regions whose key or label occurs in the text, and the selected one, sorted (PRJ-15)."""
    found = [F.when(F.col(text).contains(k.replace("_", " ")) | F.col(text).contains(v.lower()), F.lit(k)) for k, v in REGIONS.items()]
    if selected:
        found.append(F.col(selected))
    return df.withColumn("inferred_zones", F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))))


def default_zones(zones: Column, selected: Column) -> Column:
    """The selected region where no zone is given (PRJ-17)."""
    return F.when(F.coalesce(F.size(zones), F.lit(0)) > 0, zones).when(selected.isNotNull(), F.array(selected)).otherwise(F.array().cast("array<string>"))


def note_profile(text: Column, known: Column) -> Column:
    """The first profile that the dictation or a known condition suggests (PRJ-16); ``known`` is an array of names."""
    out = F.lit(DEFAULT_PROFILE)
    for name, words, conditions in reversed(NOTE_PROFILES):
        fits = any_contains(text, words)
        if conditions:
            fits = fits | F.coalesce(F.exists(known, _contains(conditions)), F.lit(False))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def _contains(words):
    return lambda c: any_contains(F.lower(c), words)


def problem_key(name: Column, code: Column) -> Column:
    """Grouping key of a problem: its code, else its folded name (AGG-01)."""
    icd = F.lower(trim_all(code))
    folded = F.lower(F.regexp_replace(trim_all(fold_accents(name)), r"\s+", " "))
    return F.when(F.coalesce(icd != "", F.lit(False)), F.concat(F.lit("icd:"), icd)).otherwise(F.concat(F.lit("name:"), folded))


def problems(records: DataFrame) -> DataFrame:
    """Problem list of each patient: latest record, title, occurrences (AGG-01).

    Accents are folded once per distinct name.
    """
    names = records.select("condition_name").distinct()
    names = names.select("condition_name", F.lower(F.regexp_replace(trim_all(fold_accents("condition_name")), r"\s+", " ")).alias("__folded"))
    icd = F.lower(trim_all(F.col("icd10_code")))
    key = F.when(F.coalesce(icd != "", F.lit(False)), F.concat(F.lit("icd:"), icd)).otherwise(F.concat(F.lit("name:"), F.col("__folded")))
    latest = F.max_by(F.struct("record_id", "condition_name"), F.struct("date_recorded", "record_id"))
    grouped = records.join(names, "condition_name").groupBy("patient_id", key.alias("problem_key")).agg(latest.alias("x"), F.count(F.lit(1)).alias("occurrences"), F.max("date_recorded").alias("latest_date"))
    title = trim_all(F.col("x.condition_name"))
    return grouped.select("patient_id", "problem_key", F.when(title == "", "Condition").otherwise(title).alias("title"), F.col("x.record_id").alias("latest_record_id"), "occurrences", "latest_date")


def photos_by_region(photos: DataFrame) -> DataFrame:
    """Photos of each patient and region by date (AGG-02)."""
    return photos.groupBy("patient_id", "anatomical_region").agg(F.array_sort(F.collect_list(F.struct("capture_date", "photo_id"))).alias("photos"))


def region_counts(records: DataFrame, photos: DataFrame, zones: str = "zones") -> DataFrame:
    """Records and photos per patient and region; a record counts once a region (AGG-03)."""
    by_record = records.select("patient_id", F.explode(F.array_distinct(zones)).alias("region")).groupBy("patient_id", "region").agg(F.count(F.lit(1)).alias("records"))
    by_photo = photos.groupBy("patient_id", F.col("anatomical_region").alias("region")).agg(F.count(F.lit(1)).alias("photos"))
    return by_record.join(by_photo, ["patient_id", "region"], "full").select("patient_id", "region", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("photos", F.lit(0)).alias("photos"))


def active_regions(records: DataFrame, photos: DataFrame, zones: str = "zones") -> DataFrame:
    """Regions with a record or a photo (JON-10, SET-01)."""
    return records.select("patient_id", F.explode(zones).alias("region")).union(photos.select("patient_id", "anatomical_region")).distinct()


def agenda(appointments: DataFrame, as_of: str, status: str = "status") -> DataFrame:
    """Counts of a day (AGG-04)."""
    day = appointments.where(on_day(F.col("scheduled_time"), as_of))
    is_ = lambda *names: F.count_if(F.col(status).isin(*names))
    return day.agg(
        F.count(F.lit(1)).alias("total"), is_("Completed").alias("completed"), is_("In Exam").alias("in_exam"), is_("Waiting triage", "Checked In").alias("waiting"),
        F.count_distinct("patient_id").alias("patients"), F.count_if(F.col(status) != "Completed").alias("remaining"),
    )


def part_of_day(ts: Column) -> Column:
    return F.when(F.hour(ts) < 12, "Morning").when(F.hour(ts) < 17, "Afternoon").otherwise("Evening")


def agenda_parts(appointments: DataFrame, as_of: str) -> DataFrame:
    """A day's appointments by part of day; empty parts are absent (AGG-05)."""
    day = appointments.where(on_day(F.col("scheduled_time"), as_of))
    ordered = F.array_sort(F.collect_list(F.struct("scheduled_time", "appointment_id")))
    return day.groupBy(part_of_day(F.col("scheduled_time")).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.transform(ordered, lambda x: x["appointment_id"]).alias("appointment_ids"))


def day_summary(appointments: DataFrame, as_of: str) -> DataFrame:
    """Per patient of a day: earliest appointment, count, first two different reasons (AGG-06)."""
    day = appointments.where(on_day(F.col("scheduled_time"), as_of))
    ordered = F.array_sort(F.collect_list(F.struct("scheduled_time", "appointment_id", "reason_for_visit")))
    grouped = day.groupBy("patient_id").agg(ordered.alias("a"))
    reasons = F.array_distinct(F.filter(F.transform("a", lambda x: x["reason_for_visit"]), lambda r: r != ""))
    return grouped.select("patient_id", F.get("a", F.lit(0))["appointment_id"].alias("primary_id"), F.size("a").cast("bigint").alias("appointments"), F.array_join(F.slice(reasons, 1, 2), ", ").alias("reasons"))


def panel_totals(patients: DataFrame, records: DataFrame, medications: DataFrame, appointments: DataFrame) -> DataFrame:
    """Child counts of every patient, 0 where there is none (AGG-07, JON-02)."""
    out = patients.select("patient_id", "source_kind")
    for name, child in (("records", records), ("medications", medications), ("appointments", appointments)):
        out = out.join(child.groupBy("patient_id").agg(F.count(F.lit(1)).alias(name)), "patient_id", "left").fillna(0, [name])
    return out


def recent(events: DataFrame, key: str, ts: str, k: int = 6) -> DataFrame:
    """The k most recently used keys (SRT-04)."""
    return events.groupBy(key).agg(F.max(ts).alias("last_used")).orderBy(F.desc("last_used"), key).limit(k)


def in_list_order(ids: DataFrame, array_column: str, entities: DataFrame, key: str) -> DataFrame:
    """Entities of an id list, in its order (JON-09)."""
    return ids.select(F.posexplode(array_column).alias("position", key)).join(entities, key).orderBy("position")


def first_seen(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key (SET-03, JON-03)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def elapsed_seconds(events: DataFrame, by: str, ts: str) -> DataFrame:
    """Last minus first event (WIN-04)."""
    return events.groupBy(by).agg((F.max(F.unix_micros(F.col(ts).cast("timestamp"))) - F.min(F.unix_micros(F.col(ts).cast("timestamp")))).alias("micros"))


def seed_demo(spark: SparkSession, n: int = 10) -> DataFrame:
    """A small synthetic panel for tests and demonstrations (SRC-16)."""
    names = ("Ada", "Ben", "Cleo", "Dov", "Eve")
    rows = spark.range(n)
    return rows.select(
        F.concat(F.lit("demo-"), F.col("id")).alias("patient_id"), F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("id") % 5 + 1).cast("int")).alias("first_name"),
        F.concat(F.lit("Sample"), F.col("id")).alias("last_name"), F.concat(F.lit("MRN"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("medical_record_number"),
        F.date_add(F.lit("1950-01-01").cast("date"), (F.col("id") * 1000).cast("int")).alias("date_of_birth"), (F.col("id") % 3 == 0).alias("is_smoker"),
        F.array().cast("array<string>").alias("allergies"), F.array().cast("array<string>").alias("risk_flags"), F.lit("demo_seed").alias("source_kind"),
    )
