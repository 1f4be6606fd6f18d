"""Chart queries: projections, searches, joins, groupings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chartloom.catalog.registry import AS_OF, query, quoted
from chartloom.functions import text as T
from chartloom.operators import chart, labels
from chartloom.operators.formatters import appointment_line, medication_line, patient_summary, record_line
from chartloom.sources import tables
from chartloom.sources.clinic import load

NOW = f"TIMESTAMP '{AS_OF}'"
DAY = f"DATE '{AS_OF[:10]}'"
NAME = "first_name || ' ' || last_name"


@query("fetch_sorted", "SELECT patient_id, last_name FROM patient")
def fetch_sorted(spark, d):
    return load(spark, d, "patient").orderBy("last_name").select("patient_id", "last_name")


@query("point_lookup", "SELECT patient_id, last_name, gender FROM patient WHERE patient_id = '42'")
def point_lookup(spark, d):
    return tables.lookup(load(spark, d, "patient"), "patient_id", "42").select("patient_id", "last_name", "gender")


@query("observed_view", "SELECT gender, count(*) AS patients FROM patient GROUP BY gender")
def observed_view(spark, d):
    return tables.observe(load(spark, d, "patient"), "patients_observed").groupBy("gender").agg(F.count(F.lit(1)).alias("patients"))


@query("resolve_entities", f"SELECT patient_id FROM patient WHERE contains(lower(concat_ws(' ', first_name, last_name)), 'furniture') OR patient_id IN ('1', '2', '3')")
def resolve_entities(spark, d):
    p = load(spark, d, "patient")
    return tables.resolve(p, "patient_id", None, "FURNITURE", "first_name", "last_name").select("patient_id").union(tables.resolve(p, "patient_id", ["1", "2", "3"]).select("patient_id")).distinct()


@query("row_counts", "SELECT 'record' AS entity, count(*) AS n FROM record UNION ALL SELECT 'appointment', count(*) FROM appointment")
def row_counts(spark, d):
    one = lambda n: load(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("entity"), "n")
    return one("record").unionAll(one("appointment"))


@query("names_and_ages", f"SELECT patient_id, {NAME} AS full_name, CAST(date_sub('year', date_of_birth, {DAY}) AS INTEGER) AS age, left(first_name, 1) || left(last_name, 1) AS initials FROM patient")
def names_and_ages(spark, d):
    return load(spark, d, "patient").select("patient_id", labels.full_name().alias("full_name"), labels.age(F.col("date_of_birth"), F.lit(AS_OF).cast("timestamp")).alias("age"), T.initials(F.col("first_name"), F.col("last_name")).alias("initials"))


_REGION_ROWS = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in labels.REGIONS.items())


@query("region_names", f"SELECT photo_id, coalesce(label, anatomical_region) AS region_name FROM photo LEFT JOIN (VALUES {_REGION_ROWS}) r(region, label) ON anatomical_region = region")
def region_names(spark, d):
    return load(spark, d, "photo").select("photo_id", labels.region_name(F.col("anatomical_region")).alias("region_name"))


@query("sorted_regions", f"SELECT region, label FROM (VALUES {_REGION_ROWS}) r(region, label)")
def sorted_regions(spark, d):
    return labels.regions(spark)


_OPEN = ", ".join(quoted(s) for s in labels.OPEN_STATUSES)


@query(
    "resolved_status",
    f"""SELECT a.appointment_id, CASE WHEN lower(a.status) NOT IN ({_OPEN}) THEN a.status WHEN n.note = 'signed' THEN 'Completed' WHEN n.note = 'reviewed' THEN 'Ready for Checkout' WHEN n.note = 'draft' THEN 'In Exam'
    WHEN CAST(a.scheduled_time AS DATE) = {DAY} AND a.scheduled_time < {NOW} THEN CASE WHEN a.scheduled_time > {NOW} - INTERVAL 900 SECOND THEN 'Checked In' ELSE 'Waiting triage' END ELSE a.status END AS resolved_status
    FROM appointment a LEFT JOIN (SELECT patient_id, arg_max(documentation_status, (date_recorded, record_id)) AS note FROM record WHERE CAST(date_recorded AS DATE) = {DAY} GROUP BY patient_id) n ON a.patient_id = n.patient_id""",
)
def resolved_status(spark, d):
    return labels.resolved_status(load(spark, d, "appointment"), load(spark, d, "record"), AS_OF).select("appointment_id", "resolved_status")


@query(
    "status_labels",
    """SELECT DISTINCT status, CASE lower(status) WHEN 'scheduled' THEN 'Scheduled' WHEN 'confirmed' THEN 'Confirmed' WHEN 'completed' THEN 'Completed' WHEN 'in exam' THEN 'Exam' ELSE 'Cancelled' END AS label,
    CASE status WHEN 'Completed' THEN 'Done' WHEN 'In Exam' THEN 'Exam' ELSE status END AS pill, CASE status WHEN 'Scheduled' THEN 'Confirmed' WHEN 'In Exam' THEN 'Ready for Checkout' END AS next_status,
    CASE status WHEN 'In Exam' THEN 'Roomed' WHEN 'Completed' THEN 'Ready for Checkout' END AS previous_status FROM appointment""",
)
def status_labels(spark, d):
    s = F.col("status")
    return load(spark, d, "appointment").select("status").distinct().select("status", labels.status_label(s).alias("label"), labels.pill(s).alias("pill"), labels.next_status(s).alias("next_status"), labels.previous_status(s).alias("previous_status"))


@query("source_kinds", "SELECT source_kind, CASE source_kind WHEN 'smart_fhir' THEN 'Connected record' ELSE 'Manual entry' END AS label, count(*) AS patients FROM patient GROUP BY source_kind")
def source_kinds(spark, d):
    return load(spark, d, "patient").groupBy("source_kind").agg(F.count(F.lit(1)).alias("patients")).select("source_kind", labels.source_label(F.col("source_kind")).alias("label"), "patients")


@query("one_source_or_mixed", "SELECT last_name, CASE WHEN count(DISTINCT source_kind) = 1 THEN min(source_kind) ELSE 'mixed' END AS source_kind FROM (SELECT right(last_name, 2) AS last_name, source_kind FROM patient) GROUP BY last_name")
def one_source_or_mixed(spark, d):
    return labels.one_source_or_mixed(load(spark, d, "patient").select(F.right("last_name", F.lit(2)).alias("last_name"), "source_kind"), "last_name")


def _rule(r) -> str:
    words, prefixes, exact, _ = r
    return " OR ".join([f"contains(c, {quoted(w)})" for w in words] + [f"starts_with(coalesce(i, ''), {quoted(p)})" for p in prefixes] + [f"coalesce(i, '') = {quoted(e)}" for e in exact])


_LINKS = " || ".join(f"CASE WHEN {_rule(r)} THEN [{', '.join(quoted(t) for t in r[3])}] ELSE [] END" for r in chart.EDUCATION_RULES)


@query(
    "rule_links",
    f"""SELECT record_id, title FROM (SELECT record_id, unnest(CASE WHEN len(l) = 0 THEN [{quoted(chart.EDUCATION_FALLBACK)}] ELSE l END) AS title FROM (SELECT record_id, {_LINKS} AS l FROM (SELECT record_id, lower(condition_name) AS c, icd10_code AS i FROM record)))""",
)
def rule_links(spark, d):
    return chart.education_links(load(spark, d, "record").select("record_id", "condition_name", "icd10_code")).select("record_id", "title")


@query(
    "clinical_alerts",
    """SELECT p.patient_id, a.title, a.message FROM patient p LEFT JOIN (SELECT patient_id, bool_or(contains(lower(condition_name), 'melanoma') OR contains(lower(condition_name), 'carcinoma')) AS cancer FROM record GROUP BY patient_id) r ON p.patient_id = r.patient_id,
    LATERAL (SELECT * FROM (VALUES ('High-Risk Patient', '', p.is_smoker AND coalesce(r.cancer, false)), ('Smoking Status', '', p.is_smoker AND NOT coalesce(r.cancer, false)),
    ('Allergy Alert', CASE p.allergies WHEN 'Penicillin' THEN 'Penicillin' WHEN 'Latex|Pollen' THEN 'Latex' ELSE '' END, p.allergies IN ('Penicillin', 'Latex|Pollen')), ('Risk Flags', p.risk_flags, p.risk_flags <> '')) v(title, message, holds) WHERE holds) a""",
)
def clinical_alerts(spark, d):
    return chart.alerts(load(spark, d, "patient"), load(spark, d, "medication"), load(spark, d, "record")).select("patient_id", "title", "message")


@query(
    "workflow_checklist",
    f"""SELECT p.patient_id, r.patient_id IS NOT NULL AS note_reviewed, coalesce(m.n, 0) = 0 AS meds_reconciled, a.patient_id IS NOT NULL AS follow_up_booked, CAST(coalesce(m.n, 0) AS BIGINT) AS active_meds FROM patient p
    LEFT JOIN (SELECT DISTINCT patient_id FROM record) r ON p.patient_id = r.patient_id LEFT JOIN (SELECT patient_id, count(*) AS n FROM medication WHERE coalesce(status, 'Active') = 'Active' GROUP BY patient_id) m ON p.patient_id = m.patient_id
    LEFT JOIN (SELECT DISTINCT patient_id FROM appointment WHERE scheduled_time >= {NOW}) a ON p.patient_id = a.patient_id""",
)
def workflow_checklist(spark, d):
    out = chart.workflow(load(spark, d, "patient"), load(spark, d, "record"), load(spark, d, "medication"), load(spark, d, "appointment"), AS_OF)
    return out.drop("instructions_ready")


_DAY_TEXT = "strftime(date_recorded, '%b %-d, %Y')"


@query("record_lines", f"SELECT record_id, {_DAY_TEXT} || ': ' || condition_name || ' [' || status || ']' || coalesce(' | Visit: ' || visit_type, '') || ' | Severity: ' || severity AS line FROM record")
def record_lines(spark, d):
    r = load(spark, d, "record")
    return r.select("record_id", record_line(r.columns).alias("line"))


@query("medication_lines", "SELECT rx_id, medication_name || ' ' || dose || ' | Unspecified | See instructions | Status: ' || coalesce(status, 'Active') || ' | Indication: ' || indication AS line FROM medication")
def medication_lines(spark, d):
    m = load(spark, d, "medication")
    return m.select("rx_id", medication_line(m.columns).alias("line"))


@query("appointment_lines", "SELECT appointment_id, strftime(scheduled_time, '%b %-d, %Y at %-I:%M %p') || ': ' || reason_for_visit AS line FROM appointment")
def appointment_lines(spark, d):
    a = load(spark, d, "appointment")
    return a.select("appointment_id", appointment_line(a.columns).alias("line"))


@query(
    "patient_summaries",
    f"""SELECT patient_id, 'Patient: ' || {NAME} || chr(10) || 'MRN: ' || medical_record_number || chr(10) || 'Age/Sex: ' || date_sub('year', date_of_birth, {DAY}) || ' / ' || gender || chr(10) || 'Smoking: ' || CASE WHEN is_smoker THEN 'Current smoker' ELSE 'Non-smoker' END
    || chr(10) || 'Primary clinician: ' || coalesce(primary_clinician, 'Not assigned') || chr(10) || 'Preferred pharmacy: Not documented' || chr(10) || 'Allergies: ' || CASE allergies WHEN '' THEN 'None documented' ELSE replace(allergies, '|', ', ') END
    || chr(10) || 'Risk flags: ' || CASE risk_flags WHEN '' THEN 'None documented' ELSE risk_flags END || chr(10) || 'Blood type: Not documented' || chr(10) || 'Care plan summary: No care plan summary documented' AS summary FROM patient""",
)
def patient_summaries(spark, d):
    p = load(spark, d, "patient")
    return p.select("patient_id", patient_summary(p.columns, F.lit(AS_OF).cast("timestamp")).alias("summary"))


@query("text_previews", "SELECT item_id, left(text, 150) AS preview, CASE WHEN length(text) > 40 THEN left(text, 37) || '...' ELSE text END AS query_preview FROM benchmark")
def text_previews(spark, d):
    return tables.table(spark, d, "benchmark").select("item_id", T.preview(F.col("text")).alias("preview"), T.query_preview(F.col("text")).alias("query_preview"))


_DICTATION = "'nodule at the left hand near neck, ' || lower(condition_name)"
_ZONES = ", ".join(f"CASE WHEN contains(t, {quoted(k.replace('_', ' '))}) OR contains(t, {quoted(v.lower())}) THEN {quoted(k)} END" for k, v in labels.REGIONS.items())


@query("inferred_zones", f"SELECT record_id, array_to_string(list_sort(list_filter([{_ZONES}], lambda x: x IS NOT NULL)), ',') AS zones FROM (SELECT record_id, {_DICTATION} AS t FROM record)")
def inferred_zones(spark, d):
    r = load(spark, d, "record").select("record_id", F.concat(F.lit("nodule at the left hand near neck, "), F.lower("condition_name")).alias("t"))
    return chart.infer_zones(r, "t").select("record_id", F.array_join("inferred_zones", ",").alias("zones"))


_PROFILE = " ".join(f"WHEN {' OR '.join(f'contains(c, {quoted(w)})' for w in words)} THEN {quoted(name)}" for name, words, _ in chart.NOTE_PROFILES)


@query("note_profiles", f"SELECT record_id, CASE {_PROFILE} ELSE {quoted(chart.DEFAULT_PROFILE)} END AS profile FROM (SELECT record_id, lower(condition_name) AS c FROM record)")
def note_profiles(spark, d):
    return load(spark, d, "record").select("record_id", chart.note_profile(F.lower("condition_name"), F.array(F.col("condition_name"))).alias("profile"))


@query("default_zones", "SELECT record_id, CASE zones WHEN '' THEN 'torso' ELSE replace(zones, '|', ',') END AS zones FROM record")
def default_zones(spark, d):
    return load(spark, d, "record").select("record_id", F.array_join(chart.default_zones(F.col("zones"), F.lit("torso")), ",").alias("zones"))


@query("roster_search", f"SELECT patient_id, {NAME} AS name FROM patient WHERE contains(lower({NAME}), 'mach') OR contains(lower(medical_record_number), 'mach') OR contains(lower(coalesce(primary_clinician, '')), 'mach')")
def roster_search(spark, d):
    p = load(spark, d, "patient").withColumn("name", labels.full_name())
    return chart.search(p, "MACH", "name", "medical_record_number", "primary_clinician").select("patient_id", "name")


@query("visit_search", "SELECT record_id FROM record WHERE contains(lower(condition_name), 'c44') OR contains(lower(coalesce(cc_hpi, '')), 'c44') OR contains(lower(coalesce(icd10_code, '')), 'c44') OR contains(lower(coalesce(visit_type, '')), 'c44')")
def visit_search(spark, d):
    return chart.search(load(spark, d, "record"), "C44", "condition_name", "cc_hpi", "icd10_code", "visit_type").select("record_id")


@query("appointment_search", "SELECT appointment_id FROM appointment WHERE contains(lower(reason_for_visit), 'exam') OR contains(lower(status), 'exam')")
def appointment_search(spark, d):
    return chart.search(load(spark, d, "appointment"), "exam", "reason_for_visit", "status").select("appointment_id")


@query("note_search", "SELECT record_id FROM record WHERE status = 'Final' AND (contains(lower(condition_name), 'urgent') OR contains(lower(coalesce(cc_hpi, '')), 'urgent') OR contains(lower(severity), 'urgent'))")
def note_search(spark, d):
    return chart.search(load(spark, d, "record").where("status = 'Final'"), "Urgent", "condition_name", "cc_hpi", "severity").select("record_id")


@query("medication_search", "SELECT rx_id FROM medication WHERE contains(lower(medication_name), '#1') OR contains(lower(generic_name), '#1') OR contains(lower(indication), '#1')")
def medication_search(spark, d):
    return chart.search(load(spark, d, "medication"), "#1", "medication_name", "generic_name", "indication").select("rx_id")


@query("active_counts", "SELECT patient_id, count(*) AS active FROM medication WHERE coalesce(status, 'Active') = 'Active' GROUP BY patient_id")
def active_counts(spark, d):
    return load(spark, d, "medication").where(chart.is_active(F.col("status"))).groupBy("patient_id").agg(F.count(F.lit(1)).alias("active"))


@query("today_list", f"SELECT appointment_id, scheduled_time FROM appointment WHERE CAST(scheduled_time AS DATE) = {DAY}")
def today_list(spark, d):
    return load(spark, d, "appointment").where(chart.on_day(F.col("scheduled_time"), AS_OF)).select("appointment_id", "scheduled_time")


@query(
    "next_appointments",
    f"""SELECT patient_id, arg_min(appointment_id, (scheduled_time, appointment_id)) AS appointment_id, 'from' AS variant FROM appointment WHERE scheduled_time >= {NOW} GROUP BY patient_id
    UNION ALL SELECT patient_id, arg_min(appointment_id, (scheduled_time, appointment_id)), 'after' FROM appointment WHERE scheduled_time > {NOW} GROUP BY patient_id
    UNION ALL SELECT patient_id, arg_min(appointment_id, (scheduled_time, appointment_id)), 'first' FROM appointment GROUP BY patient_id""",
)
def next_appointments(spark, d):
    a = load(spark, d, "appointment")
    one = lambda df, v: df.select("patient_id", "appointment_id", F.lit(v).alias("variant"))
    return one(chart.next_appointment(a, AS_OF), "from").unionAll(one(chart.next_appointment(a, AS_OF, False), "after")).unionAll(one(chart.next_appointment(a, None), "first"))


@query("zone_members", "SELECT record_id FROM record WHERE list_contains(string_split(zones, '|'), 'left_hand')")
def zone_members(spark, d):
    return load(spark, d, "record").where(F.array_contains("zones", "left_hand")).select("record_id")


@query("history_token_search", "SELECT record_id, date_recorded FROM record WHERE contains(lower(concat_ws(' ', condition_name, cc_hpi, visit_type)), 'rosacea') OR contains(lower(concat_ws(' ', condition_name, cc_hpi, visit_type)), 'low')")
def history_token_search(spark, d):
    return chart.token_search(load(spark, d, "record"), "rosacea, is LOW?").select("record_id", "date_recorded")


@query("status_filter", "SELECT appointment_id FROM appointment WHERE status = 'In Exam'")
def status_filter(spark, d):
    return load(spark, d, "appointment").where(F.col("status") == "In Exam").select("appointment_id")


@query(
    "risk_entries",
    f"""SELECT patient_id, '[' || {NAME} || '] ' || concat_ws(' | ', CASE WHEN allergies <> '' THEN 'Allergies: ' || replace(allergies, '|', ', ') END, CASE WHEN risk_flags <> '' THEN 'Risk: ' || risk_flags END, CASE WHEN is_smoker THEN 'Current smoker' END) AS line
    FROM patient WHERE allergies <> '' OR risk_flags <> '' OR is_smoker""",
)
def risk_entries(spark, d):
    return chart.risk_entries(load(spark, d, "patient"))


@query("delete_containing", "SELECT record_id FROM record WHERE NOT contains(coalesce(cc_hpi, ''), 'LOW')")
def delete_containing(spark, d):
    return tables.delete_containing(load(spark, d, "record"), "cc_hpi", "LOW").select("record_id")


@query("cascade_delete", "SELECT record_id FROM record WHERE patient_id NOT IN (SELECT patient_id FROM patient WHERE gender = 'Male')")
def cascade_delete(spark, d):
    gone = load(spark, d, "patient").where("gender = 'Male'")
    return tables.delete_where_in(load(spark, d, "record"), gone, "patient_id").select("record_id")


@query("patient_records", f"SELECT record_id, {NAME} AS name, condition_name FROM record JOIN patient USING (patient_id)")
def patient_records(spark, d):
    return load(spark, d, "patient").join(load(spark, d, "record"), "patient_id").select("record_id", labels.full_name().alias("name"), "condition_name")


@query(
    "panel_totals",
    """SELECT p.patient_id, p.source_kind, CAST(coalesce(r.n, 0) AS BIGINT) AS records, CAST(coalesce(m.n, 0) AS BIGINT) AS medications, CAST(coalesce(a.n, 0) AS BIGINT) AS appointments FROM patient p
    LEFT JOIN (SELECT patient_id, count(*) n FROM record GROUP BY 1) r USING (patient_id) LEFT JOIN (SELECT patient_id, count(*) n FROM medication GROUP BY 1) m USING (patient_id) LEFT JOIN (SELECT patient_id, count(*) n FROM appointment GROUP BY 1) a USING (patient_id)""",
)
def panel_totals(spark, d):
    return chart.panel_totals(*[load(spark, d, n) for n in ("patient", "record", "medication", "appointment")])


@query("first_seen", "SELECT patient_id, arg_min(record_id, (date_recorded, record_id)) AS record_id FROM record GROUP BY patient_id")
def first_seen(spark, d):
    return chart.first_seen(load(spark, d, "record"), ["patient_id"], "date_recorded", "record_id").select("patient_id", "record_id")


@query("list_order_lookup", "SELECT pos - 1 AS position, patient_id, last_name FROM (SELECT unnest(['9', '3', '7']) AS patient_id, unnest([1, 2, 3]) AS pos) JOIN patient USING (patient_id)")
def list_order_lookup(spark, d):
    ids = spark.range(1).select(F.array(*[F.lit(x) for x in ("9", "3", "7")]).alias("ids"))
    return chart.in_list_order(ids, "ids", load(spark, d, "patient"), "patient_id").select("position", "patient_id", "last_name")


@query("active_regions", "SELECT DISTINCT patient_id, region FROM (SELECT patient_id, unnest(string_split(zones, '|')) AS region FROM record WHERE zones <> '' UNION ALL SELECT patient_id, anatomical_region FROM photo)")
def active_regions(spark, d):
    return chart.active_regions(load(spark, d, "record"), load(spark, d, "photo"))


@query("set_sizes", "SELECT item_id, len(list_distinct(w)) AS distinct_words, len(list_intersect(w, ['the', 'of', 'and'])) AS common FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)")
def set_sizes(spark, d):
    w = T.words(F.col("text"))
    return tables.table(spark, d, "benchmark").select("item_id", F.size(F.array_distinct(w)).cast("bigint").alias("distinct_words"), F.size(F.array_intersect(w, F.array(F.lit("the"), F.lit("of"), F.lit("and")))).cast("bigint").alias("common"))


@query("latest_orders", "SELECT patient_id, record_id, n FROM (SELECT patient_id, record_id, row_number() OVER (PARTITION BY patient_id ORDER BY date_recorded DESC, record_id) AS n FROM record) WHERE n <= 3")
def latest_orders(spark, d):
    w = Window.partitionBy("patient_id").orderBy(F.desc("date_recorded"), "record_id")
    return load(spark, d, "record").select("patient_id", "record_id", F.row_number().over(w).cast("bigint").alias("n")).where("n <= 3")


@query("recent_patients", "SELECT patient_id, max(scheduled_time) AS last_used FROM appointment GROUP BY patient_id ORDER BY last_used DESC, patient_id LIMIT 6")
def recent_patients(spark, d):
    return chart.recent(load(spark, d, "appointment"), "patient_id", "scheduled_time")


_KEY = "CASE WHEN trim(coalesce(icd10_code, '')) <> '' THEN 'icd:' || lower(trim(icd10_code)) ELSE 'name:' || regexp_replace(trim(lower(strip_accents(condition_name))), '\\s+', ' ', 'g') END"


@query("problem_list", f"SELECT patient_id, {_KEY} AS problem_key, trim(arg_max(condition_name, (date_recorded, record_id))) AS title, arg_max(record_id, (date_recorded, record_id)) AS latest_record_id, count(*) AS occurrences, max(date_recorded) AS latest_date FROM record GROUP BY patient_id, problem_key")
def problem_list(spark, d):
    return chart.problems(load(spark, d, "record"))


@query("photo_groups", "SELECT patient_id, anatomical_region, string_agg(photo_id, ',' ORDER BY capture_date, photo_id) AS photos FROM photo GROUP BY patient_id, anatomical_region")
def photo_groups(spark, d):
    return chart.photos_by_region(load(spark, d, "photo")).select("patient_id", "anatomical_region", F.array_join(F.transform("photos", lambda x: x["photo_id"]), ",").alias("photos"))


@query(
    "region_counts",
    """SELECT patient_id, region, CAST(coalesce(r.n, 0) AS BIGINT) AS records, CAST(coalesce(p.n, 0) AS BIGINT) AS photos FROM (SELECT patient_id, region, count(*) n FROM (SELECT DISTINCT patient_id, record_id, unnest(string_split(zones, '|')) AS region FROM record WHERE zones <> '') GROUP BY 1, 2) r
    FULL JOIN (SELECT patient_id, anatomical_region AS region, count(*) n FROM photo GROUP BY 1, 2) p USING (patient_id, region)""",
)
def region_counts(spark, d):
    return chart.region_counts(load(spark, d, "record"), load(spark, d, "photo"))


@query(
    "agenda_kpis",
    f"""SELECT count(*) AS total, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status = 'In Exam') AS in_exam, count(*) FILTER (status IN ('Waiting triage', 'Checked In')) AS waiting, count(DISTINCT patient_id) AS patients, count(*) FILTER (status <> 'Completed') AS remaining
    FROM appointment WHERE CAST(scheduled_time AS DATE) = {DAY}""",
)
def agenda_kpis(spark, d):
    return chart.agenda(load(spark, d, "appointment"), AS_OF)


@query("agenda_parts", f"SELECT CASE WHEN hour(scheduled_time) < 12 THEN 'Morning' WHEN hour(scheduled_time) < 17 THEN 'Afternoon' ELSE 'Evening' END AS part, count(*) AS n, string_agg(appointment_id, ',' ORDER BY scheduled_time, appointment_id) AS ids FROM appointment WHERE CAST(scheduled_time AS DATE) = {DAY} GROUP BY part")
def agenda_parts(spark, d):
    return chart.agenda_parts(load(spark, d, "appointment"), AS_OF).select("part", "n", F.array_join("appointment_ids", ",").alias("ids"))


@query(
    "day_summary",
    f"""SELECT patient_id, arg_min(appointment_id, (scheduled_time, appointment_id)) AS primary_id, count(*) AS appointments FROM appointment WHERE CAST(scheduled_time AS DATE) = {DAY} GROUP BY patient_id""",
)
def day_summary(spark, d):
    return chart.day_summary(load(spark, d, "appointment"), AS_OF).drop("reasons")


@query(
    "day_reasons",
    f"""SELECT patient_id, string_agg(reason_for_visit, ', ' ORDER BY k) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY k) AS n FROM (SELECT patient_id, reason_for_visit, min((scheduled_time, appointment_id)) AS k
    FROM appointment WHERE CAST(scheduled_time AS DATE) = {DAY} GROUP BY patient_id, reason_for_visit)) WHERE n <= 2 GROUP BY patient_id""",
)
def day_reasons(spark, d):
    return chart.day_summary(load(spark, d, "appointment"), AS_OF).select("patient_id", "reasons")


@query("elapsed", "SELECT patient_id, epoch_us(max(scheduled_time)) - epoch_us(min(scheduled_time)) AS micros FROM appointment GROUP BY patient_id")
def elapsed(spark, d):
    return chart.elapsed_seconds(load(spark, d, "appointment"), "patient_id", "scheduled_time")
