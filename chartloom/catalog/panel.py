"""Question routing, compact lines, budgets and fallback answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.catalog.charts import DAY, NAME, NOW
from chartloom.catalog.registry import AS_OF, query, quoted
from chartloom.operators import intent
from chartloom.sources.clinic import load
from chartloom.sources.tables import table

ENTITIES = ("patient", "record", "medication", "appointment")
#: Example questions, routed together with the benchmark texts.
QUESTIONS = ("Which patients are due for a follow-up visit today?", "List every medication refill", "Who smokes or has an allergy?", "How old is she?", "psoriasis or eczema lesions", "hello", "dosage of methotrexate")
_ASKED = "SELECT q FROM (VALUES " + ", ".join(f"({quoted(q)})" for q in QUESTIONS) + ") v(q) UNION ALL SELECT text FROM benchmark"


def asked(spark, d):
    return spark.createDataFrame([(q,) for q in QUESTIONS], "q string").unionAll(table(spark, d, "benchmark").select("text"))


def _count(words) -> str:
    return " + ".join(f"CASE WHEN contains(lower(q), {quoted(w)}) THEN 1 ELSE 0 END" for w in words)


_SCORES = ", ".join(f"({_count(words)}) AS s{i}" for i, (_, words) in enumerate(intent.INTENTS))
_BEST = " ".join(f"WHEN s{i} = m THEN {quoted(name)}" for i, (name, _) in enumerate(intent.INTENTS))


def _route(routes, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(q), {quoted(w)})' for w in words)} THEN {quoted(name)}" for name, words in routes) + f" ELSE {quoted(default)} END"


@query("intent_route", f"SELECT q, CASE WHEN m = 0 THEN 'fullClinical' {_BEST} END AS intent FROM (SELECT *, greatest(s0, s1, s2, s3, s4) AS m FROM (SELECT q, {_SCORES} FROM ({_ASKED})))")
def intent_route(spark, d):
    return asked(spark, d).select("q", intent.classify(F.col("q")).alias("intent"))


@query("fallback_routes", f"SELECT q, {_route(intent.PATIENT_ROUTES, 'history')} AS patient_route, {_route(intent.PANEL_ROUTES, 'conditions')} AS panel_route FROM ({_ASKED})")
def fallback_routes(spark, d):
    return asked(spark, d).select("q", intent.route(F.col("q"), intent.PATIENT_ROUTES, "history").alias("patient_route"), intent.route(F.col("q"), intent.PANEL_ROUTES, "conditions").alias("panel_route"))


@query("token_estimate", "SELECT doc_id, CAST(greatest(1, ceil(length(text) / 1.4::DOUBLE)) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", intent.estimate_tokens(F.col("text")).alias("tokens"))


@query("model_choice", "SELECT doc_id, CASE WHEN greatest(1, ceil(length(text) / 1.4::DOUBLE)) > 4000 AND doc_id % 3 <> 0 THEN 'large' ELSE 'local' END AS model FROM documents")
def model_choice(spark, d):
    """Long prompts go to the large model, which is taken for unavailable for every third."""
    return table(spark, d, "documents").select("doc_id", intent.model_for(F.col("text"), F.col("doc_id") % 3 != 0).alias("model"))


_EST = "greatest(1, ceil(length({}) / 1.4::DOUBLE))"


@query("token_budget_left", f"SELECT item_id, CAST(greatest(0, floor((4096 - {_EST.format(quoted('system'))} - {_EST.format('text')} - {_EST.format('left(text, 1200)')} - 300) * 0.88::DOUBLE)) AS BIGINT) AS tokens FROM benchmark")
def token_budget_left(spark, d):
    return table(spark, d, "benchmark").select("item_id", intent.available_tokens(F.lit("system"), F.col("text"), F.col("text")).cast("bigint").alias("tokens"))


def _lines(name):
    def run(spark, d):
        return intent.compact_lines(name, *[load(spark, d, n) for n in ENTITIES], AS_OF)

    return run


_AGE = f"date_sub('year', date_of_birth, {DAY})"
_TIME = "strftime(scheduled_time, '%b %-d, %Y at %-I:%M %p')"
query("compact_demographics", f"SELECT patient_id, {NAME} || ' | ' || {_AGE} || 'y ' || gender || ' | MRN: ' || left(medical_record_number, 8) || ' | Blood: —' AS line FROM patient")(_lines("demographics"))
query("compact_medications", f"SELECT patient_id, {NAME} || ' | Meds: ' || left(coalesce(m, 'none'), 200) AS line FROM patient LEFT JOIN (SELECT patient_id, string_agg(medication_name || ' ' || dose, '; ' ORDER BY rx_id, medication_name || ' ' || dose) AS m FROM medication WHERE coalesce(status, 'Active') = 'Active' GROUP BY 1) USING (patient_id)")(_lines("medications"))
query("compact_conditions", f"SELECT patient_id, {NAME} || ' | Dx: ' || left(coalesce(c, 'none'), 200) AS line FROM patient LEFT JOIN (SELECT patient_id, string_agg(condition_name, '; ' ORDER BY condition_name) AS c FROM (SELECT DISTINCT patient_id, condition_name FROM record) GROUP BY 1) USING (patient_id)")(_lines("conditions"))
query(
    "compact_scheduling",
    f"""SELECT patient_id, {NAME} || ' | Appts: ' || coalesce(a, 'none scheduled') AS line FROM patient LEFT JOIN (SELECT patient_id, string_agg({_TIME} || ': ' || reason_for_visit, '; ' ORDER BY n) AS a FROM
    (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY scheduled_time, appointment_id) AS n FROM appointment) WHERE n <= 2 GROUP BY 1) USING (patient_id)""",
)(_lines("scheduling"))
query("compact_risks", f"SELECT patient_id, {NAME} || ' | Allergies: ' || CASE allergies WHEN '' THEN 'none' ELSE replace(allergies, '|', ', ') END || ' | Risks: ' || CASE risk_flags WHEN '' THEN 'none' ELSE risk_flags END || ' | Smoker: ' || CASE WHEN is_smoker THEN 'yes' ELSE 'no' END AS line FROM patient")(_lines("riskFactors"))
query(
    "compact_full",
    f"""SELECT patient_id, {NAME} || ' | ' || {_AGE} || 'y ' || gender || ' | Dx: ' || coalesce(dx, '—') || ' | ' || coalesce(n, 0) || ' meds | Allg: ' || CASE allergies WHEN '' THEN 'none' ELSE replace(allergies, '|', ',') END || ' | Next: ' || coalesce(t, '—') AS line FROM patient
    LEFT JOIN (SELECT patient_id, arg_max(condition_name, (date_recorded, record_id)) AS dx FROM record GROUP BY 1) USING (patient_id) LEFT JOIN (SELECT patient_id, count(*) AS n FROM medication WHERE coalesce(status, 'Active') = 'Active' GROUP BY 1) USING (patient_id)
    LEFT JOIN (SELECT patient_id, strftime(min(scheduled_time), '%b %-d, %Y at %-I:%M %p') AS t FROM appointment GROUP BY 1) USING (patient_id)""",
)(_lines("fullClinical"))


@query("batched_lines")
def batched_lines(spark, d):
    """Greedy batches of a clinician's panel; the packing is checked in the tests."""
    p = load(spark, d, "patient")
    lines = intent.compact_lines("demographics", *[load(spark, d, n) for n in ENTITIES], AS_OF).join(p.select("patient_id", F.coalesce("primary_clinician", F.lit("")).alias("clinician")), "patient_id")
    return intent.batch_lines(lines, 1000, "clinician").groupBy("clinician", "batch").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line") + 1).alias("chars"))


_OVERVIEW = f"""SELECT patient_id, {NAME} || ' — ' || coalesce(r.n, 0) || ' records, ' || coalesce(m.n, 0) || ' meds' || coalesce(', next: ' || a.x, '') AS line FROM (SELECT * FROM patient ORDER BY last_name, patient_id LIMIT 16)
LEFT JOIN (SELECT patient_id, count(*) n FROM record GROUP BY 1) r USING (patient_id) LEFT JOIN (SELECT patient_id, count(*) n FROM medication GROUP BY 1) m USING (patient_id)
LEFT JOIN (SELECT patient_id, arg_min(reason_for_visit, (scheduled_time, appointment_id)) AS x FROM appointment WHERE scheduled_time > {NOW} GROUP BY 1) a USING (patient_id)"""


@query("panel_overview", _OVERVIEW)
def panel_overview(spark, d):
    return intent.panel_overview(*[load(spark, d, n) for n in ENTITIES], AS_OF)


@query("panel_schedule", f"SELECT patient_id, {NAME} || ' — ' || strftime(scheduled_time, '%-I:%M %p') || ': ' || reason_for_visit || ' [' || status || ']' AS line FROM appointment JOIN patient USING (patient_id) WHERE CAST(scheduled_time AS DATE) = {DAY}")
def panel_schedule(spark, d):
    return intent.answer_panel("Who is on today's agenda?", *[load(spark, d, n) for n in ENTITIES], AS_OF)


@query("panel_medications", f"SELECT patient_id, '[' || {NAME} || '] ' || medication_name || ' | Status: ' || coalesce(status, 'Active') AS line FROM medication JOIN patient USING (patient_id)")
def panel_medications(spark, d):
    return intent.answer_panel("all drug names", *[load(spark, d, n) for n in ENTITIES], AS_OF)


@query("panel_conditions", f"SELECT patient_id, '[' || {NAME} || '] ' || strftime(date_recorded, '%b %-d, %Y') || ': ' || condition_name || ' — ' || status AS line FROM record JOIN patient USING (patient_id) WHERE contains(lower(condition_name), 'basal') OR contains(lower(coalesce(cc_hpi, '')), 'basal') ORDER BY date_recorded DESC, record_id LIMIT 10")
def panel_conditions(spark, d):
    return intent.answer_panel("basal", *[load(spark, d, n) for n in ENTITIES], AS_OF)


@query("patient_answer", "SELECT row_number() OVER (ORDER BY written_date DESC, rx_id) AS position, medication_name || ' ' || dose || ' | Unspecified | See instructions | Status: ' || coalesce(status, 'Active') || ' | Indication: ' || indication AS line FROM medication WHERE patient_id = '7'")
def patient_answer(spark, d):
    return intent.answer_patient("Any refill due?", "7", *[load(spark, d, n) for n in ENTITIES], AS_OF).withColumn("position", F.col("position").cast("bigint"))


@query("patient_history_answer", "SELECT row_number() OVER (ORDER BY date_recorded DESC, record_id) AS position, strftime(date_recorded, '%b %-d, %Y') || ': ' || condition_name || ' [' || status || ']' || coalesce(' | Visit: ' || visit_type, '') || ' | Severity: ' || severity AS line FROM record WHERE patient_id = '7' QUALIFY position <= 5")
def patient_history_answer(spark, d):
    return intent.answer_patient("zzz", "7", *[load(spark, d, n) for n in ENTITIES], AS_OF).withColumn("position", F.col("position").cast("bigint"))
