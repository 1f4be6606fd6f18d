"""Layout scores, splitting, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.catalog.registry import AS_OF, query
from chartloom.functions import text as T
from chartloom.operators import chunking, complexity, labels
from chartloom.sources.clinic import load
from chartloom.sources.tables import spread_table, table

_LINES = r"regexp_split_to_array(text, '[\n\r\x{0b}\x{0c}\x{85}\x{2028}\x{2029}]')"
_SCORES = r"""SELECT doc_id, least(1.0, length(regexp_replace(text, '[^\p{N}]', '', 'g'))::DOUBLE / greatest(1, length(text)) * 5) AS numeric_density,
least(1.0, CASE WHEN pipes > 5 THEN least(0.5, pipes / 20.0::DOUBLE) ELSE 0 END + CASE WHEN tabs > 10 THEN least(0.3, tabs / 50.0::DOUBLE) ELSE 0 END + CASE WHEN aligned > 3 THEN least(0.4, aligned / 10.0::DOUBLE) ELSE 0 END)::DOUBLE AS table_signature,
least(1.0, len(list_filter(t, lambda x: regexp_matches(x, '^(• |- |\* |· |○ |► |▪ )') OR regexp_matches(x, '^\s*\p{Nd}+[.):]\s')))::DOUBLE / len(t) * 3) AS list_strength,
least(1.0, len(list_filter(t, lambda x: regexp_matches(x, '^[A-Z][A-Z\s]{3,}$|^#{1,6}\s|^\*\*.*\*\*$')))::DOUBLE / len(t) * 10) AS header_strength
FROM (SELECT *, length(text) - length(replace(text, '|', '')) AS pipes, length(text) - length(replace(text, chr(9), '')) AS tabs, list_transform(l, lambda x: regexp_replace(x, '^[\p{Zs}\t]+|[\p{Zs}\t]+$', '', 'g')) AS t,
len(list_filter(l, lambda x: len(list_filter(regexp_split_to_array(x, '[^\p{N}.,-]+'), lambda g: regexp_matches(g, '^\p{N}'))) >= 3)) AS aligned FROM (SELECT doc_id, text, LINES AS l FROM documents))""".replace("LINES", _LINES)
_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("numeric_density", "table_signature", "list_strength", "header_strength"))
_CLASS = "CASE WHEN table_signature > 0.4 OR numeric_density > 0.3 THEN 'complex' WHEN list_strength > 0.3 OR header_strength > 0.2 THEN 'moderate' ELSE 'simple' END"
_SPLIT = f"""SELECT doc_id, chunk_words, list_filter(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' '), lambda w: w <> '') AS w FROM documents JOIN (SELECT doc_id, CASE {_CLASS} WHEN 'complex' THEN 500 WHEN 'moderate' THEN 250 ELSE 310 END AS chunk_words FROM ({_SCORES})) USING (doc_id)"""


@query("complexity_features", f"SELECT doc_id, {_ROUNDED} FROM ({_SCORES})")
def complexity_features(spark, d):
    out = complexity.analyze(spread_table(spark, d, "documents"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("numeric_density", "table_signature", "list_strength", "header_strength")])


@query("complexity_class", f"SELECT {_CLASS} AS complexity, count(*) AS documents FROM ({_SCORES}) GROUP BY 1")
def complexity_class(spark, d):
    return complexity.analyze(spread_table(spark, d, "documents").select("doc_id", "text")).groupBy("complexity").agg(F.count(F.lit(1)).alias("documents"))


@query("section_split", f"SELECT doc_id, CAST(part AS INTEGER) AS part, CAST(least(len(w) - part * chunk_words, chunk_words) AS INTEGER) AS word_count FROM (SELECT doc_id, chunk_words, w, unnest(range(0, CAST(ceil(greatest(len(w), 1)::DOUBLE / chunk_words) AS BIGINT))) AS part FROM ({_SPLIT}))")
def section_split(spark, d):
    sized = complexity.analyze(spread_table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "content")
    return chunking.split_words(sized.select("doc_id", "content", "chunk_words")).select("doc_id", "part", "word_count")


@query("token_counts", "SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) + 2 AS tokens, CAST(greatest(1, ceil(length(text) / 1.4::DOUBLE)) AS BIGINT) AS estimate FROM documents")
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).cast("bigint").alias("tokens"), T.estimate_tokens(F.col("text")).alias("estimate"))


@query(
    "appointment_chunks",
    """SELECT patient_id, '[' || first_name || ' ' || last_name || '] [Appointments]' AS contextual_prefix, string_agg(strftime(scheduled_time, '%b %-d, %Y at %-I:%M %p') || ': ' || reason_for_visit || ' [' || status || ']', chr(10) ORDER BY scheduled_time, appointment_id) AS content
    FROM appointment JOIN patient USING (patient_id) GROUP BY patient_id, first_name, last_name""",
)
def appointment_chunks(spark, d):
    return chunking.appointment_chunks(load(spark, d, "appointment"), load(spark, d, "patient")).select("patient_id", "contextual_prefix", "content")


@query(
    "record_chunks",
    """SELECT patient_id, section_title, count(*) AS chunks, CAST(sum(len(list_filter(string_split(trim(content), ' '), lambda w: w <> ''))) AS BIGINT) AS words FROM (
    SELECT patient_id, 'Condition' AS section_title, condition_name || ' — ' || status || ' | Severity: ' || severity || coalesce(' | Visit: ' || visit_type, '') AS content FROM record
    UNION ALL SELECT patient_id, 'Chief Complaint & HPI', cc_hpi FROM record WHERE cc_hpi IS NOT NULL UNION ALL SELECT patient_id, 'Anatomical Zones', 'Affected zones: ' || replace(zones, '|', ', ') FROM record WHERE zones <> '') JOIN (SELECT patient_id FROM patient) USING (patient_id) GROUP BY 1, 2""",
)
def record_chunks(spark, d):
    out = chunking.record_chunks(load(spark, d, "record"), load(spark, d, "patient"))
    return out.groupBy("patient_id", "section_title").agg(F.count(F.lit(1)).alias("chunks"), F.sum("word_count").cast("bigint").alias("words"))


@query("patient_chunks", """SELECT patient_id, 'Patient: ' || first_name || ' ' || last_name || ', ' || date_sub('year', date_of_birth, DATE '2024-01-15') || ' y/o ' || gender || chr(10) || concat_ws(chr(10), 'MRN: ' || medical_record_number, CASE WHEN is_smoker THEN 'Smoking status: Current smoker' END,
    'Primary clinician: ' || primary_clinician, CASE WHEN allergies <> '' THEN 'Allergies: ' || replace(allergies, '|', ', ') END, CASE WHEN risk_flags <> '' THEN 'Risk flags: ' || risk_flags END) AS content FROM patient""")
def patient_chunks(spark, d):
    return chunking.patient_chunks(load(spark, d, "patient"), AS_OF).select("patient_id", "content")


@query("medication_chunks")
def medication_chunks(spark, d):
    """Greedy line packing, rows checked in the tests."""
    return chunking.medication_chunks(load(spark, d, "medication"), load(spark, d, "patient")).select("patient_id", "chunk_index", "content", "word_count")


@query("all_chunks")
def all_chunks(spark, d):
    return chunking.all_chunks(*[load(spark, d, n) for n in ("patient", "record", "medication", "appointment")], AS_OF)


@query("region_labels_in_text", "SELECT doc_id FROM documents WHERE contains(lower(text), 'chin')")
def region_labels_in_text(spark, d):
    return table(spark, d, "documents").where(F.lower("text").contains(labels.REGIONS["chin"].lower())).select("doc_id")
