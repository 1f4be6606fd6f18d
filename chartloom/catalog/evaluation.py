"""Evaluation runs: cases from labels and documents, answers from the same texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.catalog.registry import query
from chartloom.operators import evaluate
from chartloom.sources.tables import table

CATEGORIES = ("exact", "summary", "comparison")


def cases(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    i = F.col("doc_id")
    return x.select(
        i.cast("string").alias("id"), F.col("text").alias("query"), F.when(F.col("quality") == 1, F.col("text")).otherwise(F.lit("absent answer")).alias("expectedAnswer"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (i % 3 + 1).cast("int")).alias("category"), F.when(i % 2 == 0, F.array(F.lit("x"))).alias("groundTruthChunkIds"),
        F.when(i % 3 == 0, F.array(F.col("lang"), F.lit("@@"))).alias("expectedCitations"), (F.col("toxic") == 1).alias("shouldAbstain"), F.lit(None).cast("string").alias("containerId"),
        F.when(i % 4 == 0, "Deep-Think").alias("qualityMode"), F.array(F.concat(F.lit("t"), (i % 5).cast("string"))).alias("tags"), F.lit(None).cast("string").alias("notes"),
    )


def answers(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    text = F.when(i % 13 == 0, F.lit(None)).when((F.col("toxic") == 1) & (i % 2 == 0), F.lit("I don't know.")).otherwise(F.col("text"))
    return x.select(i.cast("string").alias("id"), text.alias("generated_response"), ((i * 37 % 1000) / 100.0).alias("latency_seconds"), F.lit("timeout").alias("error"))


def results(spark, d):
    return evaluate.score(cases(spark, d), answers(spark, d))


_RESULTS = """SELECT id, doc_id, answer IS NULL AS failed, CASE WHEN answer IS NULL THEN false ELSE toxic <> 1 AND (contains(lower(trim(answer)), expected) OR contains(expected, lower(trim(answer)))) END AS answer_match, CASE WHEN answer IS NULL THEN 0.0 WHEN doc_id % 2 = 0 THEN 1.0 END::DOUBLE AS retrieval_recall,
CASE WHEN answer IS NULL THEN 0.0 WHEN doc_id % 3 = 0 THEN (CASE WHEN contains(lower(answer), lower(lang)) THEN 1 ELSE 0 END + CASE WHEN contains(answer, '@@') THEN 1 ELSE 0 END) / 2.0 ELSE 1.0 END::DOUBLE AS citation_precision,
CASE WHEN answer IS NULL THEN toxic = 1 WHEN toxic = 1 THEN PHRASES ELSE trim(answer) <> '' END AS abstention_correct, (doc_id * 37 % 1000) / 100.0::DOUBLE AS latency_seconds
FROM (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text, lang, toxic, CASE WHEN quality = 1 THEN lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) ELSE 'absent answer' END AS expected, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN toxic = 1 AND doc_id % 2 = 0 THEN 'I don''t know.' ELSE text END AS answer FROM labels JOIN documents USING (doc_id))""".replace(
    "PHRASES", "(" + " OR ".join("contains(lower(answer), '" + p.replace("'", "''") + "')" for p in evaluate.ABSTAINED) + ")"
)


@query("eval_results", f"SELECT id, answer_match, retrieval_recall, citation_precision, abstention_correct, CASE WHEN doc_id % 4 = 0 THEN 'Deep Think' ELSE 'Standard' END AS quality_mode_used, CASE WHEN failed THEN false END AS used_visual_evidence FROM ({_RESULTS})")
def eval_results(spark, d):
    return results(spark, d).select("id", "answer_match", "retrieval_recall", "citation_precision", "abstention_correct", "quality_mode_used", "used_visual_evidence")


@query("eval_category_counts", "SELECT CASE doc_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'summary' ELSE 'comparison' END AS category, count(*) AS cases FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def eval_category_counts(spark, d):
    return evaluate.category_counts(cases(spark, d))


@query("eval_filters", "SELECT CAST(doc_id AS VARCHAR) AS id FROM labels JOIN documents USING (doc_id) WHERE doc_id % 3 = 1 AND doc_id % 5 = 2")
def eval_filters(spark, d):
    return evaluate.by_tag(evaluate.by_category(cases(spark, d), "summary"), "t2").select("id")


_METRICS = f"""SELECT avg(retrieval_recall) AS retrieval_recall, avg(citation_precision) AS citation_precision, count(*) FILTER (answer_match) / count(*)::DOUBLE AS exact_value_accuracy, count(*) FILTER (NOT answer_match AND NOT abstention_correct) / count(*)::DOUBLE AS unsupported_claim_rate,
count(*) FILTER (abstention_correct) / count(*)::DOUBLE AS correct_abstention_rate, 0.0::DOUBLE AS context_overflow_rate, CASE WHEN count(*) FILTER (failed) = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS visual_evidence_rate, avg(latency_seconds) AS mean_latency,
list_sort(list(latency_seconds))[CAST(least(floor(0.95 * count(*)) + 1, count(*)) AS BIGINT)] AS p95_latency, count(*) AS total_cases, count(*) FILTER (answer_match OR abstention_correct) AS passed_cases FROM ({_RESULTS})"""
_RATES = ("retrieval_recall", "citation_precision", "exact_value_accuracy", "unsupported_claim_rate", "correct_abstention_rate", "context_overflow_rate", "visual_evidence_rate", "mean_latency")


@query("eval_metrics", f"SELECT {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)}, total_cases, passed_cases FROM ({_METRICS})")
def eval_metrics(spark, d):
    return evaluate.metrics(results(spark, d)).select(*[F.round(c, 6).alias(c) for c in _RATES], "total_cases", "passed_cases")


@query("eval_p95", f"SELECT p95_latency FROM ({_METRICS})")
def eval_p95(spark, d):
    return evaluate.metrics(results(spark, d)).select("p95_latency")


@query("eval_gates", " UNION ALL ".join(f"SELECT '{name}' AS gate, {bound}::DOUBLE AS target, round({c}, 6) AS actual, {c} {'>=' if least else '<='} {bound} AS passed FROM ({_METRICS})" for name, c, bound, least in evaluate.GATES))
def eval_gates(spark, d):
    return evaluate.gates(evaluate.metrics(results(spark, d))).select("gate", "target", F.round("actual", 6).alias("actual"), "passed")


@query("eval_report_json", f"SELECT count(*) + 1 AS lines FROM ({_RESULTS})")
def eval_report_json(spark, d):
    r = results(spark, d)
    return evaluate.report_json(evaluate.metrics(r), r).agg(F.count("json").alias("lines"))


@query("eval_report_rows", f"SELECT id, answer_match, latency_seconds, CASE WHEN doc_id % 4 = 0 THEN 'Deep Think' ELSE 'Standard' END AS quality_mode_used FROM ({_RESULTS})")
def eval_report_rows(spark, d):
    """The results as the JSON report has them, read back."""
    r = results(spark, d)
    parsed = evaluate.report_json(evaluate.metrics(r), r).where("kind = 'result'").select(F.from_json("json", "id string, answer_match boolean, latency_seconds double, quality_mode_used string").alias("r"))
    return parsed.select("r.*")
