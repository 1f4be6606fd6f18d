"""Scores of evaluation cases, aggregate metrics, gates and reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import any_contains, query_preview, trim_all
from chartloom.operators import order_statistic
from chartloom.sources import versions

#: What an abstaining answer says; gates (name, column, bound, at least?).
ABSTAINED = (
    "i do not know", "i don't know", "not mentioned", "not found",
    "insufficient information", "cannot answer", "no information",
    "abstained", "unable to answer", "don't have information",
)
GATES = (
    ("Retrieval recall@5", "retrieval_recall", 0.85, True),
    ("Citation precision", "citation_precision", 0.90, True),
    ("Exact-value accuracy", "exact_value_accuracy", 0.95, True),
    ("Unsupported-claim rate", "unsupported_claim_rate", 0.05, False),
    ("Correct abstention rate", "correct_abstention_rate", 0.85, True),
    ("Context overflow rate", "context_overflow_rate", 0.02, False),
    ("Visual OCR evidence use", "visual_evidence_rate", 0.90, True),
)
QUALITY_MODES = {"standard": "Standard", "deepthink": "Deep Think", "deep-think": "Deep Think", "deep_think": "Deep Think", "maximum": "Maximum", "max": "Maximum"}
_NO_STRINGS = "array<string>"


def quality_mode(mode):
    """Display name of a mode; unknown and missing ones are standard (EVL-06)."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in QUALITY_MODES.items() for x in p]), F.lower(mode)), F.lit("Standard"))


def by_category(cases: DataFrame, category: str) -> DataFrame:
    return cases.where(F.col("category") == category)


def by_tag(cases: DataFrame, tag: str) -> DataFrame:
    return cases.where(F.coalesce(F.array_contains("tags", tag), F.lit(False)))


def category_counts(cases: DataFrame) -> DataFrame:
    """AGG-08."""
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("cases"))


def score(cases: DataFrame, answers: DataFrame, retrieved: DataFrame | None = None, as_of: str = "2024-01-01 00:00:00") -> DataFrame:
    """One result row per case (EVL-01..05).

    ``answers``: id, generated_response (null: the run failed), latency_seconds,
    error.  Recall is 1 where ground truth exists; with ``retrieved`` (id,
    rank, chunk_id) it is the true recall at 5.
    """
    df = cases.join(answers, "id")
    out, expected = F.lower(trim_all(F.col("generated_response"))), F.lower(trim_all(F.col("expectedAnswer")))
    low = F.lower("generated_response")
    failed = F.col("generated_response").isNull()
    match = ~F.col("shouldAbstain") & (out.contains(expected) | expected.contains(out))
    citations = F.coalesce("expectedCitations", F.array().cast(_NO_STRINGS))
    cited = F.size(F.filter(citations, lambda c: low.contains(F.lower(c))))
    precision = F.when(F.size(citations) == 0, 1.0).otherwise(cited / F.greatest(F.size(citations), F.lit(1)))
    abstained = F.when(F.col("shouldAbstain"), any_contains(low, ABSTAINED)).otherwise(trim_all(F.col("generated_response")) != "")
    truth = F.coalesce("groundTruthChunkIds", F.array().cast(_NO_STRINGS))
    recall = F.when(F.size(truth) > 0, 1.0)
    if retrieved is not None:
        top = retrieved.where("rank <= 5").groupBy("id").agg(F.collect_set("chunk_id").alias("__top"))
        df = df.join(top, "id", "left")
        found = F.size(F.array_intersect(truth, F.coalesce("__top", F.array().cast(_NO_STRINGS))))
        recall = F.when(F.size(truth) > 0, found / F.greatest(F.size(F.array_distinct(truth)), F.lit(1)))
    either = lambda a, b: F.when(failed, F.lit(a)).otherwise(b)
    return df.select(
        "id", "query", F.coalesce("generated_response", F.concat(F.lit("Error: "), F.coalesce("error", F.lit("")))).alias("generated_response"), either(False, match).alias("answer_match"), either(0.0, recall).alias("retrieval_recall"),
        either(0.0, precision).alias("citation_precision"), F.when(failed, F.col("shouldAbstain")).otherwise(abstained).alias("abstention_correct"), "latency_seconds", F.lit(0).alias("tokens_generated"),
        quality_mode(F.col("qualityMode")).alias("quality_mode_used"), F.lit(False).alias("context_overflow"), F.when(failed, F.lit(False)).alias("used_visual_evidence"),
        F.when(failed, F.array(F.concat(F.lit("Evaluation execution failed: "), F.coalesce("error", F.lit(""))))).otherwise(F.array().cast(_NO_STRINGS)).alias("warnings"), F.lit(as_of).cast("timestamp").alias("timestamp"),
    )


def p95(values):
    """The element at index floor(0.95 n) of the sorted values, the last if that is past the end (EVL-08)."""
    n = F.size(values)
    return F.get(F.array_sort(values), F.least(F.floor(n * F.lit(0.95)).cast("int"), n - 1))


_MEASURED = ("retrieval_recall", "citation_precision", "answer_match", "abstention_correct", "context_overflow", "used_visual_evidence", "latency_seconds", "tokens_generated")


def metrics(results: DataFrame) -> DataFrame:
    """One row; an empty run has the worst rates (AGG-09, EVL-07, EVL-09, EVL-11).

    The results are written once to the shared folder.  The percentile is the
    latency at an exact rank, null ones first, found by narrowing.
    """
    results = versions.stored(results.select(*_MEASURED), versions.scratch(results.sparkSession, "results"))
    n = F.count(F.lit(1))
    rate = lambda c, empty: F.coalesce(F.count_if(c) / F.nullif(n, F.lit(0)), F.lit(empty))
    passed = F.col("answer_match") | F.col("abstention_correct")
    speed = F.when(F.col("tokens_generated").isNotNull() & (F.col("latency_seconds") > 0), F.col("tokens_generated") / F.col("latency_seconds"))
    visual = F.count_if(F.col("used_visual_evidence")) / F.nullif(F.count("used_visual_evidence"), F.lit(0))
    base = results.agg(
        F.coalesce(F.avg("retrieval_recall"), F.lit(0.0)).alias("retrieval_recall"), F.coalesce(F.avg("citation_precision"), F.lit(0.0)).alias("citation_precision"), rate(F.col("answer_match"), 0.0).alias("exact_value_accuracy"),
        rate(~F.col("answer_match") & ~F.col("abstention_correct"), 1.0).alias("unsupported_claim_rate"), rate(F.col("abstention_correct"), 0.0).alias("correct_abstention_rate"), rate(F.col("context_overflow"), 1.0).alias("context_overflow_rate"),
        F.coalesce(visual, F.when(n == 0, 0.0).otherwise(1.0)).alias("visual_evidence_rate"), F.coalesce(F.avg("latency_seconds"), F.lit(0.0)).alias("mean_latency"), F.coalesce(F.avg(speed), F.lit(0.0)).alias("mean_tokens_per_second"),
        n.alias("total_cases"), F.count_if(passed).alias("passed_cases"), (n - F.count_if(passed)).alias("failed_cases"),
    )

    total, nulls = results.agg(n, F.count_if(F.col("latency_seconds").isNull())).first()
    rank = min(math.floor(total * 0.95), total - 1) - nulls
    tail = order_statistic.nth(results, "latency_seconds", rank) if rank >= 0 else None
    base = base.withColumn("p95_latency", F.lit(0.0 if tail is None else tail).cast("double"))
    return base.withColumn("pass_rate", F.coalesce(F.col("passed_cases") / F.nullif(F.col("total_cases"), F.lit(0)), F.lit(0.0)))


def gates(measured: DataFrame) -> DataFrame:
    """One row per gate (EVL-10)."""
    rows = [F.struct(F.lit(i).alias("position"), F.lit(name).alias("gate"), F.lit(bound).alias("target"), F.col(c).cast("double").alias("actual"), (F.col(c) >= bound if least else F.col(c) <= bound).alias("passed")) for i, (name, c, bound, least) in enumerate(GATES)]
    return measured.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def report_json(measured: DataFrame, results: DataFrame) -> DataFrame:
    """One JSON text per result and one for the metrics, keys sorted (SNK-02, SNK-04)."""
    whole = lambda df: F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    return measured.select(F.lit("metrics").alias("kind"), whole(measured).alias("json")).unionAll(results.select(F.lit("result"), whole(results)))


def report_markdown(measured: DataFrame, results: DataFrame, title: str, worst: int = 20) -> str:
    """A short report; ``worst`` failed cases are listed (SNK-03)."""
    m = measured.first().asDict()
    lines = [f"# Evaluation: {title}", "", f"Cases {m['total_cases']}, passed {m['passed_cases']}, failed {m['failed_cases']}, pass rate {m['pass_rate']:.3f}.", "", "| Gate | Target | Actual | |", "|-|-|-|-|"]
    bound = {name: least for name, _, _, least in GATES}
    for g in gates(measured).orderBy("position").collect():
        lines.append(f"| {g['gate']} | {'≥' if bound[g['gate']] else '≤'} {g['target']:.2f} | {g['actual']:.3f} | {'pass' if g['passed'] else 'fail'} |")
    failed = results.where(~(F.col("answer_match") | F.col("abstention_correct"))).select("id", query_preview(F.col("query")).alias("q")).orderBy("id").limit(worst)
    return "\n".join([*lines, "", *[f"- {r['id']}: {r['q']}" for r in failed.collect()]]) + "\n"
