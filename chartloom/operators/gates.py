"""Nine quality gates over (query, response, chunks) and the confidence tier.

Inputs: ``queries`` (query_id, text, response and, for gate E, embedding of the
response) and ``hits`` (query_id, doc_id, rank, content, score, patient_id,
clinical_category, source_type, patient_name, embedding), as far as present.
Every gate gives one row per query: query_id, passed.  By default the response
is whatever the caller passes; verifying the answer instead of the context is
the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.text import SEPARATOR, any_contains, evidence_terms
from chartloom.functions.vectors import dot
from chartloom.operators.vector_index import centroid
from chartloom.sources import versions

#: Fixed values.
OPPOSITES = (("active", "discontinued"), ("improving", "worsening"), ("resolved", "persistent"))
DRUG_SUFFIXES = ("mab", "nib", "olol", "pril", "sartan", "statin", "mycin", "cillin", "azole")
NUMBER = r"(?i)\p{Nd}+\.?\p{Nd}*\s*(mg|mcg|ml|g|kg|units?|%|mmol|μg|iu)"
COMPARED = ("allergy", "medication", "appointment", "record", "plan")
NAMES = ("retrievalConfidence", "evidenceCoverage", "numericSanity", "contradictionSweep", "semanticGrounding", "quoteFaithfulness", "generationQuality", "answerCompleteness", "patientIsolation")


def _per_query(queries: DataFrame, found: DataFrame, passed: Column) -> DataFrame:
    return queries.select("query_id", *[c for c in queries.columns if c != "query_id"]).join(found, "query_id", "left").select("query_id", passed.alias("passed"))


def _joined_content(hits: DataFrame, lower: bool) -> DataFrame:
    text = F.lower("content") if lower else F.col("content")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "doc_id", text.alias("c"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), " ").alias("__all"))


def retrieval_confidence(queries: DataFrame, hits: DataFrame, least: float = 0.01) -> DataFrame:
    """The first chunk's score (GAT-A)."""
    first = hits.groupBy("query_id").agg(F.min_by("score", "rank").alias("__top"))
    return _per_query(queries, first, F.coalesce(F.col("__top") >= least, F.lit(False)))


def evidence_coverage(queries: DataFrame, hits: DataFrame, least: float = 0.5) -> DataFrame:
    """Share of the response's terms found as substrings of the chunks (GAT-B)."""
    terms = evidence_terms(F.col("response"))
    covered = F.size(F.filter(terms, lambda t: F.coalesce(F.col("__all"), F.lit("")).contains(t)))
    return _per_query(queries, _joined_content(hits, True), F.when(F.size(terms) == 0, True).otherwise(covered / F.greatest(F.size(terms), F.lit(1)) >= least))


def numbers(text: Column) -> Column:
    """Number-and-unit strings, lower-cased, duplicates kept, inner space kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.lower(n))


def numeric_sanity(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Fails when more than half (rounded down) of the response's numbers have no source (GAT-C)."""
    mine, theirs = numbers(F.col("response")), numbers(F.coalesce("__all", F.lit("")))
    missing = F.size(F.filter(mine, lambda n: ~F.array_contains(theirs, n)))
    return _per_query(queries, _joined_content(hits, False), missing <= F.floor(F.size(mine) / 2))


def contradictions(hits: DataFrame) -> DataFrame:
    """Opposite words, as substrings, within one patient and category (GAT-D): query_id, patient_id, clinical_category, pair."""
    low = F.lower("content")
    has = [F.bool_or(low.contains(w)).alias(f"__{w}") for pair in OPPOSITES for w in pair]
    groups = hits.groupBy("query_id", "patient_id", "clinical_category").agg(F.count(F.lit(1)).alias("__n"), *has).where("__n > 1")
    pairs = F.array_compact(F.array(*[F.when(F.col(f"__{a}") & F.col(f"__{b}"), F.lit(f"{a}/{b}")) for a, b in OPPOSITES]))
    return groups.select("query_id", "patient_id", "clinical_category", F.explode(pairs).alias("pair"))


def contradiction_sweep(queries: DataFrame, hits: DataFrame) -> DataFrame:
    found = contradictions(hits).groupBy("query_id").agg(F.count(F.lit(1)).alias("__n"))
    return _per_query(queries, found, F.col("__n").isNull())


def semantic_grounding(queries: DataFrame, hits: DataFrame, least: float = 0.4) -> DataFrame:
    """Response vector against the plain mean of the chunk vectors; no vector of the response passes (GAT-E)."""
    means = centroid(hits.where(F.size("embedding") > 0).select("query_id", "embedding"), ["query_id"])
    some = hits.select("query_id").distinct().withColumn("__some", F.lit(True))
    near = F.coalesce(dot(F.col("embedding"), F.col("centroid")), F.lit(0.0)) >= least
    return _per_query(queries, some.join(means, "query_id", "left"), F.when(F.col("__some").isNull(), False).when(F.col("embedding").isNull(), True).otherwise(near))


def quote_faithfulness(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Drug-like words of the response must start a medication line (GAT-F)."""
    lines = hits.where("source_type = 'medication'").select("query_id", F.explode(F.split("content", "[\n\r]")).alias("line"))
    first = F.lower(F.element_at(F.split(F.regexp_replace("line", r"^[ \t]+|[ \t]+$", ""), " "), 1))
    names = lines.groupBy("query_id").agg(F.collect_set(first).alias("__names"))

    def drug_like(w):
        out = F.lit(False)
        for s in DRUG_SUFFIXES:
            out = out | w.endswith(s)
        return out & (F.length(w) > 4)

    words = F.filter(F.array_distinct(F.split(F.lower("response"), SEPARATOR)), drug_like)
    return _per_query(queries, names, F.when(F.col("__names").isNull(), True).otherwise(F.size(F.array_except(words, F.coalesce("__names", F.array().cast("array<string>")))) == 0))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _gram_counts(words: Column, n: int) -> Column:
    """How often each distinct n-gram of a word array occurs: lengths of the runs in the sorted 64-bit hashes; nothing leaves the row."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))

    def runs(h):
        starts = F.filter(F.transform(h, lambda x, i: F.when((i == 0) | (x != F.get(h, i - 1)), i)), lambda i: i.isNotNull())
        return _let(starts, lambda s: F.transform(s, lambda p, i: F.coalesce(F.get(s, i + 1), F.size(h)) - p))

    return F.when(F.size(words) >= n, _let(F.sort_array(hashes), runs))


def ngram_stats(texts: DataFrame, key: str = "query_id", text: str = "response") -> DataFrame:
    """Per text: words of two characters or more, bigram entropy, unique ratio, commonest trigram (AGG-11)."""
    words = texts.select(key, F.filter(F.split(F.lower(text), SEPARATOR), lambda w: F.length(w) >= 2).alias("w"))
    counts = words.select(key, F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("__unique"), _gram_counts(F.col("w"), 2).alias("__two"), F.array_max(_gram_counts(F.col("w"), 3)).cast("bigint").alias("top_trigram"))
    # The entropy of counts c with sum T: log2 T - sum(c log2 c) / T.
    total = F.greatest(F.col("n_words") - 1, F.lit(1))
    own = F.aggregate(F.transform("__two", lambda c: c * F.log2(c.cast("double"))), F.lit(0.0), lambda a, b: a + b)
    entropy = F.when(F.col("__two").isNotNull(), F.log2(total.cast("double")) - own / total)
    return counts.select(key, "n_words", (F.col("__unique") / F.greatest("n_words", F.lit(1))).alias("unique_ratio"), entropy.alias("bigram_entropy"), "top_trigram")


def generation_quality(queries: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Neither terse nor repetitive (GAT-G)."""
    stats = ngram_stats(queries)
    n = F.col("n_words")
    low = F.coalesce(F.col("bigram_entropy") < F.when(n < 50, 1.5).otherwise(2.0), F.lit(False))
    loops = F.coalesce((F.col("top_trigram") >= 4) & (F.col("top_trigram") / F.greatest(n - 2, F.lit(1)) > 0.2), F.lit(False))
    ok = F.when(n < 6, False).when(n < 20, True).otherwise(~low & (F.col("unique_ratio") >= 0.35) & ~loops)
    return queries.select("query_id").join(stats, "query_id").select("query_id", ok.alias("passed"))


def answer_completeness(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Several areas, comparisons and enumerations are answered as asked (GAT-H)."""
    by_category = hits.withColumn("__t", F.struct("rank", evidence_terms(F.col("content")).alias("t"))).groupBy("query_id", "clinical_category").agg(F.array_sort(F.collect_list("__t")).alias("__t"))
    terms = by_category.select("query_id", "clinical_category", F.slice(F.flatten(F.transform("__t", lambda x: x["t"])), 1, 5).alias("terms"))
    cats = terms.groupBy("query_id").agg(F.collect_list(F.struct("clinical_category", "terms")).alias("__cats"))
    people = hits.groupBy("query_id").agg(F.collect_set(F.lower("patient_name")).alias("__people"))
    q, r = F.lower("text"), F.lower("response")
    several = q.contains(" and ") | q.contains("then") | q.contains("after")
    cats_n = F.coalesce(F.size("__cats"), F.lit(0))
    matched = F.size(F.filter("__cats", lambda c: F.exists(c["terms"], lambda t: r.contains(t))))
    thin = several & (cats_n >= 2) & (matched < 2)
    compares = any_contains(q, ("compare", "difference", " versus ", " vs "))
    named = F.size(F.filter("__people", lambda p: r.contains(p)))
    people_missing = compares & (F.size("__people") >= 2) & (named < 2)
    covered = F.size(F.filter("__cats", lambda c: r.contains(F.lower(c["clinical_category"]))))
    asked = F.filter(F.array(*[F.lit(w) for w in COMPARED]), lambda w: q.contains(w))
    items_missing = compares & (cats_n >= 2) & (covered < 2) & (F.size(asked) >= 2) & (F.size(F.filter(asked, lambda w: r.contains(w))) < 2)
    lists = any_contains(q, ("list", "all", "what are"))
    terse = lists & (F.size(F.filter(F.split("response", " "), lambda w: w != "")) < 20) & ~any_contains(F.col("response"), ("- ", "•", "\n"))
    bad = F.lit(False)
    for part in (thin, people_missing, items_missing, terse):
        bad = bad | F.coalesce(part, F.lit(False))
    return queries.join(cats, "query_id", "left").join(people, "query_id", "left").select("query_id", (~bad).alias("passed"))


def patient_isolation(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """All chunks belong to one patient (GAT-I)."""
    n = hits.groupBy("query_id").agg(F.count_distinct("patient_id").alias("__n"))
    return _per_query(queries, n, F.coalesce(F.col("__n") <= 1, F.lit(True)))


GATES = dict(zip(NAMES, (retrieval_confidence, evidence_coverage, numeric_sanity, contradiction_sweep, semantic_grounding, quote_faithfulness, generation_quality, answer_completeness, patient_isolation)))


def tier(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.55, "medium").otherwise("low")


def verify(queries: DataFrame, hits: DataFrame, hard_isolation: bool = False) -> DataFrame:
    """One column per gate, the share passed and the tier; ``hard_isolation`` makes a mix of patients "low"."""
    # Nine gates read the same few rows of every query: written once, they need no cache that somebody has to release.
    spark = queries.sparkSession
    queries, hits = (versions.stored(df, versions.scratch(spark, "gates")) for df in (queries, hits))
    out = queries.select("query_id")
    for name, gate in GATES.items():
        out = out.join(gate(queries, hits).withColumnRenamed("passed", name), "query_id")
    score = sum((F.col(n).cast("int") for n in NAMES), F.lit(0)) / F.lit(float(len(NAMES)))
    confidence = F.when(~F.col("patientIsolation"), "low").otherwise(tier(score)) if hard_isolation else tier(score)
    return out.withColumn("overall_score", score).withColumn("confidence", confidence)
