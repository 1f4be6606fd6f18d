"""The nine gates.  The response of a query is its benchmark text; its chunks are its ten BM25 hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.catalog.registry import ORACLE_SQL, query, quoted
from chartloom.catalog.retrieval import _HITS, SPLIT, _hits, vectors
from chartloom.catalog.retrieval import queries as base_queries
from chartloom.functions import text as T
from chartloom.operators import gates
from chartloom.sources.tables import spread_table, table


def asked(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("response"))
    return base_queries(spark, d).join(b, "query_id")


def evidence(spark, d):
    v = vectors(spark, d).select(F.col("chunk_id").alias("doc_id"), "embedding")
    return _hits(spark, d).join(v, "doc_id", "left")


_Q = _HITS + ", r AS (SELECT item_id AS query_id, text AS response FROM benchmark), al AS (SELECT query_id, string_agg(content, ' ' ORDER BY rank) AS t FROM hits GROUP BY 1)"
_ALL = "coalesce(t, '')"
_EV = ", ".join(quoted(w) for w in T.EVIDENCE_STOP_WORDS)


def _numbers(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, {quoted(gates.NUMBER)}), lambda x: lower(x))"


@query("gate_retrieval_confidence", f"{_Q} SELECT query_id, coalesce(bool_or(rank = 1 AND score >= 0.01), false) AS passed FROM r LEFT JOIN hits USING (query_id) GROUP BY 1")
def gate_retrieval_confidence(spark, d):
    return gates.retrieval_confidence(asked(spark, d), evidence(spark, d))


@query("gate_evidence_coverage", f"{_Q} SELECT query_id, CASE WHEN len(e) = 0 THEN true ELSE len(list_filter(e, lambda x: contains(coalesce(lower(t), ''), x))) / len(e)::DOUBLE >= 0.5 END AS passed FROM (SELECT query_id, list_filter(regexp_split_to_array(lower(response), '{SPLIT}'), lambda x: length(x) > 3 AND x NOT IN ({_EV})) AS e FROM r) LEFT JOIN al USING (query_id)")
def gate_evidence_coverage(spark, d):
    return gates.evidence_coverage(asked(spark, d), evidence(spark, d))


@query("numeric_tokens", f"SELECT doc_id, array_to_string({_numbers('text')}, '|') AS numbers FROM documents")
def numeric_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(gates.numbers(F.col("text")), "|").alias("numbers"))


@query("gate_numeric_sanity", f"{_Q} SELECT query_id, len(list_filter(n, lambda x: NOT list_contains(s, x))) <= len(n) // 2 AS passed FROM (SELECT query_id, {_numbers('response')} AS n, {_numbers(_ALL)} AS s FROM r LEFT JOIN al USING (query_id))")
def gate_numeric_sanity(spark, d):
    return gates.numeric_sanity(asked(spark, d), evidence(spark, d))



@query(
    "contradiction_sweep",
    "SELECT conv_id AS query_id, role AS clinical_category, pair FROM (SELECT conv_id, role, count(*) AS n, "
    + ", ".join(f"bool_or(contains(lower(text), {quoted(a)})) AS a{i}, bool_or(contains(lower(text), {quoted(b)})) AS b{i}" for i, (a, b) in enumerate(gates.OPPOSITES))
    + " FROM (SELECT conv_id, role, CASE WHEN turn % 4 = 0 THEN text || ' Inactive' WHEN turn % 4 = 1 THEN text || ' discontinued' WHEN turn % 4 = 2 THEN text || ' resolved' ELSE text || ' Persistent' END AS text FROM conversations) GROUP BY 1, 2), (VALUES "
    + ", ".join(f"({quoted(a + '/' + b)}, {i})" for i, (a, b) in enumerate(gates.OPPOSITES))
    + ") v(pair, i) WHERE n > 1 AND CASE i WHEN 0 THEN a0 AND b0 WHEN 1 THEN a1 AND b1 ELSE a2 AND b2 END",
)
def contradiction_sweep(spark, d):
    tail = F.when(F.col("turn") % 4 == 0, " Inactive").when(F.col("turn") % 4 == 1, " discontinued").when(F.col("turn") % 4 == 2, " resolved").otherwise(" Persistent")
    notes = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.lit("p").alias("patient_id"), F.col("role").alias("clinical_category"), F.concat("text", tail).alias("content"))
    return gates.contradictions(notes).select("query_id", "clinical_category", "pair")


_HX = "hx AS (SELECT h.*, source, lang FROM hits h JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id))"
_OPPOSED = [(f"bool_or(contains(lower(content), {quoted(a)}))", f"bool_or(contains(lower(content), {quoted(b)}))") for a, b in gates.OPPOSITES]


@query("gate_contradiction", f"{_Q}, {_HX} SELECT query_id, NOT coalesce(bool_or(bad), false) AS passed FROM r LEFT JOIN (SELECT query_id, count(*) > 1 AND ({' OR '.join(f'({a} AND {b})' for a, b in _OPPOSED)}) AS bad FROM hx GROUP BY query_id, source, lang) USING (query_id) GROUP BY 1")
def gate_contradiction(spark, d):
    return gates.contradiction_sweep(asked(spark, d), evidence(spark, d))


@query(
    "gate_semantic_grounding",
    f"""{_Q}, v AS (SELECT query_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM hits JOIN embeddings ON doc_id = vec_id), c AS (SELECT query_id, pos, avg(x) AS x FROM v GROUP BY 1, 2),
    dt AS (SELECT query_id, sum(x * embedding[pos]::DOUBLE) AS s FROM c JOIN embeddings ON query_id = vec_id GROUP BY 1)
    SELECT query_id, CASE WHEN query_id NOT IN (SELECT query_id FROM hits) THEN false WHEN query_id NOT IN (SELECT vec_id FROM embeddings) THEN true ELSE coalesce(s, 0) >= 0.4 END AS passed FROM r LEFT JOIN dt USING (query_id)""",
)
def gate_semantic_grounding(spark, d):
    return gates.semantic_grounding(asked(spark, d), evidence(spark, d))


_DRUG = " OR ".join(f"ends_with(w, {quoted(x)})" for x in gates.DRUG_SUFFIXES)
_FIRST = r"string_split(regexp_replace(x, '^[ \t]+|[ \t]+$', '', 'g'), ' ')[1]"


@query(
    "gate_quote_faithfulness",
    rf"""{_Q}, l AS (SELECT query_id, list_distinct(flatten(list(list_transform(regexp_split_to_array(content, '[\n\r]'), lambda x: lower({_FIRST}))))) AS names FROM hits GROUP BY 1)
    SELECT query_id, CASE WHEN names IS NULL THEN true ELSE len(list_filter(list_distinct(regexp_split_to_array(lower(response), '{SPLIT}')), lambda w: length(w) > 4 AND ({_DRUG}) AND NOT list_contains(names, w))) = 0 END AS passed FROM r LEFT JOIN l USING (query_id)""",
)
def gate_quote_faithfulness(spark, d):
    return gates.quote_faithfulness(asked(spark, d), evidence(spark, d).withColumn("source_type", F.lit("medication")))


_GRAMS = f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda x: length(x) >= 2) AS w FROM documents),
g2 AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) >= 2) GROUP BY 1, 2), g3 AS (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3) GROUP BY 1, 2),
e AS (SELECT doc_id, -sum(p * log2(p)) AS e FROM (SELECT doc_id, c / sum(c) OVER (PARTITION BY doc_id)::DOUBLE AS p FROM g2) GROUP BY 1), t AS (SELECT doc_id, max(c) AS t FROM g3 GROUP BY 1),
s AS (SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) / greatest(1, len(w))::DOUBLE AS unique_ratio, e AS bigram_entropy, t AS top_trigram FROM w LEFT JOIN e USING (doc_id) LEFT JOIN t USING (doc_id))"""


@query("ngram_stats", f"{_GRAMS} SELECT doc_id, n_words, round(unique_ratio, 6) AS unique_ratio, round(bigram_entropy, 5) AS bigram_entropy, top_trigram FROM s")
def ngram_stats(spark, d):
    s = gates.ngram_stats(spread_table(spark, d, "documents"), "doc_id", "text")
    return s.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.round("unique_ratio", 6).alias("unique_ratio"), F.round("bigram_entropy", 5).alias("bigram_entropy"), "top_trigram")


@query("gate_generation_quality", f"{_GRAMS} SELECT doc_id AS query_id, CASE WHEN n_words < 6 THEN false WHEN n_words < 20 THEN true ELSE NOT (bigram_entropy < CASE WHEN n_words < 50 THEN 1.5 ELSE 2.0 END) AND unique_ratio >= 0.35 AND NOT (top_trigram >= 4 AND top_trigram / greatest(1, n_words - 2)::DOUBLE > 0.2) END AS passed FROM s")
def gate_generation_quality(spark, d):
    return gates.generation_quality(table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("response")))


_COMPARED = f"[{', '.join(quoted(w) for w in gates.COMPARED)}]"
_ANY = lambda text, *words: "(" + " OR ".join(f"contains({text}, {w if w.startswith('chr') else quoted(w)})" for w in words) + ")"


@query(
    "gate_answer_completeness",
    f"""{_Q}, {_HX}, tm AS (SELECT query_id, lang, list_slice(flatten(list(list_filter(regexp_split_to_array(lower(content), '{SPLIT}'), lambda w: length(w) > 3 AND w NOT IN ({_EV})) ORDER BY rank)), 1, 5) AS terms FROM hx GROUP BY 1, 2),
    ca AS (SELECT r.query_id, count(*) AS n, count(*) FILTER (len(list_filter(terms, lambda t: contains(lower(response), t))) > 0) AS matched, count(*) FILTER (contains(lower(response), lower(lang))) AS covered FROM r JOIN tm ON tm.query_id = r.query_id GROUP BY 1),
    pe AS (SELECT r.query_id, count(DISTINCT lower(source)) AS n, count(DISTINCT lower(source)) FILTER (contains(lower(response), lower(source))) AS named FROM r JOIN hx ON hx.query_id = r.query_id GROUP BY 1),
    aq AS (SELECT r.query_id, lower(q.text) AS q, lower(response) AS a, response FROM r JOIN q ON q.query_id = r.query_id),
    fg AS (SELECT aq.*, {_ANY("q", " and ", "then", "after")} AS several, {_ANY("q", "compare", "difference", " versus ", " vs ")} AS compares, {_ANY("q", "list", "all", "what are")} AS lists, list_filter({_COMPARED}, lambda w: contains(q, w)) AS asked, coalesce(ca.n, 0) AS cats, coalesce(matched, 0) AS matched, coalesce(covered, 0) AS covered, coalesce(pe.n, 0) AS people, coalesce(named, 0) AS named
      FROM aq LEFT JOIN ca ON ca.query_id = aq.query_id LEFT JOIN pe ON pe.query_id = aq.query_id)
    SELECT query_id, NOT ((several AND cats >= 2 AND matched < 2) OR (compares AND people >= 2 AND named < 2) OR (compares AND cats >= 2 AND covered < 2 AND len(asked) >= 2 AND len(list_filter(asked, lambda w: contains(a, w))) < 2)
      OR (lists AND len(list_filter(string_split(response, ' '), lambda w: w <> '')) < 20 AND NOT {_ANY("response", "- ", "•", "chr(10)")})) AS passed FROM fg""",
)
def gate_answer_completeness(spark, d):
    return gates.answer_completeness(asked(spark, d), evidence(spark, d))


@query("gate_patient_isolation", f"{_Q} SELECT query_id, count(DISTINCT source) <= 1 AS passed FROM r LEFT JOIN (SELECT query_id, source FROM hits JOIN (SELECT doc_id, source FROM documents) USING (doc_id)) USING (query_id) GROUP BY 1")
def gate_patient_isolation(spark, d):
    return gates.patient_isolation(asked(spark, d), evidence(spark, d))


#: Each gate's own SQL: the response is the item's text, no chunk is a medication line.
_BY_GATE = {
    "retrievalConfidence": ORACLE_SQL["gate_retrieval_confidence"], "evidenceCoverage": ORACLE_SQL["gate_evidence_coverage"], "numericSanity": ORACLE_SQL["gate_numeric_sanity"], "contradictionSweep": ORACLE_SQL["gate_contradiction"],
    "semanticGrounding": ORACLE_SQL["gate_semantic_grounding"], "quoteFaithfulness": "SELECT item_id AS query_id, true AS passed FROM benchmark",
    "generationQuality": "WITH documents AS (SELECT item_id AS doc_id, text FROM benchmark)," + ORACLE_SQL["gate_generation_quality"].removeprefix("WITH"),
    "answerCompleteness": ORACLE_SQL["gate_answer_completeness"], "patientIsolation": ORACLE_SQL["gate_patient_isolation"],
}
_PASSED = " + ".join(f'"{n}"::INT' for n in _BY_GATE)
_GATES = f"""SELECT *, ({_PASSED}) / 9.0::DOUBLE AS overall_score, CASE WHEN ({_PASSED}) / 9.0::DOUBLE >= 0.85 THEN 'high' WHEN ({_PASSED}) / 9.0::DOUBLE >= 0.55 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT item_id AS query_id FROM benchmark) b{"".join(f' JOIN (SELECT query_id, passed AS "{n}" FROM ({sql})) USING (query_id)' for n, sql in _BY_GATE.items())}"""


@query("all_gates", _GATES)
def all_gates(spark, d):
    return gates.verify(asked(spark, d), evidence(spark, d))
