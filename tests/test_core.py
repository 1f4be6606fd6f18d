"""Operators without SQL against small references in plain Python, and code that no query runs."""

import base64
import json
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom import catalog
from chartloom.catalog import retrieval as given
from chartloom.functions import stem, wordpiece
from chartloom.operators import chart, evaluate, fulltext, gates, hybrid, ingest, intent, postprocess, vector_index
from chartloom.plans import imports, retrieval
from chartloom.schemas import DDL, conform
from chartloom.sources import bundles, tables
from chartloom.streaming import incremental

SF = "/root/testdata/sf0.001"
AS_OF = "2024-06-01 12:00:00"


@pytest.fixture(scope="module")
def small(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    return docs, vectors, items


def tokens(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def bm25(docs, text, k, fields=None):
    """doc -> (score, rank); ``fields``: (weight, text of a document)."""
    fields = fields or [(2.0, lambda d: d["text"])]
    bags, lengths = {}, {}
    for i, d in docs.items():
        bag = {}
        for w, get in fields:
            for t in tokens(get(d)):
                bag[t] = bag.get(t, 0.0) + w
        bags[i], lengths[i] = bag, sum(len(tokens(get(d))) for _, get in fields)
    mean, n = sum(lengths.values()) / len(docs), len(docs)
    asked = [t for t in tokens(text) if len(t) > 2]
    scores, matched = {}, {}
    for i, bag in bags.items():
        for t in asked:
            if t in bag:
                df = sum(t in b for b in bags.values())
                idf = math.log((n - df + 0.5) / (df + 0.5))
                scores[i] = scores.get(i, 0.0) + (idf if idf > 0 else 1e-6) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
        matched[i] = len({t for t in asked if t in bag})
    full = [i for i in scores if matched[i] == len(set(asked))]
    order = sorted(((round(-scores[i], 6), i) for i in (full or scores)))[:k]
    return {i: (s, r) for r, (s, i) in enumerate(order, 1)}


def search(docs, vectors, text, vector, k, boosts=True):
    """Hybrid search of one query: (score, doc), best first."""
    t = bm25(docs, text, 2 * k)
    v = []
    if vector is not None:
        v = sorted((-round(float(x @ vector), 6), i) for i, x in vectors.items())[: 2 * k]
    parts = {}
    for r, (_, i) in enumerate(v, 1):
        parts[i] = parts.get(i, 0) + 1 / (60 + r)
    for i, (_, r) in t.items():
        parts[i] = parts.get(i, 0) + 1 / (60 + r)
    fused = sorted((-round(s, 6), i) for i, s in parts.items())[: 2 * k]
    hits = [(-s, i) for s, i in fused if i in docs and i in vectors]
    if boosts:
        words = list(dict.fromkeys(w for w in tokens(text) if len(w) >= 3 and w not in given.T.KEYWORD_STOP_WORDS))
        low = {i: docs[i]["text"].lower() for _, i in hits}
        spec = any(text.lower().startswith(s) for s in hybrid.SPEC_STARTS) or any(w in text.lower() for w in hybrid.SPEC_WORDS)
        out = []
        for s, i in hits:
            points = 0.0
            for w in words:
                scale = max(0.0, 1 - sum(w in x for x in low.values()) / len(low) / 0.5)
                c = low[i]
                edge = f" {w} " in c or f" {w}." in c or f" {w}," in c or c.startswith(w + " ") or c.endswith(" " + w)
                points += (scale * (2 if edge else 1)) if w in c else 0
            s += min(0.2, 0.05 * points)
            body = docs[i]["text"]
            p = 3 * (body.count("|") >= 3) + bool(re.search(r"\d", body)) + 2 * sum(bool(re.search(x.replace(r"\p{Nd}", r"\d"), body)) for x in hybrid.SPEC_PATTERNS)
            out.append((s + (min(0.15, p * 0.03) if spec and p >= 3 else 0), i))
        hits = out
    return sorted(hits, key=lambda x: (-x[0], x[1]))[:k]


def test_hybrid_search(spark, small):
    docs, vectors, items = small
    got = {}
    for r in catalog.QUERIES["hybrid_search"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for q, text in items.items():
        want = search(docs, vectors, text, vectors.get(q), 10)
        mine = sorted(got.get(q, []))
        assert [d for _, d, _ in mine] == [d for _, d in want]
        assert np.allclose([s for _, _, s in mine], [s for s, _ in want], atol=2e-6)


def keep_distinct(texts):
    kept, out = [], []
    for i, t in enumerate(texts):
        words = {w for w in re.split(r"[\W_]+", t.lower()) if len(w) >= 3}
        if len(words) < 5 or all(len(words & k) / len(words | k) < 0.75 for k in kept):
            kept.append(words)
            out.append(i)
    return out


def test_dedup_and_mmr(spark, small):
    docs, vectors, items = small
    near = {}
    for r in catalog.QUERIES["dedup_jaccard"](spark, SF).collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    chosen = {}
    for r in catalog.QUERIES["mmr_select"](spark, SF).collect():
        chosen.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    for q, text in items.items():
        hits = [i for i, _ in sorted(bm25(docs, text, 10).items(), key=lambda x: x[1][1])]
        score = {i: -s for i, (s, _) in bm25(docs, text, 10).items()}
        assert [d for _, d in sorted(near.get(q, []))] == [hits[i] for i in keep_distinct([docs[h]["text"] for h in hits])]
        left, picked = list(hits), []
        while left and len(picked) < 5:
            def value(i):
                sims = [float(vectors[i] @ vectors[j]) for j in picked if i in vectors and j in vectors]
                return 0.7 * score[i] - 0.3 * max([0.0, *sims])
            best = max(left, key=value)
            picked.append(best)
            left.remove(best)
        if len(hits) <= 5:
            picked = hits
        assert [d for _, d in sorted(chosen.get(q, []))] == picked


def test_single_pass_and_verified(spark):
    contexts = {r["query_id"]: r["context"] for r in catalog.QUERIES["single_pass_query"](spark, SF).collect()}
    corpus, asked = given.corpus(spark, SF), given.queries(spark, SF)
    used, again = retrieval.ask(corpus, asked, given.AS_OF)
    rows = used.collect()
    for q, text in contexts.items():
        mine = sorted((r["position"], r["content"]) for r in rows if r["query_id"] == q)
        assert [p for p, _ in mine] == list(range(len(mine))) and len(mine) <= 8
        assert text.count("--- Source ") >= len(mine) and all(c in text for _, c in mine)
    verified = {r["query_id"]: r for r in catalog.QUERIES["verified_query"](spark, SF).collect()}
    assert set(verified) == set(contexts)
    for r in verified.values():
        share = sum(r[n] for n in gates.NAMES) / 9
        assert abs(r["overall_score"] - share) < 1e-12 and r["confidence"] == ("high" if share >= 0.85 else "medium" if share >= 0.55 else "low")


class Hashed(vector_index.Provider):
    """A vector by the length of the text."""

    dimension = 2

    def embed(self, docs):
        return docs.select("chunk_id", F.array((F.length("content") % 5).cast("double"), F.lit(1.0)).alias("embedding"))


def tiny_corpus(spark):
    rows = [("a", "p1", "patient has psoriasis and dermatitis", "medication"), ("b", "p1", "psoriasis treated by phototherapy", "note"), ("c", "p2", "dermatitis of the hand", "note"), ("d", "p2", "nothing to see here", "note"), ("e", "p2", "biopsy after phototherapy", "note")]
    chunks = spark.createDataFrame(rows, "chunk_id string, patient_id string, content string, clinical_category string").withColumns({"section_title": F.lit("Note"), "patient_name": F.lit("Ann"), "contextual_prefix": F.lit("")})
    vectors = spark.createDataFrame([(r[0], [float(i), 1.0]) for i, r in enumerate(rows)], "chunk_id string, embedding array<double>")
    return retrieval.Corpus(chunks, vectors, fulltext.build(chunks, {"content": 2.0}))


def test_deep_think_follows_up(spark):
    corpus = tiny_corpus(spark)
    asked = spark.createDataFrame([("q", "psoriasis hand", None)], "query_id string, text string, embedding array<double>")
    plain = {r["doc_id"] for r in retrieval.search(corpus, asked, 8).collect()}
    used, contexts = retrieval.deep_think(corpus, asked, AS_OF)
    deep = {r["doc_id"] for r in used.collect()}
    assert plain == {"a", "b", "c"} and deep == {"a", "b", "c", "e"} and contexts.count() == 1
    more = {r["doc_id"] for r in retrieval.deep_think(corpus, asked, AS_OF, provider=Hashed())[0].collect()}
    assert more == {"a", "b", "c", "d", "e"}  # vectors of the follow-ups reach every chunk


def test_reindex_in_versions(spark, tmp_path):
    corpus = tiny_corpus(spark)
    path = f"file://{tmp_path}/index"
    asked = spark.createDataFrame([("q", "treating psoriasis", None)], "query_id string, text string, embedding array<double>")
    made = retrieval.reindex(spark, corpus.chunks, corpus.vectors, path, {"content": 2.0}, stem=True)
    opened = retrieval.open_index(spark, path)
    assert made.text.stem is opened.text.stem is True
    found = sorted(map(tuple, retrieval.search(opened, asked, 5).select("doc_id", F.round("score", 6)).collect()))
    assert found == sorted(map(tuple, retrieval.search(made, asked, 5).select("doc_id", F.round("score", 6)).collect())) and found[0][0] in "ab"
    old = retrieval.open_index(spark, path)
    retrieval.reindex(spark, corpus.chunks.where("chunk_id != 'b'"), corpus.vectors, path, {"content": 2.0})
    assert old.chunks.count() == 5 and retrieval.open_index(spark, path).chunks.count() == 4  # the old version is whole until dropped
    assert retrieval.drop_versions(spark, path) == 1 and retrieval.open_index(spark, path).text.stem is False


def test_four_fields_and_repeated_ids(spark):
    rows = [("1", "fever cough", "Plan", "Ann Lee", "note"), ("2", "cough", "Fever", "Bo", "fever"), ("3", "rash fever fever", "Plan", "Fever Jones", "note"), ("4", "calm", "x", "y", "z"), ("5", "quiet", "x", "y", "z"), ("6", "still", "x", "y", "z"), ("7", "more", "x", "y", "z")]
    docs = spark.createDataFrame([*rows, rows[0]], "chunk_id string, content string, section_title string, patient_name string, clinical_category string").withColumn("patient_id", F.lit("p"))
    index = fulltext.build(docs)
    assert index.stats.first()["n_docs"] == 7 and index.lengths.count() == 7
    asked = spark.createDataFrame([("q", "fever")], "query_id string, text string")
    got = {r["doc_id"]: r["score"] for r in fulltext.search(index, asked, 10, 6).collect()}
    plain = {r[0]: dict(zip(("content", "section", "name", "category"), r[1:])) for r in rows}
    fields = [(2.0, lambda d: d["content"]), (1.5, lambda d: d["section"]), (1.0, lambda d: d["name"]), (1.0, lambda d: d["category"])]
    assert got == {i: s for i, (s, _) in bm25(plain, "fever", 10, fields).items()}


@pytest.mark.parametrize(("text", "n"), [("fever", 1), ("fever.", 1), ('"fever" AND (cough*)', 1), ("fever unseen", 1), ("fever cough", 1), ("", 0), ("f", 0), ("NEAR/3 -fever:", 1)])
def test_query_texts_with_signs(spark, text, n):
    docs = spark.createDataFrame([("1", "Patient has fever. Cough too."), ("2", "All well.")], "chunk_id string, content string").withColumn("patient_id", F.lit("p"))
    index = fulltext.build(docs, {"content": 2.0})
    assert fulltext.search(index, spark.createDataFrame([("q", text)], "query_id string, text string"), 5).count() == n


def test_stems():
    known = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat sized:size hopping:hop falling:fall hissing:hiss failing:fail happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formality:formal sensibility:sensibl triplicate:triplic formative:form electrical:electr goodness:good revival:reviv allowance:allow adjustable:adjust replacement:replac adoption:adopt activate:activ effective:effect probate:probat rate:rate controlling:control rolling:roll"
    pairs = [p.split(":") for p in known.split()]
    assert {a: stem.stem(a) for a, _ in pairs} == dict(pairs)


def test_word_pieces():
    vocabulary = {"un": 1, "##aff": 2, "##able": 3, "able": 4, ",": 5, "a": 6}
    assert wordpiece.pieces("Unaffable, able a x", vocabulary, 0) == [1, 2, 3, 4, 6, 0]  # signs are dropped


def test_word_vectors_and_providers(spark):
    words = spark.createDataFrame([("fever", [3.0, 0.0]), ("rash", [0.0, 4.0])], "word string, vector array<double>")
    docs = spark.createDataFrame([("1", "Fever, rash"), ("2", "none"), ("3", "fever fever")], "chunk_id string, content string")
    missing, ready = vector_index.WordVectors(None, 2), vector_index.WordVectors(words, 2)
    assert vector_index.first_available([missing, ready]) is ready
    got = {r["chunk_id"]: r["embedding"] for r in ready.embed(docs).collect()}
    assert np.allclose(got["1"], [0.6, 0.8]) and got["2"] == [0.0, 0.0] and np.allclose(got["3"], [1.0, 0.0])
    stored = vector_index.StoredVectors(spark.createDataFrame([("1", [1.0])], "chunk_id string, embedding array<double>"), 1)
    assert [tuple(r) for r in stored.embed(docs).collect()] == [("1", [1.0])]
    with pytest.raises(ValueError, match="3 chunks but 1 vectors"):
        vector_index.check_counts(docs, stored.vectors)


def result(i, **k):
    base = {"id": f"c{i}", "query": "q", "answer_match": True, "abstention_correct": False, "latency_seconds": float(i), "tokens_generated": 10, "context_overflow": False, "warnings": []}
    return base | k


@pytest.mark.parametrize("values", [[1.0], [1.0, 2.0, 3.0], list(range(1, 101)), [5.0] * 40, [0.1] * 99 + [1e6], [*np.random.default_rng(3).exponential(size=500)]])
def test_p95_is_an_exact_rank(spark, values):
    rows = [json.dumps(result(i, latency_seconds=float(v))) for i, v in enumerate(values)]
    df = spark.createDataFrame([(r,) for r in rows], "v string").select(F.from_json("v", DDL["eval_result"]).alias("r")).select("r.*")
    want = sorted(map(float, values))[min(math.floor(len(values) * 0.95), len(values) - 1)]
    assert evaluate.metrics(df).first()["p95_latency"] == want


def test_empty_evaluation_and_reports(spark):
    empty = spark.createDataFrame([], DDL["eval_result"])
    m = evaluate.metrics(empty).first()
    assert (m["total_cases"], m["pass_rate"], m["unsupported_claim_rate"], m["context_overflow_rate"], m["exact_value_accuracy"], m["p95_latency"]) == (0, 0.0, 1.0, 1.0, 0.0, 0.0)
    rows = spark.createDataFrame([(json.dumps(result(1)),), (json.dumps(result(2, answer_match=False)),)], "v string").select(F.from_json("v", DDL["eval_result"]).alias("r")).select("r.*")
    measured = evaluate.metrics(rows)
    texts = {(r["kind"], json.loads(r["json"]).get("id")): json.loads(r["json"]) for r in evaluate.report_json(measured, rows).collect()}
    assert texts["metrics", None]["total_cases"] == 2 and texts["result", "c2"]["answer_match"] is False and texts["result", "c1"]["latency_seconds"] == 1.0
    assert list(texts["result", "c1"]) == sorted(texts["result", "c1"])
    report = evaluate.report_markdown(measured, rows, "run")
    assert report.startswith("# Evaluation: run") and "passed 1, failed 1" in report and "- c2: q" in report and report.count("| fail |") >= 1


def test_cases_tokens_labels_and_seed(spark, tmp_path):
    path = tmp_path / "cases.jsonl"
    path.write_text('// comment\n\n{"id": "1", "query": "q", "category": "c"}\n{"id": "2"\n{"query": "no id"}\n  {"id": "3", "query": "r", "tags": ["t"]}\n')
    good, dropped = bundles.read_cases(spark, f"file://{path}")
    assert sorted(r["id"] for r in good.collect()) == ["1", "3"] and dropped == 2
    body = base64.urlsafe_b64encode(json.dumps({"sub": "ü?>", "exp": 5}).encode()).decode().rstrip("=")
    statement = json.dumps({"rest": [{"security": {"service": [{"text": "OAuth"}, {"coding": [{"display": "SMART", "code": "s"}, {"code": "b"}]}, {"text": "OAuth"}]}}, {}]})
    r = spark.createDataFrame([(f"h.{body}.s", statement)], "t string, c string").select(bundles.jwt_payload(F.col("t"), "sub string, exp int").alias("p"), bundles.security_labels(F.col("c")).alias("l")).first()
    assert (r["p"]["sub"], r["p"]["exp"], r["l"]) == ("ü?>", 5, ["OAuth", "SMART", "b"])
    assert chart.seed_demo(spark, 7).select("patient_id").distinct().count() == 7


def test_bundles_and_saves(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"entry": [{"resource": {"id": "p1", "gender": "female"}}, {}, {"resource": {"id": "p2"}}]}))
    good, warnings = bundles.read_bundles(spark, f"file://{tmp_path}/a.json", "Patient")
    assert [r["id"] for r in good.orderBy("position").collect()] == ["p1", "p2"] and warnings == []
    (tmp_path / "b.json").write_text("{not json")
    bad, warnings = bundles.read_bundles(spark, f"file://{tmp_path}/b.json", "Patient")
    assert bad.count() == 0 and warnings == ["Patient: 1 unreadable"]
    none, warnings = bundles.read_bundles(spark, f"file://{tmp_path}/missing.json", "Patient")
    assert none.count() == 0 and warnings[0].startswith("Patient: ")
    tables.save(good, f"file://{tmp_path}/saved")
    assert spark.read.parquet(f"file://{tmp_path}/saved").count() == 2


def patient(i, **k):
    return {"patient_id": i, "first_name": "Ann", "last_name": "Lee", "medical_record_number": "", "medical_record_number_system": ""} | k


def frame(spark, rows, entity):
    df = spark.createDataFrame([(json.dumps(r),) for r in rows], "v string").select(F.from_json("v", DDL[entity]).alias("r")).select("r.*")
    return conform(df, entity)


def test_upsert_of_patients(spark):
    stored = frame(spark, [patient("s1", source_record_identifier="x", source_system_name="sys", blood_type="A"), patient("s2", medical_record_number="7", medical_record_number_system="m"), patient("s3", medical_record_number="8", medical_record_number_system="m"), patient("s4")], "patient")
    incoming = frame(spark, [
        patient("i1", source_record_identifier="x", source_system_name="sys", last_name="New"),
        patient("i2", source_record_identifier="q", source_system_name="sys", medical_record_number="7", medical_record_number_system="m", last_name="Number"),
        patient("i3", source_record_identifier="x", source_system_name="sys", medical_record_number="8", medical_record_number_system="m"),
        patient("i4", source_record_identifier="n", source_system_name="sys"),
    ], "patient")
    merged, ambiguous = ingest.upsert_patients(stored, incoming)
    rows = {r["patient_id"]: r for r in merged.collect()}
    assert [r[0] for r in ambiguous.collect()] == ["i3"] and set(rows) == {"s1", "s2", "s3", "s4", "i4"}
    assert rows["s1"]["last_name"] == "New" and rows["s1"]["blood_type"] == "A" and rows["s2"]["last_name"] == "Number"


def test_patients_without_source(spark):
    """One stored patient without a source is a match of all such incoming ones, two make them ambiguous; no all-pairs join."""
    incoming = frame(spark, [patient(f"i{k}") for k in range(50)], "patient")
    one = frame(spark, [patient("s1")], "patient")
    assert {(r[0], r[1]) for r in ingest.match_patients(one, incoming).collect()} == {(f"i{k}", "s1") for k in range(50)}
    many = frame(spark, [patient(f"s{k}") for k in range(40)], "patient")
    assert ingest.match_patients(many, incoming).count() == 100
    assert ingest.upsert_patients(many, incoming)[1].count() == 50


def test_import_of_a_patient(spark):
    stored = {e: spark.createDataFrame([], DDL[e]) for e in ("patient", "record", "medication", "appointment")}
    raw = lambda kind, *rs: bundles.unwrap(spark.createDataFrame([(json.dumps({"entry": [{"resource": r} for r in rs]}),)], "value string"), kind)[0]
    feeds = {
        "Patient": raw("Patient", {"id": "p", "name": [{"family": "Lee", "given": ["Ann"]}], "birthDate": "1980-02-03"}),
        "Condition": raw("Condition", {"id": "c1", "code": {"text": "Eczema"}}, {"id": "c1", "code": {"text": "again"}}, {"id": "c2", "code": {"text": "Rash"}}),
        "MedicationRequest": spark.createDataFrame([(1,)], "wrong int"),
        "AllergyIntolerance": raw("AllergyIntolerance", {"id": "a", "code": {"text": "Nuts"}}),
    }
    out, summary = imports.import_patient(stored, feeds, "https://example.test", AS_OF)
    assert summary["created"] and summary["counts"] == {"record": 2, "medication": 0, "appointment": 0}
    assert len(summary["warnings"]) == 3 and out["record"].count() == 2 and out["patient"].first()["allergies"] == ["Nuts"]
    again, second = imports.import_patient(out, feeds, "https://example.test", AS_OF)
    assert not second["created"] and second["counts"]["record"] == 0 and again["record"].count() == 2 and again["patient"].first()["allergies"] == ["Nuts"]
    with pytest.raises(ValueError, match="missing"):
        imports.import_patient(stored, feeds | {"Patient": feeds["Patient"].limit(0)}, "b", AS_OF)


def test_stream_of_changes(spark, tmp_path):
    folder, out = tmp_path / "in", f"file://{tmp_path}/out"
    kind = "key string, n int, at int"
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], kind).write.parquet(f"file://{folder}/1")
    for path in ("1", "2"):
        if path == "2":
            spark.createDataFrame([("b", 9, 3), ("c", 5, 3)], kind).write.parquet(f"file://{folder}/2")
        changes = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"file://{folder}")
        incremental.merge_changes(changes, out, "key", "at", f"file://{tmp_path}/check").awaitTermination()
    first, second = (sorted(tuple(r) for r in spark.read.parquet(f"{out}/v{v}").select("key", "n").collect()) for v in (0, 1))
    assert first == [("a", 2), ("b", 1)] and second == [("a", 2), ("b", 9), ("c", 5)]


def test_gates_by_hand(spark):
    q = spark.createDataFrame([("1", "compare allergy and plan", "The plan is metoprolol daily. " * 3), ("2", "list all", "short"), ("3", "what then", "fine words here")], "query_id string, text string, response string")
    h = spark.createDataFrame([("1", "a", 1, "Metoprolol 50 mg\nother", "medication", "allergy", "Ann", "p1"), ("1", "b", 2, "status active", "note", "plan", "Bo", "p1"), ("1", "c", 3, "was discontinued", "note", "plan", "Bo", "p1"), ("2", "d", 1, "aspirin", "medication", "x", "Bo", "p1")], "query_id string, doc_id string, rank int, content string, source_type string, clinical_category string, patient_name string, patient_id string")
    got = lambda df: {r["query_id"]: r["passed"] for r in df.collect()}
    assert got(gates.contradiction_sweep(q, h)) == {"1": False, "2": True, "3": True}
    assert got(gates.quote_faithfulness(q, h)) == {"1": True, "2": True, "3": True}
    assert got(gates.quote_faithfulness(q.withColumn("response", F.lit("take atenolol now")), h)) == {"1": False, "2": False, "3": True}
    assert got(gates.answer_completeness(q, h)) == {"1": False, "2": False, "3": True}


def test_batched_lines(spark):
    rows = [(f"p{i:02d}", "x" * n) for i, n in enumerate([3, 3, 3, 20, 2, 2, 2, 9, 1])]
    got = {}
    for r in intent.batch_lines(spark.createDataFrame(rows, "patient_id string, line string"), 10).collect():
        got.setdefault(r["batch"], []).append((r["patient_id"], r["line"]))
    want, total = [], None
    for p, line in rows:
        if total is None or total + len(line) + 1 > 10:
            want.append([])
            total = 0
        want[-1].append((p, line))
        total += len(line) + 1
    assert [sorted(got[k]) for k in sorted(got)] == want


def test_postprocess_of_given_hits(spark):
    h = spark.createDataFrame([("q", i, f"word{i} " * 12 + "tail.", 1.0 - i / 10, i + 1, None) for i in range(9)], "query_id string, doc_id int, content string, score double, rank int, embedding array<double>")
    q = spark.createDataFrame([("q", "word3 tail")], "query_id string, text string")
    used = postprocess.process(h.withColumn("contextual_prefix", F.lit("")), q, AS_OF, 4).orderBy("position").collect()
    assert len(used) == 4 and sorted(r["position"] for r in used) == [0, 1, 2, 3]


def greedy(sizes, limit):
    """Lengths of greedy runs."""
    runs, total = [], 0
    for s in sizes:
        if runs and total + s <= limit:
            runs[-1] += 1
            total += s
        else:
            runs.append(1)
            total = s
    return runs


def test_medication_and_all_chunks(spark):
    from chartloom.catalog import layout
    from chartloom.operators import chunking, complexity

    meds = layout.load(spark, SF, "medication")
    lines = meds.select("patient_id", "written_date", "rx_id", chunking.medication_line(meds.columns).alias("line")).collect()
    by = {}
    for r in sorted(lines, key=lambda r: (r["written_date"], r["rx_id"]), reverse=True):
        by.setdefault(r["patient_id"], []).append(r["line"])
    texts = spark.createDataFrame([(p, "\n".join(x)) for p, x in by.items()], "patient_id string, content string")
    limit = {r["patient_id"]: r["chunk_words"] for r in complexity.analyze(texts, "content").collect()}
    got = {}
    for r in catalog.QUERIES["medication_chunks"](spark, SF).collect():
        got.setdefault(str(r["patient_id"]), {})[r["chunk_index"]] = (r["content"], r["word_count"])
    words = lambda t: len([w for w in t.split(" ") if w])
    assert set(got) <= {str(p) for p in by}
    for p, x in by.items():
        if str(p) not in got:
            continue
        whole = words("\n".join(x))
        runs = [len(x)] if whole <= limit[str(p)] else greedy([words(t) for t in x], limit[str(p)])
        want, at = [], 0
        for n in runs:
            part = x[at : at + n]
            want.append(("\n".join(part), whole if len(runs) == 1 and whole <= limit[str(p)] else sum(map(words, part))))
            at += n
        assert [got[str(p)][k] for k in sorted(got[str(p)])] == want
    every = catalog.QUERIES["all_chunks"](spark, SF)
    kinds = {r["source_type"]: r["count"] for r in every.groupBy("source_type").count().collect()}
    assert kinds["medication"] == sum(len(x) for x in got.values()) and len(kinds) == 4
    assert kinds["appointment"] == catalog.QUERIES["appointment_chunks"](spark, SF).count() and kinds["clinicalRecord"] == catalog.QUERIES["record_chunks"](spark, SF).agg(F.sum("chunks")).first()[0]
    assert every.select("chunk_id").distinct().count() == every.count()


def test_stemmed_search_of_four_fields_whole(spark):
    """``bm25_stemmed`` against BM25 in plain Python: folded and stemmed words of all four fields with their weights."""
    import unicodedata

    docs = given.chunks(spark, SF).collect()
    fold = lambda w: "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
    cut = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    stems: dict[str, str] = {}
    term = lambda w: stems.setdefault(w, stem.stem(fold(w)))
    weights = dict(fulltext.SETTINGS.field_weights)
    tf, length = {}, {}
    for r in docs:
        own: dict[str, float] = {}
        length[r["chunk_id"]] = 0
        for f, w in weights.items():
            words = cut(r[f])
            length[r["chunk_id"]] += len(words)
            for x in words:
                own[term(x)] = own.get(term(x), 0.0) + w
        tf[r["chunk_id"]] = own
    n, mean = len(docs), sum(length.values()) / len(docs)
    df: dict[str, int] = {}
    for own in tf.values():
        for t in own:
            df[t] = df.get(t, 0) + 1
    want = {}
    for q in given.queries(spark, SF).collect():
        asked = [term(w) for w in cut(q["text"]) if len(w) > 2]
        scored = []
        for i, own in tf.items():
            hit = {t for t in asked if t in own}
            if hit:
                s = 0.0
                for t in asked:
                    if t in own:
                        idf = math.log((n - df[t] + 0.5) / (df[t] + 0.5))
                        s += (idf if idf > 0 else 1e-6) * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * length[i] / mean))
                scored.append((len(hit) < len(set(asked)), round(-s, 6), i))
        best = [x for x in sorted(scored) if x[0] == min(scored)[0]][:10] if scored else []
        want[q["query_id"]] = [(i, s) for _, s, i in best]
    got: dict = {q: [] for q in want}
    for r in sorted(catalog.QUERIES["bm25_stemmed"](spark, SF).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for q, rows in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in rows] and np.allclose([s for _, s in got[q]], [s for _, s in rows], atol=2e-6), q


def test_word_pieces_of_a_real_vocabulary(spark, tmp_path):
    """Ids, frame and mask of every item against the tokenizers library, with 49,000 pieces read from a JSON file."""
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from chartloom.functions import vectors

    known = json.load(open(public.path("word_bpe_49k.json")))["model"]["vocab"]
    words = [w.removesuffix("</w>") for w in known if w.endswith("</w>")]
    pieces = dict.fromkeys([w for w in words if w] + ["##" + w for w in words if w] + [w for w in known if not w.endswith("</w>")] + ["[UNK]"])
    vocabulary = {w: i + 1000 for i, w in enumerate(pieces)}
    (tmp_path / "vocabulary.json").write_text(json.dumps(vocabulary))
    loaded = wordpiece.load_vocabulary(spark, f"file://{tmp_path}/vocabulary.json")
    assert loaded == vocabulary and len(loaded) > 49_000
    model = tokenizers.models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10_000)
    whole = tokenizers.Tokenizer(model)
    ids = wordpiece.wordpiece(spark, loaded, vocabulary["[UNK]"])
    table = spark.read.parquet(f"{SF}/benchmark.parquet").select("text")
    framed, mask = vectors.model_inputs(F.col("ids"))
    compared = 0
    for r in table.select("text", ids(F.col("text")).alias("ids")).select("text", "ids", framed.alias("framed"), mask.alias("mask")).collect():
        plain = ["".join(c for c in w if c.isalnum() or c in "-'") for w in r["text"].lower().split(" ")]
        want = [i for w in plain if w for i in whole.encode(w, add_special_tokens=False).ids]
        if vocabulary["[UNK]"] not in want:
            assert r["ids"] == want
            compared += 1
        frame = [101, *r["ids"][:510], 102]
        assert r["framed"] == frame + [0] * (512 - len(frame)) and r["mask"] == [1] * len(frame) + [0] * (512 - len(frame))
    assert compared > 30


@pytest.mark.parametrize("with_provider", [False, True])
def test_deep_think_whole(spark, with_provider):
    """``deep_think`` and ``deep_think_vectors`` against their passes made one by one: a hit counts from where it was first found."""
    corpus, base = given.corpus(spark, SF), given.queries(spark, SF)
    provider = given.word_provider(spark, SF) if with_provider else None
    kind = base.schema["embedding"].dataType.simpleString()
    first, asked = {}, [(r["query_id"], r["text"], r["embedding"]) for r in base.collect()]
    hits_schema, vector_passes = None, 0
    for number in range(retrieval.SETTINGS.passes):
        parts: dict = {}
        for q, text, vector in sorted(asked, key=lambda x: (x[0], x[1])):
            parts.setdefault(q, []).append((text, vector))
        keyed = [(f"{q}|{i}", text, vector) for q, own in parts.items() for i, (text, vector) in enumerate(own, 1)]
        frame = spark.createDataFrame(keyed, f"query_id string, text string, embedding {kind}")
        found = retrieval.search(corpus, frame, retrieval.SETTINGS.multi_pass_top_k, use_vectors=number == 0 or with_provider)
        hits_schema = found.schema
        for r in found.collect():
            q, part = r["query_id"].split("|")
            vector_passes += number > 0 and r["vector_rank"] is not None
            at = (number, int(part), r["rank"])
            key = (int(q), r["doc_id"])
            if key not in first or at < first[key][0]:
                first[key] = (at, r)
        rows = [(q, *[r[c] for c in found.columns if c != "query_id"]) for (q, _), (_, r) in first.items()]
        columns = ["query_id", *[c for c in found.columns if c != "query_id"]]
        kinds = {f.name: f.dataType.simpleString() for f in hits_schema} | {"query_id": "bigint"}
        unique = spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds[c]}" for c in columns))
        more = retrieval.follow_ups(unique, base)
        vectors = {r["chunk_id"]: r["embedding"] for r in provider.embed(more.select(F.col("text").alias("chunk_id"), F.col("text").alias("content")).distinct()).collect()} if with_provider else {}
        asked = [(r["query_id"], r["text"], [float(x) for x in vectors[r["text"]]] if r["text"] in vectors else None) for r in more.collect()]
        if not asked:
            break
    want = postprocess.process(unique, base, given.AS_OF, retrieval.SETTINGS.multi_pass_max_chunks).select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")
    order = lambda df: sorted(map(tuple, df.select("query_id", "position", "doc_id", "score").collect()))
    assert order(catalog.QUERIES["deep_think_vectors" if with_provider else "deep_think"](spark, SF)) == order(want)
    assert not vector_passes or with_provider
