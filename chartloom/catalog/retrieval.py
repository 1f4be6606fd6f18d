"""Indexes, hybrid search and what follows it, over documents, embeddings and benchmark.

A document is a chunk (source = patient, lang = category); a benchmark item is
a query of its whole text with the vector of the same number; every item is asked.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.catalog.registry import AS_OF, query, quoted
from chartloom.functions import text as T
from chartloom.functions import vectors as V
from chartloom.functions.wordpiece import wordpiece
from chartloom.operators import fulltext, hybrid, postprocess, vector_index
from chartloom.plans import retrieval
from chartloom.sources import versions
from chartloom.sources.tables import table

SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def chunks(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("patient_id"), F.col("text").alias("content"), F.col("lang").alias("clinical_category"), F.col("source").alias("patient_name"),
        F.concat(F.lit("["), "source", F.lit("]")).alias("contextual_prefix"), F.lit("Note").alias("section_title"), F.lit("clinicalRecord").alias("source_type"),
        F.timestamp_seconds(F.unix_seconds(F.lit(AS_OF).cast("timestamp")) - F.col("doc_id") * 86400).alias("date_recorded"),
    )


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", F.concat(F.lit("src"), F.col("label").cast("string")).alias("scope"))


def queries(spark, d, scoped: bool = False):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    out = b.join(v, "query_id", "left")
    return out.withColumn("scope", F.concat(F.lit("src"), (F.col("query_id") % 10).cast("string"))) if scoped else out


def index(spark, d, fields=None, stem=False):
    """A new index of the documents, stored once for the searches of one query; a standing one is written by ``retrieval.reindex``."""
    docs = chunks(spark, d).select("chunk_id", "patient_id", *(fields or ["content"]))
    return fulltext.build(docs, {"content": 2.0} if fields is None else fields, stem=stem).kept(versions.scratch(spark, "text-index"))


def _bm25(scoped: bool, k: int) -> str:
    return f"""tok AS (SELECT doc_id, source, unnest(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda x: x <> '')) AS term FROM documents),
    tf AS (SELECT doc_id, term, 2.0::DOUBLE * count(*) AS f FROM tok GROUP BY 1, 2), dl AS (SELECT d.doc_id, d.source, coalesce(n, 0) AS len FROM documents d LEFT JOIN (SELECT doc_id, count(*) n FROM tok GROUP BY 1) USING (doc_id)),
    st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM dl), dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda x: length(x) > 2)) AS term FROM benchmark) GROUP BY 1, 2),
    nt AS (SELECT query_id, count(*) AS n_terms FROM qt GROUP BY 1),
    hit AS (SELECT query_id, doc_id, source, times * (CASE WHEN ln((st.n - df + 0.5) / (df + 0.5)) > 0 THEN ln((st.n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len / avgdl)) AS s FROM qt JOIN tf USING (term) JOIN dfr USING (term) JOIN dl USING (doc_id), st),
    sc AS (SELECT query_id, doc_id, round(-sum(s), 6) AS score, count(*) AS matched FROM hit {"WHERE source = 'src' || (query_id % 10)" if scoped else ""} GROUP BY 1, 2),
    fl AS (SELECT *, max(CASE WHEN matched = n_terms THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS every FROM sc JOIN nt USING (query_id)),
    bm AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id) AS rank FROM fl WHERE every = 0 OR matched = n_terms) WHERE rank <= {k})"""


def _knn(scoped: bool, k: int) -> str:
    return f"""kn AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
    FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark) {"AND e.label = q.vec_id % 10" if scoped else ""})) WHERE rank <= {k})"""


def _rrf(k: int) -> str:
    return f"""rrf AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + kn.rank), 0) + coalesce(1.0::DOUBLE / (60 + bm.rank), 0), 6) AS score
    FROM kn FULL JOIN bm USING (query_id, doc_id))) WHERE rank <= {2 * k})"""


_RANKED = "SELECT query_id, doc_id, score, CAST(rank AS BIGINT) AS rank FROM"


def _ranked(df):
    return df.select("query_id", "doc_id", "score", F.col("rank").cast("bigint").alias("rank"))


@query("token_df_top", f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda x: length(x) > 2)) AS term FROM documents) GROUP BY 1 ORDER BY df DESC, term LIMIT 50")
def token_df_top(spark, d):
    terms = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(50)


@query("query_tokens", f"SELECT item_id AS query_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda x: length(x) > 2), ' ') AS terms FROM benchmark")
def query_tokens(spark, d):
    return queries(spark, d).select("query_id", F.array_join(T.search_tokens(F.col("text")), " ").alias("terms"))


@query("corpus_stats", f"SELECT count(*) AS n_docs, round(avg(len(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda x: x <> ''))), 6) AS avg_length FROM documents")
def corpus_stats(spark, d):
    return fulltext.build(chunks(spark, d), {"content": 2.0}).stats.select("n_docs", F.round("avg_length", 6).alias("avg_length"))


@query("bm25_topk", f"WITH {_bm25(False, 10)} {_RANKED} bm")
def bm25_topk(spark, d):
    return _ranked(fulltext.search(index(spark, d), queries(spark, d), 10, 6))


@query("bm25_scoped", f"WITH {_bm25(True, 10)} {_RANKED} bm")
def bm25_scoped(spark, d):
    return _ranked(fulltext.search(index(spark, d), queries(spark, d, True), 10, 6))


@query("bm25_stemmed")
def bm25_stemmed(spark, d):
    """Stemmed, accent-free, over all four fields."""
    return _ranked(fulltext.search(index(spark, d, dict(retrieval.SETTINGS.field_weights), True), queries(spark, d), 10, 6))


@query("vector_topk", f"WITH {_knn(False, 10)} {_RANKED} kn")
def vector_topk(spark, d):
    return _ranked(vector_index.search(vectors(spark, d), queries(spark, d).where("embedding is not null"), 10, digits=6))


@query("vector_topk_scoped", f"WITH {_knn(True, 10)} {_RANKED} kn")
def vector_topk_scoped(spark, d):
    return _ranked(vector_index.search(vectors(spark, d), queries(spark, d, True).where("embedding is not null"), 10, scope="scope", digits=6))


@query("vector_normalized", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS length FROM embeddings")
def vector_normalized(spark, d):
    e = vector_index.normalize(table(spark, d, "embeddings"))
    return e.select("vec_id", F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 5).alias("length"))


@query("vector_centroid", "SELECT label, pos - 1 AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2")
def vector_centroid(spark, d):
    c = vector_index.centroid(table(spark, d, "embeddings"), ["label"])
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


@query("vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def vector_upsert(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "chunk_id")
    return vector_index.upsert(e, e.where("chunk_id % 7 = 0").withColumn("label", F.lit(-1))).select(F.col("chunk_id").alias("vec_id"), "label")


@query("vector_resized", "SELECT vec_id, 80 AS padded, 16 AS cut FROM embeddings")
def vector_resized(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(V.resized(e, 80)).alias("padded"), F.size(V.resized(e, 16)).alias("cut"))


@query("vector_resized_values", "SELECT vec_id, pos - 1 AS pos, CASE WHEN pos <= len(embedding) THEN embedding[pos]::DOUBLE ELSE 0 END AS padded, CASE WHEN pos <= 16 THEN embedding[pos]::DOUBLE END AS cut FROM (SELECT vec_id, embedding, unnest(range(1, 81)) AS pos FROM embeddings)")
def vector_resized_values(spark, d):
    """Every value of the vectors padded to 80 and cut to 16."""
    e = F.col("embedding")
    wide = table(spark, d, "embeddings").select("vec_id", V.resized(e, 16).alias("short"), F.posexplode(V.resized(e, 80)).alias("pos", "padded"))
    return wide.select("vec_id", F.col("pos").cast("bigint").alias("pos"), F.col("padded").cast("double").alias("padded"), F.get("short", F.col("pos")).cast("double").alias("cut"))


@query("rrf_fusion", f"WITH {_bm25(False, 20)}, {_knn(False, 20)}, {_rrf(10)} {_RANKED} rrf")
def rrf_fusion(spark, d):
    t = fulltext.search(index(spark, d), queries(spark, d), 20, 6)
    v = vector_index.search(vectors(spark, d), queries(spark, d).where("embedding is not null"), 20, digits=6)
    return _ranked(hybrid.fuse(v, t, 10, 6))


_HITS = f"WITH {_bm25(False, 10)}, hits AS (SELECT query_id, doc_id, -score AS score, text AS content, rank FROM bm JOIN documents USING (doc_id)), q AS (SELECT item_id AS query_id, text FROM benchmark)"


def _hits(spark, d):
    h = fulltext.search(index(spark, d), queries(spark, d), 10, 6)
    # Ten rows of numbers an item: they go to the texts, which stay where they lie.
    return F.broadcast(h).join(chunks(spark, d).withColumnRenamed("chunk_id", "doc_id"), "doc_id").withColumn("score", -F.col("score"))


_STOP = ", ".join(quoted(w) for w in T.KEYWORD_STOP_WORDS)
_BOUND = "contains(c, ' ' || w || ' ') OR contains(c, ' ' || w || '.') OR contains(c, ' ' || w || ',') OR starts_with(c, w || ' ') OR ends_with(c, ' ' || w)"


@query("keywords", f"SELECT query_id, string_agg(w, ' ' ORDER BY w) AS keywords FROM (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))) AS w FROM benchmark) GROUP BY 1")
def keywords(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.array_sort(T.keywords(F.col("text"))), " ").alias("keywords"))


@query(
    "keyword_boost",
    f"""{_HITS}, kw AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPLIT}'), lambda x: length(x) >= 3 AND x NOT IN ({_STOP}))) AS w FROM q),
    pr AS (SELECT query_id, doc_id, w, lower(content) AS c FROM hits JOIN kw USING (query_id)), kb AS (SELECT *, greatest(0, 1 - avg(CASE WHEN contains(c, w) THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY query_id, w) / 0.5::DOUBLE) AS scale FROM pr),
    b AS (SELECT query_id, doc_id, least(0.2::DOUBLE, 0.05::DOUBLE * sum(CASE WHEN contains(c, w) THEN scale + CASE WHEN {_BOUND} THEN scale ELSE 0 END ELSE 0 END)) AS boost FROM kb GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score + coalesce(boost, 0), 6) AS score FROM hits LEFT JOIN b USING (query_id, doc_id)""",
)
def keyword_boost(spark, d):
    return hybrid.keyword_boost(_hits(spark, d), queries(spark, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_SPEC = " OR ".join([f"starts_with(lower(text), {quoted(s)})" for s in hybrid.SPEC_STARTS] + [f"contains(lower(text), {quoted(s)})" for s in hybrid.SPEC_WORDS])
_POINTS = "CASE WHEN length(content) - length(replace(content, '|', '')) >= 3 THEN 3 ELSE 0 END + CASE WHEN regexp_matches(content, '\\p{Nd}') THEN 1 ELSE 0 END + " + " + ".join(f"CASE WHEN regexp_matches(content, {quoted(p)}) THEN 2 ELSE 0 END" for p in hybrid.SPEC_PATTERNS)


@query("spec_queries", f"SELECT item_id, {_SPEC} AS asks FROM benchmark")
def spec_queries(spark, d):
    return table(spark, d, "benchmark").select("item_id", hybrid.is_spec_query(F.col("text")).alias("asks"))


@query("structure_points", f"SELECT doc_id, {_POINTS} AS points FROM (SELECT doc_id, text AS content FROM documents)")
def structure_points(spark, d):
    return table(spark, d, "documents").select("doc_id", hybrid.structure_points(F.col("text")).alias("points"))


@query("structure_boost", f"{_HITS} SELECT query_id, doc_id, round(score + CASE WHEN ({_SPEC}) AND p >= 3 THEN least(0.15, p * 0.03) ELSE 0 END, 6)::DOUBLE AS score FROM (SELECT *, {_POINTS} AS p FROM hits) JOIN q USING (query_id)")
def structure_boost(spark, d):
    return hybrid.structure_boost(_hits(spark, d), queries(spark, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


_WORDS = "list_distinct(list_filter(string_split(lower({}), ' '), lambda w: w <> ''))"


@query(
    "rerank_heuristic",
    f"""{_HITS} SELECT query_id, doc_id, round(score + len(list_intersect({_WORDS.format('q.text')}, {_WORDS.format('content')}))::DOUBLE / greatest(1, len({_WORDS.format('q.text')})) * 0.1 + CASE WHEN doc_id < 30 THEN 0.05 WHEN doc_id < 90 THEN 0.03 WHEN doc_id < 365 THEN 0.01 ELSE 0 END, 6)::DOUBLE AS score FROM hits JOIN q USING (query_id)""",
)
def rerank_heuristic(spark, d):
    return postprocess.rerank(_hits(spark, d), queries(spark, d), AS_OF).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("rerank_external", f"{_HITS} SELECT query_id, doc_id, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY doc_id * 7919 % 1000 DESC, doc_id) AS rank FROM hits")
def rerank_external(spark, d):
    h = _hits(spark, d)
    given = h.select("query_id", "doc_id", (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("score"))
    return _ranked(postprocess.rerank(h, queries(spark, d), AS_OF, given))


@query(
    "token_budget",
    f"""{_HITS}, t AS (SELECT *, len(list_filter(string_split('[' || source || '] ' || content, ' '), lambda w: w <> '')) + 2 AS tokens FROM hits JOIN (SELECT doc_id, source FROM documents) USING (doc_id)),
    u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) + 20 AS used FROM t), o AS (SELECT *, sum(CASE WHEN used > 2796 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS over FROM u),
    a AS (SELECT *, 2796 - (used - tokens) AS room, floor((2796 - (used - tokens)) / greatest(0.8::DOUBLE, tokens::DOUBLE / greatest(1, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))))) AS allowed FROM o)
    SELECT query_id, doc_id, over = 1 AS truncated FROM a WHERE over = 0 OR (over = 1 AND room >= 50 AND allowed > 10)""",
)
def token_budget(spark, d):
    h = _hits(spark, d).withColumn("__len", F.length("content"))
    return postprocess.fit_budget(h).select("query_id", "doc_id", (F.length("content") != F.col("__len")).alias("truncated"))


@query("lost_in_middle", f"{_HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM hits) SELECT query_id, doc_id, CASE WHEN n <= 2 THEN i WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS position FROM n")
def lost_in_middle(spark, d):
    return postprocess.lost_in_middle(_hits(spark, d)).select("query_id", "doc_id", F.col("position").cast("bigint").alias("position"))


@query("assembled_context", f"""{_HITS}, b AS (SELECT query_id, string_agg('--- Source ' || rank || ' [Note] ' || strftime(TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY * doc_id, '%b %-d, %Y') || ' ---' || chr(10) || '[' || source || ']' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS context
    FROM hits JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY 1) SELECT query_id, coalesce(context, '{postprocess.EMPTY_CONTEXT}') AS context FROM q LEFT JOIN b USING (query_id)""")
def assembled_context(spark, d):
    h = _hits(spark, d).withColumn("position", F.col("rank") - 1)
    return postprocess.assemble(h, queries(spark, d))


@query("dedup_jaccard")
def dedup_jaccard(spark, d):
    return postprocess.deduplicate(_hits(spark, d).select("query_id", "doc_id", "content", "rank")).select("query_id", "doc_id", "rank")


@query("mmr_select")
def mmr_select(spark, d):
    h = _hits(spark, d).select("query_id", "doc_id", "score", "rank").join(vectors(spark, d).select(F.col("chunk_id").alias("doc_id"), "embedding"), "doc_id", "left")
    return postprocess.diversify(h, 5).select("query_id", "doc_id", "rank")


def corpus(spark, d):
    return retrieval.Corpus(chunks(spark, d), vectors(spark, d).select("chunk_id", "embedding"), index(spark, d))


@query("hybrid_search")
def hybrid_search(spark, d):
    return _ranked(retrieval.search(corpus(spark, d), queries(spark, d), 10, digits=6)).withColumn("score", F.round("score", 6))


@query("hybrid_plain", f"WITH {_bm25(False, 20)}, {_knn(False, 20)}, {_rrf(10)} SELECT query_id, doc_id, score, n AS rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM rrf WHERE doc_id IN (SELECT doc_id FROM documents) AND doc_id IN (SELECT vec_id FROM embeddings)) WHERE n <= 10")
def hybrid_plain(spark, d):
    """Fusion and resolution without boosts."""
    return _ranked(retrieval.search(corpus(spark, d), queries(spark, d), 10, boosts=False, digits=6))


@query("single_pass_query")
def single_pass_query(spark, d):
    return retrieval.ask(corpus(spark, d), queries(spark, d), AS_OF)[1]


@query("verified_query")
def verified_query(spark, d):
    return retrieval.ask_verified(corpus(spark, d), queries(spark, d), AS_OF)[2]


@query("follow_up_queries", f"{_HITS}, f AS (SELECT DISTINCT query_id, term FROM hits JOIN q USING (query_id), (SELECT unnest([{', '.join(quoted(t) for t in retrieval.FOLLOW_UP_TERMS)}]) AS term) WHERE contains(lower(content), term) AND NOT contains(lower(q.text), term)) SELECT query_id, term AS text FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY term) <= 3")
def follow_up_queries(spark, d):
    return retrieval.follow_ups(_hits(spark, d).drop("clinical_category"), queries(spark, d))


@query("deep_think")
def deep_think(spark, d):
    return retrieval.deep_think(corpus(spark, d), queries(spark, d), AS_OF)[0].select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")


def word_provider(spark, d) -> vector_index.WordVectors:
    """Vectors of 64 numbers, made from its hash, for every word of the items and of the follow-up terms."""
    follow = spark.createDataFrame([(t,) for t in retrieval.FOLLOW_UP_TERMS], "text string")
    known = table(spark, d, "benchmark").select("text").unionAll(follow).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    values = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.pmod(F.xxhash64("word", i), F.lit(2001)) / 1000 - 1)
    return vector_index.WordVectors(known.select("word", values.alias("vector")), 64)


@query("deep_think_vectors")
def deep_think_vectors(spark, d):
    """The same with a provider: follow-ups are searched by text and by vector."""
    return retrieval.deep_think(corpus(spark, d), queries(spark, d), AS_OF, provider=word_provider(spark, d))[0].select("query_id", "doc_id", F.round("score", 6).alias("score"), "position")


@query("source_summaries", f"{_HITS} SELECT query_id, doc_id, left(content, 150) AS preview FROM hits")
def source_summaries(spark, d):
    return retrieval.summaries(_hits(spark, d)).select("query_id", "doc_id", "preview")


@query("wordpiece")
def wordpiece_ids(spark, d):
    vocabulary = {w: i for i, w in enumerate(["the", "and", *"abcdefghijklmnopqrstuvwxyz", *["##" + c for c in "abcdefghijklmnopqrstuvwxyz"], "th", "##er", "##ion", "[UNK]"])}
    ids = wordpiece(spark, vocabulary, vocabulary["[UNK]"])
    out = table(spark, d, "benchmark").select("item_id", ids(F.col("text")).alias("ids"))
    framed, mask = V.model_inputs(F.col("ids"))
    return out.select("item_id", F.size("ids").alias("n_pieces"), F.size(framed).alias("padded"), F.aggregate(mask, F.lit(0), lambda a, b: a + b).alias("used"))


@query("word_vectors")
def word_vectors(spark, d):
    words = spark.createDataFrame([("the", [1.0, 0.0]), ("and", [0.0, 1.0])], "word string, vector array<double>")
    out = vector_index.word_average(table(spark, d, "benchmark").withColumnRenamed("item_id", "chunk_id"), words, 2)
    return out.select("chunk_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


_WORD_TABLE = f"SELECT DISTINCT term AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '{SPLIT}')) AS term FROM documents) WHERE length(term) > 3"


@query(
    "word_vectors_of_corpus",
    f"""WITH wv AS (SELECT word, [length(word)::DOUBLE, unicode(word)::DOUBLE, unicode(reverse(word))::DOUBLE] AS v FROM ({_WORD_TABLE})), w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '{SPLIT}')) AS word FROM benchmark),
    m AS (SELECT item_id, avg(v[1]) AS a, avg(v[2]) AS b, avg(v[3]) AS c FROM w JOIN wv USING (word) GROUP BY 1)
    SELECT item_id AS chunk_id, round(coalesce(a / greatest(n, 1e-9), 0), 6) AS x, round(coalesce(b / greatest(n, 1e-9), 0), 6) AS y, round(coalesce(c / greatest(n, 1e-9), 0), 6) AS z FROM benchmark LEFT JOIN (SELECT *, sqrt(a * a + b * b + c * c) AS n FROM m) USING (item_id)""",
)
def word_vectors_of_corpus(spark, d):
    """Items as means over a vocabulary of all longer words of the corpus, each with three numbers of its own."""
    known = table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).where(F.length("word") > 3).distinct()
    vocabulary = known.select("word", F.array(F.length("word").cast("double"), F.ascii("word").cast("double"), F.ascii(F.reverse("word")).cast("double")).alias("vector"))
    out = vector_index.word_average(table(spark, d, "benchmark").withColumnRenamed("item_id", "chunk_id"), vocabulary, 3)
    return out.select("chunk_id", *[F.round(F.get("embedding", F.lit(i)), 6).alias(c) for i, c in enumerate("xyz")])


@query("mean_pooling", "SELECT text_id, pos - 1 AS pos, round(m / greatest(n, 1e-9), 6) AS x FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY text_id)) AS n FROM (SELECT text_id, pos, avg(x) AS m FROM (SELECT vec_id // 16 AS text_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings WHERE vec_id % 3 = 0) GROUP BY 1, 2))")
def mean_pooling(spark, d):
    """Sixteen vectors that follow one another are the tokens of a text; every third counts, the others are masked."""
    e = table(spark, d, "embeddings").withColumn("text_id", F.floor(F.col("vec_id") / 16))
    g = e.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("t"))  # 16 rows a group
    g = g.select("text_id", F.transform("t", lambda x: x["embedding"]).alias("v"), F.transform("t", lambda x: (x["vec_id"] % 3 == 0).cast("int")).alias("m")).where(F.exists("m", lambda x: x == 1))
    return g.select("text_id", F.posexplode(V.mean_pooled(F.col("v"), F.col("m"))).alias("pos", "x")).select("text_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 6).alias("x"))


def flagship(spark, d):
    """Hybrid search of the benchmark queries, best ten each."""
    return hybrid_search(spark, d)
