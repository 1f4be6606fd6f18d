"""Retrieval plans over an index: hybrid search, verified and multi-pass queries."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.config import SETTINGS
from chartloom.functions.text import any_contains
from chartloom.operators import fulltext, gates, hybrid, postprocess, vector_index
from chartloom.sources import versions

#: Conditions and procedures that make follow-up queries.
FOLLOW_UP_TERMS = ("melanoma", "psoriasis", "eczema", "dermatitis", "rosacea", "basal cell", "squamous cell", "actinic keratosis", "biopsy", "excision", "cryotherapy", "phototherapy")


@dataclass
class Corpus:
    """Chunks (chunk_id, content, ...), vectors (chunk_id, embedding) and the text index over the chunks."""

    chunks: DataFrame
    vectors: DataFrame
    text: fulltext.TextIndex
    scope: str | None = "patient_id"


def search(corpus: Corpus, queries: DataFrame, k: int = SETTINGS.top_k, boosts: bool = True, digits: int | None = None, use_vectors: bool = True) -> DataFrame:
    """The k best chunks of each query with scores and both ranks (RET-01..06, JON-04, JON-05).

    Both lists are fetched at 2 k.  Hits whose chunk has no vector entry are
    dropped, as they cannot be resolved.
    """
    scoped = corpus.vectors
    wants_scope = corpus.scope and "scope" in queries.columns
    if wants_scope and corpus.scope not in scoped.columns:
        scoped = scoped.join(corpus.chunks.select("chunk_id", corpus.scope), "chunk_id")
    t = fulltext.search(corpus.text, queries, 2 * k, digits=digits)
    v = t.where("false")  # queries without a vector
    if use_vectors:
        v = vector_index.search(scoped, queries.where(F.col("embedding").isNotNull()), 2 * k, scope=corpus.scope if wants_scope else None, digits=digits)
    fused = hybrid.fuse(v, t, k, digits)
    # 2 k rows of numbers a query: they go to the vectors and then to the chunks, which stay where they lie.
    fused = F.broadcast(fused.drop("rank").withColumnRenamed("doc_id", "chunk_id"))
    resolved = fused.join(corpus.vectors.select("chunk_id", "embedding"), "chunk_id")
    hits = F.broadcast(resolved).join(corpus.chunks, "chunk_id").withColumnRenamed("chunk_id", "doc_id")
    if boosts:
        hits = hybrid.structure_boost(hybrid.keyword_boost(hits, queries), queries)
    return hybrid.top(hits, k)


def ask(corpus: Corpus, queries: DataFrame, as_of: str, k: int = SETTINGS.top_k) -> tuple[DataFrame, DataFrame]:
    """(used hits, contexts): single pass (RET-15)."""
    used = postprocess.process(search(corpus, queries, k), queries, as_of)  # at most max_chunks rows a query
    used = versions.stored(used, versions.scratch(queries.sparkSession, "used-hits"))
    return used, postprocess.assemble(used, queries)


def ask_verified(corpus: Corpus, queries: DataFrame, as_of: str, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(used hits, contexts, gates): the context is verified, or the answers (query_id, response) where given."""
    used, contexts = ask(corpus, queries, as_of)
    response = answers if answers is not None else contexts.withColumnRenamed("context", "response")
    return used, contexts, gates.verify(queries.join(response, "query_id"), used)


def follow_ups(hits: DataFrame, queries: DataFrame, limit: int = 3) -> DataFrame:
    """(query_id, text): up to three further queries from what was found (RET-17).

    First words over three characters of medication lines, and known terms that
    the chunks mention and the query does not; alphabetical, then the first three.
    """
    asked = hits.select("query_id", "content", *[c for c in ("clinical_category",) if c in hits.columns]).join(queries.select("query_id", F.lower("text").alias("__q")), "query_id")
    low = F.lower("content")
    terms = F.array_compact(F.array(*[F.when(low.contains(t) & ~F.col("__q").contains(t), F.lit(t)) for t in FOLLOW_UP_TERMS]))
    found = asked.select("query_id", F.explode(terms).alias("text"))
    if "clinical_category" in hits.columns:
        first = F.transform(F.split("content", "\n"), lambda line: F.element_at(F.split(F.regexp_replace(line, r"^[ \t]+|[ \t]+$", ""), " "), 1))
        names = asked.where("clinical_category = 'medication'").select("query_id", F.explode(F.filter(first, lambda w: F.length(w) > 3)).alias("text"))
        found = found.unionAll(names)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("text"))
    return found.distinct().withColumn("__n", rank).where(F.col("__n") <= limit).drop("__n")


def deep_think(corpus: Corpus, queries: DataFrame, as_of: str, passes: int = SETTINGS.passes, provider: vector_index.Provider | None = None) -> tuple[DataFrame, DataFrame]:
    """(used hits, contexts) of bounded multi-pass retrieval (RET-16).

    Each pass searches with the follow-ups of all that was found; an empty list
    makes later passes no-ops.  Follow-ups get vectors from the ``provider``;
    without one they are searched by text alone.  Lineage is cut between passes by checkpoints in
    the session's checkpoint folder: a few rows a query.
    """
    ensure_checkpoint_dir(queries.sparkSession)
    base = queries.select("query_id", "text", "embedding", *[c for c in ("scope",) if c in queries.columns])
    current, everything = base, None
    for number in range(passes):
        # A pass's queries keep the original id; they differ in text, so each gets a part number.
        numbered = current.withColumn("__part", F.row_number().over(Window.partitionBy("query_id").orderBy("text")))
        keyed = numbered.withColumn("__key", F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("__part").cast("string")))
        hits = search(corpus, keyed.drop("query_id").withColumnRenamed("__key", "query_id"), SETTINGS.multi_pass_top_k, use_vectors=number == 0 or provider is not None)
        hits = hits.withColumnRenamed("query_id", "__key").join(keyed.select("__key", "query_id", "__part"), "__key").drop("__key").withColumn("__pass", F.lit(number))
        everything = hits if everything is None else everything.unionByName(hits)
        everything = everything.checkpoint()
        if number + 1 < passes:
            extra = follow_ups(everything, base)
            kind = base.schema["embedding"].dataType
            current = extra.join(base.drop("text", "embedding"), "query_id")
            if provider is None:
                current = current.withColumn("embedding", F.lit(None).cast(kind))
            else:
                vectors = provider.embed(current.select(F.col("text").alias("chunk_id"), F.col("text").alias("content")).distinct())
                current = current.join(vectors.select(F.col("chunk_id").alias("text"), F.col("embedding").cast(kind).alias("embedding")), "text", "left")
            current = current.select(base.columns).checkpoint()
            if current.isEmpty():
                break
    first = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("__pass", "__part", "rank"))
    unique = everything.withColumn("__n", first).where("__n = 1").drop("__n", "__pass", "__part")
    used = postprocess.process(unique, base, as_of, SETTINGS.multi_pass_max_chunks)
    return used, postprocess.assemble(used, base)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's own checkpoint folder; a temporary one only for a local session without one (tests)."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="chartloom-"))


def summaries(hits: DataFrame) -> DataFrame:
    """What a reader sees of each source: 150 characters of it."""
    keep = [c for c in ("query_id", "doc_id", "patient_name", "section_title", "clinical_category", "score", "vector_rank", "keyword_rank", "date_recorded") if c in hits.columns]
    return hits.select(*keep, F.left("content", F.lit(150)).alias("preview"))


def mentions(text, words=FOLLOW_UP_TERMS):
    return any_contains(F.lower(text), words)


_SIGNPOST = "current"


def reindex(spark: SparkSession, chunks: DataFrame, vectors: DataFrame, path: str, fields: dict[str, float] | None = None, stem: bool = False) -> Corpus:
    """Write chunks, vectors and text index as one new version folder and open it (ING-13, SRC-12).

    Readers go by the signpost, one small table that is replaced last: they see
    the old version until all of the new one is there.  Old versions stay until
    ``drop_versions``, so that running searches end undisturbed.
    """
    version = f"version-{uuid.uuid4().hex}"
    chunks.write.parquet(f"{path}/{version}/chunks")
    vectors.write.parquet(f"{path}/{version}/vectors")
    stored = spark.read.parquet(f"{path}/{version}/chunks")
    fulltext.build(stored, fields, stem=stem).save(f"{path}/{version}/text")
    spark.createDataFrame([(version, stem)], "version string, stem boolean").coalesce(1).write.parquet(f"{path}/{_SIGNPOST}.next")
    _replace(spark, f"{path}/{_SIGNPOST}.next", f"{path}/{_SIGNPOST}")
    return open_index(spark, path)


def _replace(spark: SparkSession, source: str, target: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    a, b = hadoop.Path(source), hadoop.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(b, True)
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {source} to {target}")


def _current(spark: SparkSession, path: str):
    return spark.read.parquet(f"{path}/{_SIGNPOST}").first()  # one row


def open_index(spark: SparkSession, path: str) -> Corpus:
    """The version that the signpost names, stemmed as it was built."""
    at = _current(spark, path)
    folder = f"{path}/{at['version']}"
    return Corpus(spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/vectors"), fulltext.TextIndex.load(spark, f"{folder}/text", at["stem"]))


def drop_versions(spark: SparkSession, path: str) -> int:
    """Delete all versions but the current one; returns how many."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kept = _current(spark, path)["version"]
    old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("version-") and f.getPath().getName() != kept]
    for p in old:
        fs.delete(p, True)
    return len(old)
