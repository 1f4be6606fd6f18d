"""Standing indexes: vector cells, postings by impact, and upkeep by segments.

Each query builds its index in the shared folder from the whole tables and
searches it with every benchmark item, as the queries without an index do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.catalog import retrieval as R
from chartloom.catalog.registry import query
from chartloom.operators import fulltext, impact_index, vector_cells, vector_index
from chartloom.plans.upkeep import LiveIndex
from chartloom.sources import versions
from chartloom.sources.tables import table


def cells(spark, d) -> vector_cells.CellIndex:
    return vector_cells.CellIndex.build(R.vectors(spark, d), versions.scratch(spark, "vector-cells"), scope="scope")


@query("vector_cells_topk")
def vector_cells_topk(spark, d):
    """The nearest cells only, as many as the index measured; see ``vector_cells_recall``."""
    return R._ranked(cells(spark, d).search(R.queries(spark, d).where("embedding is not null"), 10, digits=6))


@query("vector_cells_every", f"WITH {R._knn(False, 10)} {R._RANKED} kn")
def vector_cells_every(spark, d):
    """All cells asked: the exact search over the stored index."""
    index = cells(spark, d)
    return R._ranked(index.search(R.queries(spark, d).where("embedding is not null"), 10, probes=len(index.centres), digits=6))


@query("vector_cells_scoped", f"WITH {R._knn(True, 10)} {R._RANKED} kn")
def vector_cells_scoped(spark, d):
    index = cells(spark, d)
    return R._ranked(index.search(R.queries(spark, d, True).where("embedding is not null"), 10, probes=len(index.centres), digits=6))


@query("vector_cells_recall")
def vector_cells_recall(spark, d):
    """Every vector whose id is divisible by 20 is asked, against all: recall at 10, and the share of the vectors that was read."""
    index = cells(spark, d)
    asked = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_cells.recall(index.search(asked, 10), vector_index.search(R.vectors(spark, d), asked, 10))
    share = index.read_share(asked).agg(F.round(F.sum("read") / F.sum("stored"), 6).alias("read_share"))
    return found.crossJoin(share)  # one row each


@query("bm25_impact", f"WITH {R._bm25(False, 10)} {R._RANKED} bm")
def bm25_impact(spark, d):
    index = impact_index.ImpactIndex.build(R.index(spark, d), versions.scratch(spark, "impact-index"))
    return R._ranked(impact_index.search(index, R.queries(spark, d), 10, 6).results)


@query("bm25_impact_reads")
def bm25_impact_reads(spark, d):
    """Postings read by step and query, against those of all terms of the query."""
    index = impact_index.ImpactIndex.build(R.index(spark, d), versions.scratch(spark, "impact-index"))
    asked = R.queries(spark, d)
    reads = impact_index.search(index, asked, 10, 6).reads
    return reads.groupBy("query_id").agg(F.sum("postings").alias("read")).join(impact_index.all_postings(index, asked).withColumnRenamed("postings", "stored"), "query_id", "full")


#: The documents after the changes of ``kept_index``: one of seven deleted, one of eleven replaced by its text twice.
CHANGED = "documents AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN text || ' ' || text ELSE text END AS text, source FROM documents WHERE doc_id % 7 <> 0)"


def kept_index(spark, d) -> LiveIndex:
    """An index over four of five documents, then changed by an insert of the others, replacements, a deletion and a merge."""
    docs = R.chunks(spark, d).select("chunk_id", "patient_id", "content")
    v = R.vectors(spark, d).select("chunk_id", "embedding")
    index = LiveIndex.create(spark, versions.scratch(spark, "live-index"), docs.where("chunk_id % 5 != 0"), v, {"content": 2.0})
    index.put(docs.where("chunk_id % 5 = 0"), v)
    index.merge()
    index.drop_old()  # nobody reads what was merged
    index.put(docs.where("chunk_id % 11 = 0").withColumn("content", F.concat("content", F.lit(" "), "content")), v)
    index.delete(docs.where("chunk_id % 7 = 0"))
    return index


@query("upkeep_search", f"WITH {CHANGED}, {R._bm25(False, 10)} {R._RANKED} bm")
def upkeep_search(spark, d):
    return R._ranked(fulltext.search(kept_index(spark, d).open().text, R.queries(spark, d), 10, 6))


@query("upkeep_statistics", f"WITH {CHANGED}, {R._bm25(False, 10)} SELECT term, df, st.n AS n_docs, round(avgdl, 6) AS avg_length FROM dfr, st")
def upkeep_statistics(spark, d):
    """Frequencies and corpus numbers after the changes, from signed counts alone."""
    text = kept_index(spark, d).open().text
    return text.frequencies.crossJoin(text.stats).select("term", "df", "n_docs", F.round("avg_length", 6).alias("avg_length"))  # the statistics are one row
