"""Exact vector search: a flat scan, one matrix product per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.config import SETTINGS
from chartloom.functions.vectors import dot, normalized
from chartloom.sources.tables import delete_where_in

#: Queries are sent to the executors in blocks of this many vectors.
QUERY_BLOCK = 1024


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Incoming rows replace stored ones with their key (VEC-01)."""
    return delete_where_in(stored, incoming, key).unionByName(incoming.dropDuplicates([key]))


def check_counts(chunks: DataFrame, vectors: DataFrame) -> None:
    """A batch needs a vector for every chunk (VEC-01)."""
    a, b = chunks.count(), vectors.count()
    if a != b:
        raise ValueError(f"{a} chunks but {b} vectors")


#: Columns of packed vectors: a row is a block.
PACKED = ("ids", "vectors", "scopes")


def _pack(batches) -> Iterator:
    """An Arrow batch of (id, vector, scope) as one row of lists."""
    import pyarrow as pa

    for b in batches:
        ends = pa.array([0, b.num_rows], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in b.columns], names=list(PACKED))


def packed(rows: DataFrame, *by: str) -> DataFrame:
    """Blocks of (id, vector, scope) rows: as they lie, a batch a block, or all rows that agree in ``by``."""
    if by:
        row = F.struct("id", "vector", "scope")
        return rows.groupBy(*by).agg(F.collect_list(row).alias("r")).select(*by, F.col("r.id").alias("ids"), F.col("r.vector").alias("vectors"), F.col("r.scope").alias("scopes"))
    kinds = dict(rows.dtypes)
    return rows.select("id", "vector", "scope").mapInArrow(_pack, ", ".join(f"{p} array<{kinds[c]}>" for p, c in zip(PACKED, ("id", "vector", "scope"))))


def _groups(column, rows: int):
    """The vectors of one list by dimension: (dimension, places, matrix)."""
    import pyarrow as pa

    lengths = np.asarray(column.value_lengths().fill_null(0))
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == n)
        yield int(n), at, np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(len(at), n)


def _score(k: int, digits: int | None, schema):
    """The k best vectors of each query of a pair of blocks (q_ids, q_vectors, q_scopes, ids, vectors, scopes)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for row in range(b.num_rows):
                q_ids, q_vectors, q_scopes, ids, vectors, scopes = (c[row].values for c in b.columns)
                scope_of, wanted = np.asarray(scopes.to_pylist(), object), q_scopes.to_pylist()
                best: dict[int, tuple[list, list]] = {}
                of_queries = list(_groups(q_vectors, len(q_ids)))
                for n, places, matrix in _groups(vectors, len(ids)):
                    for dim, asked, q in of_queries:
                        m = min(n, dim)
                        scores = matrix[:, :m] @ q[:, :m].T
                        if digits is not None:
                            scores = np.round(scores, digits)
                        for j, query in enumerate(asked.tolist()):
                            mine = np.arange(len(places)) if wanted[query] is None else np.flatnonzero(scope_of[places] == wanted[query])
                            s = scores[mine, j]
                            if len(s) > k:  # the k best, and all that tie with the last of them
                                keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                                mine, s = mine[keep], s[keep]
                            old = best.get(query, ([], []))
                            best[query] = _cut(old[0] + s.tolist(), old[1] + ids.take(pa.array(places[mine])).to_pylist(), k)
                out = [(q, i, s) for q, (ss, ii) in best.items() for s, i in zip(ss, ii)]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], schema.field(1).type), pa.array([o[2] for o in out], pa.float64())], schema=schema)

    return run


def best_of_pairs(pairs: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank) from pairs of blocks: each pair gives k rows a query at most, which one window merges."""
    import pyarrow as pa

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kinds = {c: t[6:-1] for c, t in pairs.dtypes if c in ("q_ids", "ids")}
    schema = pa.schema([("query_id", arrow[kinds["q_ids"]]), ("doc_id", arrow[kinds["ids"]]), ("score", pa.float64())])
    columns = [f"q_{c}" for c in PACKED] + list(PACKED)
    parts = pairs.select(*columns).mapInArrow(_score(k, digits, schema), f"query_id {kinds['q_ids']}, doc_id {kinds['ids']}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k)


def _cut(scores: list, ids: list, k: int):
    order = sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k]
    return [scores[i] for i in order], [ids[i] for i in order]


def query_rows(queries: DataFrame) -> DataFrame:
    """(id, vector, scope) of the queries that have a vector."""
    scope = F.col("scope").cast("string") if "scope" in queries.columns else F.lit(None).cast("string")
    return queries.where(F.size("embedding") > 0).select(F.col("query_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), scope.alias("scope"))


def vector_rows(vectors: DataFrame, doc_id: str = "chunk_id", scope: str | None = None) -> DataFrame:
    return vectors.select(F.col(doc_id).alias("id"), F.col("embedding").alias("vector"), (F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope"))


def named_queries(blocks: DataFrame) -> DataFrame:
    return blocks.withColumnsRenamed({c: f"q_{c}" for c in PACKED})


def search(vectors: DataFrame, queries: DataFrame, k: int = SETTINGS.top_k, doc_id: str = "chunk_id", scope: str | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k largest dot products of each query (VEC-02, VEC-03).

    ``queries`` has query_id, embedding and optionally scope.  Vectors of another
    dimension are compared over the shorter length; empty ones are skipped; ties
    go to the lower id.  Vectors are packed where they lie, queries by hash into
    blocks of about QUERY_BLOCK; a join pairs each block with each, so that no
    query passes through the driver, and a pair sends on k rows a query.
    """
    asked = query_rows(queries)
    n_blocks = -(-asked.count() // QUERY_BLOCK)
    asked = packed(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(n_blocks, 1))).cast("int")), "block")
    lying = packed(vector_rows(vectors, doc_id, scope)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(n_blocks - 1, 0)))))
    return best_of_pairs(lying.join(named_queries(asked), "block"), k, digits)


def score_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Dot product of two vector columns of joined rows."""
    return pairs.withColumn("score", dot(F.col(a), F.col(b)))


def normalize(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.withColumn(column, normalized(F.col(column)))


def centroid(vectors: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """Mean per position of each group (AGG-10)."""
    parts = vectors.select(*by, F.posexplode(column).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def word_average(docs: DataFrame, word_vectors: DataFrame, dim: int, text: str = "text", doc_id: str = "chunk_id") -> DataFrame:
    """Normalised mean of the known words' vectors; none known: zeros (VEC-12)."""
    from chartloom.functions.text import words

    known = docs.select(doc_id, F.explode(words(F.col(text))).alias("word")).join(word_vectors, "word").select(doc_id, F.col("vector").alias("embedding"))
    means = centroid(known, [doc_id]).select(doc_id, normalized(F.col("centroid")).alias("embedding"))
    return docs.select(doc_id).join(means, doc_id, "left").select(doc_id, F.coalesce("embedding", F.array_repeat(F.lit(0.0), dim)).alias("embedding"))


class Provider:
    """Where embeddings come from; the first available provider of a list is used (VEC-13)."""

    dimension = 0

    def available(self) -> bool:
        return True

    def embed(self, docs: DataFrame) -> DataFrame:
        raise NotImplementedError


class StoredVectors(Provider):
    """Embeddings computed elsewhere, as a table of (chunk_id, embedding) (VEC-14)."""

    def __init__(self, vectors: DataFrame, dimension: int) -> None:
        self.vectors, self.dimension = vectors, dimension

    def embed(self, docs: DataFrame) -> DataFrame:
        return docs.select("chunk_id").join(self.vectors, "chunk_id")


class WordVectors(Provider):
    def __init__(self, words: DataFrame | None, dimension: int) -> None:
        self.words, self.dimension = words, dimension

    def available(self) -> bool:
        return self.words is not None

    def embed(self, docs: DataFrame) -> DataFrame:
        return word_average(docs, self.words, self.dimension, text="content")


def first_available(providers: list[Provider]) -> Provider:
    return next(p for p in providers if p.available())
