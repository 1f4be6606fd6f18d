"""Approximate vector search: k-means cells as partition folders, exact scores in the nearest cells (VEC-15).

Directions of a bounded sample of the vectors give the cells' centres; every
vector is stored, in blocks, in the folder of the centre it points to most.  A
search asks the cells whose centres score best for a query; all other folders
are pruned before anything is read, and what is read is scored exactly.  How
many cells have to be asked is measured when the index is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chartloom.config import SETTINGS
from chartloom.operators import vector_index
from chartloom.sources import versions

#: The centres are fitted on at most so many vectors a cell, those with the least hashes.
SAMPLE_PER_CELL = 256
#: There are at most so many cells; their centres are the only vectors that every executor gets.
MAX_CELLS = 4096
MAX_CENTRE_BYTES = 64 << 20
#: Vectors of a block, about.
BLOCK_ROWS = 1024
#: So many stored vectors are asked, at most, to measure how many cells a search needs.
PROBE_SAMPLE = 256
#: A worker scores so many pairs of vector and centre at once.
BATCH_SCORES = 1 << 20
ITERATIONS = 12
#: The cell of vectors of another dimension, or of no direction; it is always asked.
REST = -1
_SIGNPOST = "version string, schema string, probes int, recall double"


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)


def _sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows, those with the least hashes of their ids."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def fit_centres(rows: DataFrame, cells: int, seed: int) -> np.ndarray:
    """Unit centres of the sample's directions, by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = vector_index.normalized(F.transform("vector", lambda x: x.cast("double")))
    data = _sample(rows, SAMPLE_PER_CELL * cells, seed).select(array_to_vector(unit).alias("features"))
    return _unit(np.array(KMeans(k=cells, seed=seed, maxIter=ITERATIONS).fit(data).clusterCenters()))


def _cells_of(centres: np.ndarray, best: int):
    """Adds the ``best`` cells of each vector, the best first; the cell REST where the dimension is another or the vector is null or zero."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        step = max(1, BATCH_SCORES // len(centres))
        for whole in batches:
            for b in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                near = np.full((b.num_rows, min(best, len(centres))), REST, np.int32)
                count = np.ones(b.num_rows, np.int64)
                for n, at, matrix in vector_index._groups(b.column(1), b.num_rows):
                    if n == centres.shape[1]:
                        some = np.any(matrix, axis=1)
                        near[at[some]] = np.argsort(-(matrix[some] @ centres.T), axis=1, kind="stable")[:, :best]
                        count[at[some]] = near.shape[1]
                kept = np.arange(near.shape[1]) < count[:, None]
                cells = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(near[kept], pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns, cells], names=[*b.schema.names, "cells"])

    return run


def with_cells(rows: DataFrame, centres: np.ndarray, best: int = 1) -> DataFrame:
    """(id, vector, scope) rows with the numbers of their ``best`` cells."""
    kinds = dict(rows.dtypes)
    return rows.select("id", "vector", "scope").mapInArrow(_cells_of(centres, best), f"id {kinds['id']}, vector {kinds['vector']}, scope string, cells array<int>")


@dataclass
class CellIndex:
    """A stored index; ``probes`` is how many cells a search asks unless told otherwise, ``recall`` what that gave on the sample."""

    spark: SparkSession
    path: str
    folder: str
    centres: np.ndarray
    probes: int
    recall: float
    schema: str

    @staticmethod
    def build(vectors: DataFrame, path: str, doc_id: str = "chunk_id", scope: str | None = None, cells: int | None = None, target: float = 0.95, k: int = SETTINGS.top_k, seed: int = 7) -> CellIndex:
        """Write a new version and point to it; an earlier version stays until ``drop_old``.

        ``cells`` is the square root of the number of vectors unless given.  The
        dimension is that of most vectors.  ``target`` is the share of the k
        nearest vectors that a search has to find, by the sample.
        """
        spark = vectors.sparkSession
        rows = vector_index.vector_rows(vectors, doc_id, scope)
        sizes = rows.groupBy(F.size("vector").alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
        dimension, total = (sizes["n"], sizes["count"]) if sizes else (1, 0)
        cells = max(1, min(cells or round(total**0.5), MAX_CELLS, MAX_CENTRE_BYTES // (8 * dimension)))
        usual = rows.where((F.size("vector") == dimension) & F.exists("vector", lambda x: x != 0))
        centres = fit_centres(usual, cells, seed) if total else np.zeros((1, dimension))
        folder = versions.fresh("cells")
        kinds = dict(rows.dtypes)
        index = CellIndex(spark, path, folder, centres, len(centres), 1.0, f"ids array<{kinds['id']}>, vectors array<{kinds['vector']}>, scopes array<string>, cell int")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/{folder}/centres")
        index._store(rows)
        if total:
            index.probes, index.recall = index.measure(_sample(usual, PROBE_SAMPLE, seed + 1), target, k)
        versions.publish(spark, path, _SIGNPOST, (folder, index.schema, index.probes, index.recall))
        return index

    @staticmethod
    def open(spark: SparkSession, path: str) -> CellIndex:
        at = versions.current(spark, path)
        centres = spark.read.parquet(f"{path}/{at['version']}/centres").orderBy("cell").collect()  # MAX_CENTRE_BYTES at most
        return CellIndex(spark, path, at["version"], np.array([r["centre"] for r in centres]), at["probes"], at["recall"], at["schema"])

    def drop_old(self) -> None:
        for name in versions.folders(self.spark, self.path):
            if name not in (self.folder, versions.SIGNPOST):
                versions.delete(self.spark, f"{self.path}/{name}")

    def _store(self, rows: DataFrame) -> None:
        """Add rows to their cells' folders, in blocks; a large cell has many blocks, so no cell meets in one task."""
        placed = with_cells(rows, self.centres).withColumn("cell", F.element_at("cells", 1))
        n = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # a row a cell
        spread = placed.join(F.broadcast(n), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK_ROWS)))
        vector_index.packed(spread, "cell", "block").drop("block").write.mode("append").partitionBy("cell").parquet(f"{self.path}/{self.folder}/blocks")

    def append(self, vectors: DataFrame, doc_id: str = "chunk_id", scope: str | None = None) -> None:
        """Add vectors with new ids; the centres stay, so rebuild when the data has drifted (``measure`` tells)."""
        self._store(vector_index.vector_rows(vectors, doc_id, scope))

    def blocks(self, cells: list[int] | None = None) -> DataFrame:
        """The stored blocks of some cells, or of all; other cells' folders are not read."""
        stored = self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.folder}/blocks")
        return stored if cells is None else stored.where(F.col("cell").isin([*cells, REST]))

    def _asked(self, queries: DataFrame, probes: int) -> DataFrame:
        """(cell, id, vector, scope): a row for each cell that a query asks; a query of another dimension asks all."""
        near = with_cells(vector_index.query_rows(queries), self.centres, probes)
        every = F.array(*[F.lit(i) for i in range(len(self.centres))])
        cells = F.when(F.element_at("cells", 1) == REST, every).otherwise(F.col("cells"))
        return near.select("id", "vector", "scope", F.explode(F.concat(cells, F.array(F.lit(REST)))).alias("cell"))

    def search(self, queries: DataFrame, k: int = SETTINGS.top_k, probes: int | None = None, digits: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) as the exact search gives it, from the nearest cells only."""
        asked = self._asked(queries, probes or self.probes)
        sizes = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a cell
        per_cell = self.spark.createDataFrame([(r["cell"], -(-r["n"] // vector_index.QUERY_BLOCK)) for r in sizes], "cell int, blocks bigint")
        blocked = asked.join(F.broadcast(per_cell), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        pairs = self.blocks([r["cell"] for r in sizes]).join(vector_index.named_queries(vector_index.packed(blocked, "cell", "block")), "cell")
        return vector_index.best_of_pairs(pairs, k, digits)

    def read_share(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, read, stored): how many vectors a search scores for each query."""
        sizes = self.blocks().groupBy("cell").agg(F.sum(F.size("ids")).alias("n"))
        total = sizes.agg(F.sum("n").alias("stored"))  # one row
        return self._asked(queries, probes or self.probes).join(sizes, "cell").groupBy(F.col("id").alias("query_id")).agg(F.sum("n").alias("read")).crossJoin(total)

    def measure(self, sample: DataFrame, target: float, k: int) -> tuple[int, float]:
        """(probes, recall): the least number of cells with which the sampled vectors find that share of their k nearest, exactly searched."""
        queries = sample.select(F.col("id").alias("query_id"), F.col("vector").alias("embedding"))
        flat = self.blocks().select(F.explode(F.arrays_zip("ids", "vectors", F.transform("ids", lambda _: F.col("cell")).alias("cells"))).alias("r")).select(F.col("r.ids").alias("chunk_id"), F.col("r.vectors").alias("embedding"), F.col("r.cells").alias("cell"))
        exact = vector_index.search(flat, queries, k)
        order = with_cells(vector_index.query_rows(queries), self.centres, len(self.centres)).select(F.col("id").alias("query_id"), "cells")
        at = exact.join(flat.select(F.col("chunk_id").alias("doc_id"), "cell"), "doc_id").join(order, "query_id").select(F.greatest(F.array_position("cells", F.col("cell")), F.lit(1)).alias("place"))
        counts = at.groupBy("place").agg(F.count(F.lit(1)).alias("n")).orderBy("place").collect()  # a row a cell
        total, found = sum(r["n"] for r in counts), 0
        for r in counts:
            found += r["n"]
            if found >= target * total:
                return int(r["place"]), found / total
        return len(self.centres), 1.0


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact results that were found."""
    hit = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return hit.agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("wanted"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))
